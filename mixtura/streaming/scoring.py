"""Scoring a stream with a model: stateless, so any batch can be replayed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mixtura.operators.linear import assign, responsibilities


def scored(stream: DataFrame, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, kind: str = "full", x: str = "x") -> DataFrame:
    """``stream`` with q and cluster of a fixed Gaussian mixture."""
    return assign(responsibilities(stream, weights, means, covariances, kind, x))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once; stops when the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Full-batch Newton steps for logistic models, with sums made by Spark.

Tasks send partial gradients and curvatures as (place, value) rows, which Spark adds up by place;
the driver gets a few hundred numbers, whatever the number of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def matrix(column: pa.Array) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(df: DataFrame, parts: Callable[[pa.RecordBatch], np.ndarray | None], size: int) -> np.ndarray:
    """The sum over all rows of the vectors that ``parts`` makes of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += parts(batch)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "v": pa.array(total)})

    out = np.zeros(size)
    for r in df.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[r.at] = r.v
    return out

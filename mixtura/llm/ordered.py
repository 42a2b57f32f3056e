"""Places and running values within keys that stay parallel when one key holds most rows.

A window over a key would put all its rows into one task. Here rows are sorted over the cluster by key
and order, each task numbers what it has, and one row for each partition tells the later ones what a
key that goes on there has had before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixtura.llm.common import written


def _numbered(batches: Iterator[pa.RecordBatch], key: str, xors: Sequence[str]) -> Iterator[pa.RecordBatch]:
    part, last, had, carry = TaskContext.get().partitionId(), None, 0, dict.fromkeys(xors, 0)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, at = b.column(key).to_numpy(zero_copy_only=False), np.arange(n)
        first = np.ones(n, bool)
        first[1:] = keys[1:] != keys[:-1]
        first[0] = last is None or keys[0] != last
        start = np.maximum.accumulate(np.where(first, at, -1))
        goes_on = start < 0
        place = np.where(goes_on, had + at, at - start)
        columns, names = list(b.columns), list(b.schema.names)
        for x in xors:
            run = np.bitwise_xor.accumulate(b.column(x).to_numpy(zero_copy_only=False))
            run ^= np.where(goes_on, carry[x], np.where(start > 0, run[start - 1], 0))
            carry[x] = run[-1]
            columns[names.index(x)] = pa.array(run)
        last, had = keys[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(np.full(n, part, "int32"))], [*names, "_place", "_part"])


def numbered(df: DataFrame, key: str, order: Sequence[str | Column], xors: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_place``, each row's place from 0 among the rows of its ``key`` by ``order``, and
    every column of ``xors`` replaced by the exclusive-or of its values up to the row.

    ``key`` is a long without nulls. Rows that are equal in ``order`` come in any order, so it should
    tell apart all that the caller tells apart. The result is a written table; the driver gets one row
    for each partition.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = T.StructType([*df.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_part", T.IntegerType())])
    ranged = df.withColumn("_row", F.monotonically_increasing_id())  # splits rows that are equal in all else
    ranged = ranged.repartitionByRange(n, key, *order, "_row").sortWithinPartitions(key, *order, "_row").drop("_row")
    local = written(ranged.mapInArrow(lambda it: _numbered(it, key, xors), out), "numbered")
    ends = local.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, "_place", *xors)).alias("last")).collect()
    rows, before = [], None
    for part, first, last in sorted(ends):
        k, place, *values = last
        if before and before[0] == first:
            rows.append((part, first, before[1], *before[2]))
            if k == first:
                place, values = place + before[1], [v ^ w for v, w in zip(values, before[2], strict=True)]
        before = (k, place + 1, values)
    names = [f"_had{i}" for i in range(len(xors))]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField(key, T.LongType()), *(T.StructField(x, T.LongType()) for x in ("_had", *names))])
    had = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row for each partition at most
    whole = local.join(had, ["_part", key], "left").withColumn("_place", F.col("_place") + F.coalesce("_had", F.lit(0)))
    for x, h in zip(xors, names, strict=True):
        whole = whole.withColumn(x, F.col(x).bitwiseXOR(F.coalesce(h, F.lit(0))))
    return whole.select(*df.columns, "_place")

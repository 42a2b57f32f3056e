"""Ranks and running sums of a column that stay parallel for a single key.

An unbounded window over one feature would put all its rows into one task. Here the distinct values of
all features are dealt to ranges of their own order, so that a window only spans one range of a feature,
and a small table holds what lies before each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtura.sources.shared import stored


def bucketed(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, which rises with ``keys`` and ``value``; equal ones share a bucket. As many
    buckets as the session has shuffle partitions, where not given. Their bounds are sampled, so they
    may fall elsewhere when the result is computed again."""
    buckets = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartitionByRange(buckets, *keys, value).withColumn("_bucket", F.spark_partition_id())


def running(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """One row for each (keys, value), with the sums over its rows (``name``), over all rows with
    smaller values (``name_before``), and over all rows of the keys (``name_all``). Sums of values and
    their buckets are written first, since what lies before a bucket must be of the same buckets."""
    keys = list(keys)
    tied = stored(bucketed(df.groupBy(*keys, value).agg(*(F.sum(c).alias(n) for n, c in sums.items())), keys, value, buckets), "running")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = tied.groupBy(*keys, "_bucket").agg(*(F.sum(n).alias(f"_{n}") for n in sums))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_offset") for n in sums), *(F.sum(f"_{n}").over(over).alias(f"{n}_all") for n in sums))
    out = tied.join(offsets, [*keys, "_bucket"])
    return out.select(*keys, value, *sums, *((F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}_offset")).alias(f"{n}_before") for n in sums), *(f"{n}_all" for n in sums))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """One row for each key with exact quantiles, interpolated between neighbours, named by ``at``.
    They are read off running counts, so no task holds all values of a key."""
    r = running(df, keys, value, {"m": F.lit(1)})
    picks = []
    for name, q in at.items():
        place = (F.col("m_all") - 1) * F.lit(float(q))
        held = lambda k: F.max(F.when((F.col("m_before") <= k) & (k < F.col("m_before") + F.col("m")), F.col(value)))
        low, high = held(F.floor(place)), held(F.ceil(place))
        picks.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return r.groupBy(*keys).agg(*picks)

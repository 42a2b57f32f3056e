"""Fusion of feature-importance metrics: shared rank, rank positions, top unions, heat-map tables.

Tables have a row for each feature, so unbounded windows over a metric are over a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtura.functions.vec import dbl, safe_log


def melt_metrics(df: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    return df.select(F.col(name).alias("feature"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("feature", "x.*")


def mapped_value(metric: Column, v: Column) -> Column:
    """Log-odds are shifted to start at 0, p-values become -log p; others stay."""
    least = F.min("v").over(Window.partitionBy("metric"))
    return F.when(metric.endswith("logodds"), v - least).when(metric.endswith("McNemar"), -safe_log(v)).otherwise(v)


def tree_importance(df: DataFrame, v: str = "v", name: str = "v") -> DataFrame:
    """Importances of trees by their logarithm, above the least one."""
    logs = df.withColumn("_l", safe_log(v))
    least = F.broadcast(logs.agg(F.min("_l").alias("_m")))  # one row
    return logs.crossJoin(least).withColumn(name, F.col("_l") - F.col("_m")).drop("_l", "_m")


def shared_rank(long: DataFrame) -> DataFrame:
    """(feature, share): each metric's share of its total, averaged over metrics."""
    shares = long.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("metric")))
    return shares.groupBy("feature").agg(F.avg("share").alias("share"))


def rank_positions(long: DataFrame, positions: int = 5) -> DataFrame:
    """(feature, pos1..): how many metrics place the feature there; features placed nowhere are left out."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "feature"))
    placed = long.withColumn("pos", place).filter(F.col("pos") <= positions)
    return placed.groupBy("feature").agg(*(F.sum((F.col("pos") == i).cast("long")).alias(f"pos{i}") for i in range(1, positions + 1)))


def rank_pies(positions: DataFrame) -> DataFrame:
    """(position, feature, n): the counts that are not zero, as the pieces of one pie for each position."""
    names = [c for c in positions.columns if c.startswith("pos")]
    cells = F.explode(F.array(*(F.struct(F.lit(int(c[3:])).alias("position"), F.col("feature"), F.col(c).alias("n")) for c in names)))
    return positions.select(cells.alias("x")).select("x.*").filter("n > 0")


def top(shares: DataFrame, k: int = 20, by: str = "share") -> DataFrame:
    """The k features with the largest share, the first of equals by name."""
    return shares.orderBy(F.desc(by), "feature").limit(k)


def outer_effects(tables: dict[str, DataFrame]) -> DataFrame:
    """(feature, and for each model its effect and sig): effect tables aligned by feature; what a model
    has not tested is null, and counts as not significant."""
    long = None
    for model, t in tables.items():
        one = t.select("feature", F.lit(model).alias("metric"), F.col("effect").alias("v"), "sig")
        long = one if long is None else long.unionByName(one)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return long.groupBy("feature").agg(*(x for m in tables for x in (pick(m, "v").alias(m), F.coalesce(pick(m, "sig"), F.lit(False)).alias(f"{m}_sig"))))


def top_union(long: DataFrame, k: int) -> DataFrame:
    """(feature, first): the union of each model's top k, with the place where it is seen first."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "feature"))
    return long.withColumn("pos", place).filter(F.col("pos") <= k).groupBy("feature").agg(F.min(F.struct("metric", "pos")).alias("m")).select("feature", F.col("m.metric").alias("metric"), F.col("m.pos").cast("long").alias("pos"))


def heat_map(long: DataFrame, models: list[str], k: int) -> DataFrame:
    """(feature, one column a model, mean): the top k by the mean over the models that have it."""
    wide = long.groupBy("feature").agg(*(F.max(F.when(F.col("metric") == m, F.col("v"))).alias(m) for m in models), F.avg("v").alias("mean"))
    return wide.orderBy(F.desc("mean"), "feature").limit(k)


def group_spread(long: DataFrame, k: int) -> DataFrame:
    """(feature, spread): deviation over groups of the group means, the k largest."""
    means = long.groupBy("feature", "grp").agg(F.avg("value").alias("m"))
    return means.groupBy("feature").agg(F.coalesce(F.stddev_samp("m"), dbl(0)).alias("spread")).orderBy(F.desc("spread"), "feature").limit(k)


def renamed(df: DataFrame, names: DataFrame, feature: str = "feature", short: str = "short") -> DataFrame:
    """Short names by a small table; a feature without one keeps its own. The first of repeated names counts."""
    once = names.groupBy(feature).agg(F.min(short).alias(short))
    return df.join(once, feature, "left").withColumn(short, F.coalesce(short, feature))

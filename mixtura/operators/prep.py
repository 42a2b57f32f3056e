"""Cleaning: missing values, coding, discretisation, scaling, nearest-neighbour imputation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtura.functions.vec import dbl
from mixtura.operators import impute
from mixtura.operators.ranking import bucketed, quantiles, running
from mixtura.sources.shared import stored


def missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def to_double(c: str) -> Column:
    """A string as a double; what is none becomes null."""
    return F.expr(f"try_cast(`{c}` AS double)")


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)  # NaN counts as missing


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, available): the share of finite values, in one pass."""
    one = df.agg(*(F.avg((~missing(c)).cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("available")) for c in columns))).alias("x")).select("x.*")


def condense(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Without the columns of which less than ``least`` is available."""
    shares = {r.feature: r.available for r in availability(df, columns).collect()}  # one row a column
    return df.drop(*(c for c in columns if (shares[c] or 0) < least))


def drop_missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return condense(df, columns, 1.0)


def missing_view(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    return df.select(id_col, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), missing(c).alias("is_missing")) for c in columns))).alias("x")).select(id_col, "x.*")


def dense_codes(df: DataFrame, c: str, name: str) -> DataFrame:
    """Codes 0.. of the sorted distinct values, joined by value. The distinct values are dealt to ranges
    of their own order, whatever they begin with, so no task ranks them all."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels = stored(df.select(c).distinct().filter(F.col(c).isNotNull()).repartitionByRange(n, c).withColumn("_bucket", F.spark_partition_id()), "levels")
    sizes = levels.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(c)) - 1
    codes = levels.join(F.broadcast(offsets), "_bucket").select(c, (F.col("_before") + at).cast("int").alias(name))
    return df.join(codes, c, "left")


def recode(df: DataFrame, c: str, levels: list) -> DataFrame:
    """Two levels: one column of -0.5 and 0.5; more: a 0/1 column for each."""
    if len(levels) == 2:
        return df.withColumn(c, F.when(F.col(c) == levels[0], dbl(0.5)).when(F.col(c).isNotNull(), dbl(-0.5)))
    return df.select("*", *(F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"{c}_{i}") for i, v in enumerate(levels))).drop(c)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(dbl(1)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)  # one row of statistics


def relabel_by_prior(df: DataFrame, c: str, priors: list[float], name: str = "label") -> DataFrame:
    """Order-preserving discretisation into shares ``priors``; the largest values get 0. A value on
    a threshold falls into the lower bin."""
    n = df.count()
    cut = np.floor(np.cumsum(priors)[:-1] * n + 0.5).astype(int)
    # The k-th smallest values: found by rank over distinct values, one row for each threshold.
    r = running(df.select(c), [], c, {"m": F.lit(1)})
    rank = [F.min(F.when(F.col("m_before") + F.col("m") > int(k), F.col(c))) for k in cut]
    bounds = r.agg(*(x.alias(f"b{i}") for i, x in enumerate(rank))).first()
    return df.withColumn(name, sum(((F.col(c) <= dbl(b)).cast("int") for b in bounds), F.lit(0)))


def knn_impute(df: DataFrame, id_col: str, x: str, k: int = 10, shrink: float = 1e10, max_iter: int = 0) -> DataFrame:
    """Missing (null, NaN) cells of the array column filled from the k nearest complete rows.

    Weights are 1 / (d + mean(d) / shrink), normalised over the k. Without ``max_iter``, distances use the
    cells that the row has; with it, filled cells count too and rows are filled again up to so many
    times, until they stand still.
    """
    return impute.impute_rows(df, id_col, x, k, max_iter, shrink=shrink) if max_iter else impute.fill_once(df, id_col, x, k, shrink)


def treat_missing(df: DataFrame, id_col: str, columns: list[str], how: str = "impute", k: int = 10, max_iter: int = 0) -> DataFrame:
    """One entry for the ways to treat missing cells: ``rows`` and ``columns`` drop what holds one,
    ``impute`` fills from the k nearest complete rows, ``impute_columns`` from the k nearest complete
    columns, both to a fixed point within ``max_iter`` rounds (0: rows once, columns 50)."""
    if how == "rows":
        return drop_missing_rows(df, columns)
    if how == "columns":
        return drop_missing_columns(df, columns)
    if how not in ("impute", "impute_columns"):
        raise ValueError(f"unknown treatment {how!r}")
    x = F.array(*(F.when(~missing(c), F.col(c).cast("double")) for c in columns))
    rows = df.select(id_col, x.alias("_x"))
    filled = knn_impute(rows, id_col, "_x", k, max_iter=max_iter) if how == "impute" else impute.impute_columns(rows, "_x", k, max_iter or 50)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept).join(filled, id_col).select(*kept, *(F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def recode_table(df: DataFrame, id_col: str, kinds: dict[str, str], declared_missing: set[str] = frozenset(), least: float = 0.5, how: str = "impute", k: int = 10) -> DataFrame:
    """A mixed table as numbers: continuous and integer columns are cast (what is no number is
    missing), categorical and binary ones are recoded by their sorted levels, or dropped where they
    are declared to have missing values; then thin columns go and missing cells are treated."""
    out = df.select(id_col, *kinds)
    for c, kind in kinds.items():
        if kind in ("continuous", "integer"):
            out = out.withColumn(c, to_double(c))
        elif kind not in ("categorical", "binary"):
            raise ValueError(f"unknown kind {kind!r} of {c}")
        elif c in declared_missing:
            out = out.drop(c)
        else:
            levels = sorted(r[0] for r in out.select(c).distinct().collect() if r[0] is not None)  # levels of a category
            out = recode(out, c, levels)
    out = condense(out, [c for c in out.columns if c != id_col], least)
    columns = [c for c in out.columns if c != id_col]
    return treat_missing(out, id_col, columns, how, k)


def recode_described(df: DataFrame, id_col: str, variables: DataFrame, recoded: bool = True, drop_missing_categories: bool = True, least: float = 0.5, how: str = "impute", k: int = 10, detect: Callable[[str], Column] = missing, treat: Callable[[DataFrame, str, list[str]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, targets) of a mixed table by its own description ``variables`` (name, role, type,
    missing_values), a row for each variable.

    Variables of role Feature are recoded by type: Continuous and Integer ones are cast, what is no number
    is missing; Categorical and Binary ones become +-0.5 for two levels, else an indicator for each level
    in order. A variable whose column is an array gives a column ``name_i`` for each place. Categorical
    variables that are declared to have missing values ("yes") go, unless ``drop_missing_categories`` is
    off. Without ``recoded``, categories stay as they are, and their codes only help to fill the numbers.
    Columns with fewer values than the share ``least`` go; missing cells are treated as ``how`` says.
    ``detect`` tells a missing number, ``treat`` replaces the treatment. Targets are the columns of role
    Target, as they are; unknown types raise.
    """
    described = variables.select("name", "role", "type", "missing_values").collect()  # a row for each variable
    kinds = dict(df.dtypes)
    numbers: dict[str, Column] = {}
    raw: list[str] = []
    levelled: list[tuple[str, Column]] = []
    for r in (r for r in described if r.role == "Feature"):
        parts = [(r.name, F.col(r.name))]
        if kinds[r.name].startswith("array"):
            width = df.agg(F.max(F.size(r.name))).first()[0] or 0
            parts = [(f"{r.name}_{i}", F.get(r.name, F.lit(i))) for i in range(width)]
        if r.type in ("Continuous", "Integer"):
            for name, c in parts:
                number = c.cast("string").try_cast("double")
                numbers[name] = number
        elif r.type in ("Categorical", "Binary"):
            if not (drop_missing_categories and r.missing_values == "yes"):
                levelled += parts
                raw += [name for name, _ in parts]
        else:
            raise ValueError(f"unknown type {r.type!r} of {r.name}")
    out = df.select(id_col, *(c.alias(n) for n, c in numbers.items()), *(c.cast("string").alias(n) for n, c in levelled))
    for name in numbers:
        out = out.withColumn(name, F.when(~detect(name), F.col(name)))
    codes: list[str] = []
    for name, _ in levelled:
        before = set(out.columns)
        levels = sorted(r[0] for r in out.select(name).distinct().collect() if r[0] is not None)  # levels of a category
        kept = out.withColumn(f"_raw_{name}", F.col(name)) if not recoded else out
        out = recode(kept, name, levels)
        codes += [c for c in out.columns if c not in before and not c.startswith("_raw_") or c == name]
    held = condense(out, [*numbers, *codes], least)
    columns = [c for c in held.columns if c in {*numbers, *codes}]
    filled = treat(held, id_col, columns) if treat else treat_missing(held, id_col, columns, how, k)
    if not recoded:
        numeric = [c for c in columns if c in numbers]
        filled = filled.select(id_col, *numeric, *(F.col(f"_raw_{n}").alias(n) for n in raw))
    targets = df.select(id_col, *(r.name for r in described if r.role == "Target"))
    return filled, targets


def sample_words(words: DataFrame, share: float, repeats: int, seed: int) -> DataFrame:
    """A sample with replacement, ``repeats`` of its words once more, in random order."""
    drawn = words.sample(withReplacement=True, fraction=share, seed=seed)
    return drawn.unionByName(drawn.limit(repeats)).orderBy(F.rand(seed))


def describe(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """count, mean, std, min, quartiles and max of each feature."""
    plain = long.groupBy(feature).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    cuts = quantiles(long, [feature], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(cuts, feature).select(feature, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, label: str, value: str, bins: int = 30) -> DataFrame:
    """(label, bin, n, density) for each class over its own range; the last bin is closed."""
    bounds = df.groupBy(label).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = df.join(F.broadcast(bounds), label).groupBy(label, at.alias("bin"), "_n", width.alias("_width")).agg(F.count("*").alias("n"))
    return counts.select(label, "bin", "n", (F.col("n") / (F.col("_n") * F.col("_width"))).alias("density"))


def value_counts_pct(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))


def random_subset(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those first in a random order (a top-k, not a full sort)."""
    return df.orderBy(F.rand(seed)).limit(n)


def is_ordered(df: DataFrame, index: str, value: str) -> DataFrame:
    """ordered: whether no value lies below the one before it, the last pair included."""
    place = F.struct("_none", index)  # rows without index come last
    rows = bucketed(df.select(F.col(index).isNull().alias("_none"), index, value), ["_none"], index)
    following = F.lead(value).over(Window.partitionBy("_bucket").orderBy("_none", index))
    inside = rows.withColumn("_next", following).groupBy("_bucket").agg(
        F.min(F.col("_next").isNull() | (F.col("_next") >= F.col(value))).alias("ok"), F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last"))
    # A row for each bucket: the last value of one against the first of the next.
    step = F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("_bucket"))
    return inside.withColumn("_next", step).agg(F.coalesce(F.min(F.col("ok") & (F.col("_next").isNull() | (F.col("_next") >= F.col("last")))), F.lit(True)).alias("ordered"))

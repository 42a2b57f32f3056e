"""Group tests on long tables (feature, group, value): all features in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mixtura.functions import special
from mixtura.functions.vec import dbl
from mixtura.operators.ranking import quantiles, running

#: Normal scores worked out at once.
SCORES = 1 << 16


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else special.chi2_sf(a, d) for a, d in zip(x, dof)], dtype=float)


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if a != a else special.f_sf(a, b, c) for a, b, c in zip(x, d1, d2)], dtype=float)


def chi2_sf_even(x: Column, dof: Column) -> Column:
    """The tail for even degrees of freedom, in closed form."""
    half = x / 2
    terms = F.aggregate(F.sequence(F.lit(1), (dof / 2 - 1).cast("int")), F.struct(dbl(1).alias("t"), dbl(1).alias("s")), lambda a, j: F.struct((a["t"] * half / j).alias("t"), (a["s"] + a["t"] * half / j).alias("s")), lambda a: a["s"])
    return F.exp(-half) * F.when(dof <= 2, dbl(1)).otherwise(terms)


def melt(df: DataFrame, id_col: str, columns: list[str], group_col: str | None = None) -> DataFrame:
    """Wide to long: one row for each column and row, missing values left out."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    keep = [id_col, *([group_col] if group_col else [])]
    return df.select(*keep, cells.alias("c")).select(*keep, "c.feature", "c.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def midranks(long: DataFrame, feature: str = "feature", value: str = "value", count: Column | None = None) -> DataFrame:
    """(feature, value, ties, midrank, n). ``count`` is the number of rows that each row stands for."""
    r = running(long, [feature], value, {"ties": F.lit(1) if count is None else count})
    return r.select(feature, value, "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("midrank"), F.col("ties_all").alias("n"))


def _large_enough(long: DataFrame, feature: str, group: str, least: int) -> DataFrame:
    sizes = long.groupBy(feature, group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return long.join(sizes.select(feature, group), [feature, group], "left_semi")


def kruskal(long: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value", least: int = 3) -> DataFrame:
    """(feature, n, groups, h, effect): tie-corrected H and H / (n - 1), over groups of ``least`` rows."""
    used = _large_enough(long.select(feature, group, value), feature, group, least)
    # Rows are counted by value first; ranks are joined to distinct values, not to rows.
    cells = used.groupBy(feature, group, value).agg(F.count("*").alias("c"))
    ranks = midranks(cells, feature, value, F.col("c"))
    sums = cells.join(ranks.select(feature, value, "midrank"), [feature, value]).groupBy(feature, group).agg(F.sum(F.col("c") * F.col("midrank")).alias("s"), F.sum("c").alias("n"))
    ties = ranks.groupBy(feature).agg(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    per = sums.groupBy(feature).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).join(ties, feature)
    n = F.col("n").cast("double")
    h = (dbl(12) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return per.filter("groups >= 2").select(feature, F.col("n").cast("long").alias("n"), F.col("groups").cast("long").alias("groups"), h.alias("h")).withColumn("effect", F.greatest(dbl(0), F.col("h") / (F.col("n") - 1)))


def anova(long: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value", least: int = 3) -> DataFrame:
    """(feature, n, groups, f, effect), from counts, sums and sums of squares about the mean."""
    used = _large_enough(long.select(feature, group, value), feature, group, least)
    per = used.groupBy(feature, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    tot = per.groupBy(feature).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), mean.alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = per.select(feature, group, F.col("n").alias("gn"), "m").join(tot.select(feature, "mean"), feature).groupBy(feature).agg(F.sum(F.col("gn") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    f = (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return tot.join(between, feature).filter("groups >= 2").select(feature, F.col("n").cast("long").alias("n"), F.col("groups").cast("long").alias("groups"), f.alias("f")).withColumn("effect", F.greatest(dbl(0), F.col("f") / (F.col("n") - 1)))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.groupBy(row, col).agg(F.count("*").alias("n"))


def chi2(df: DataFrame, row: str, col: str, yates: bool = True) -> DataFrame:
    """One row: chi2, dof, n, cramers_v; Yates' correction for one degree of freedom."""
    cells = contingency(df, row, col)
    rows, cols = cells.groupBy(row).agg(F.sum("n").alias("rn")), cells.groupBy(col).agg(F.sum("n").alias("cn"))
    # All cells, empty ones too; both sides are the levels of a category.
    full = rows.crossJoin(F.broadcast(cols)).join(cells, [row, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.broadcast(cells.agg(F.sum("n").alias("total"), F.countDistinct(row).alias("_r"), F.countDistinct(col).alias("_c")))
    full = full.crossJoin(size).withColumn("e", F.col("rn").cast("double") * F.col("cn") / F.col("total"))
    gap = F.abs(F.col("n") - F.col("e"))
    fixed = F.when((F.col("_r") == 2) & (F.col("_c") == 2) & F.lit(yates), F.greatest(dbl(0), gap - F.least(dbl(0.5), gap))).otherwise(gap)
    out = full.groupBy("total", "_r", "_c").agg(F.sum(fixed * fixed / F.col("e")).alias("chi2"))
    return out.select("chi2", ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("long").alias("dof"), F.col("total").cast("long").alias("n"), F.sqrt(F.col("chi2") / (F.col("total") * (F.least("_r", "_c") - 1))).alias("cramers_v"))


def bh(df: DataFrame, p: str = "p_value", key: str = "feature") -> DataFrame:
    """p_adj = min(1, p n / rank), and p_adj_bh made monotone. One row for each feature, so small."""
    over = Window.partitionBy(F.lit(0)).orderBy(p, key)
    ranked = df.withColumn("_rank", F.row_number().over(over)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    adjusted = ranked.withColumn("p_adj", F.least(dbl(1), F.col(p) * F.col("_n") / F.col("_rank")))
    return adjusted.withColumn("p_adj_bh", F.min("p_adj").over(over.rowsBetween(0, Window.unboundedFollowing))).drop("_rank", "_n")


def brown_forsythe(long: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value", least: int = 3) -> DataFrame:
    """ANOVA's F on distances from the group's exact median."""
    med = quantiles(long, [feature, group], value, {"_med": 0.5})
    away = long.join(med, [feature, group]).withColumn("_away", F.abs(F.col(value) - F.col("_med")))
    return anova(away, feature, group, "_away", least)


def residuals(long: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value") -> DataFrame:
    means = long.groupBy(feature, group).agg(F.avg(value).alias("_m"))
    return long.join(means, [feature, group]).withColumn("residual", F.col(value) - F.col("_m")).drop("_m")


@F.pandas_udf(StructType([StructField("m", DoubleType()), StructField("mm", DoubleType())]))
def _scores(before: pd.Series, ties: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the normal scores, and of their squares, of the ranks before + 1 to before + ties."""
    first, count, size = (v.to_numpy(dtype=float) for v in (before, ties, n))
    z_of = lambda rank, size: special.norm_ppf_array((rank - 0.375) / (size + 0.25))
    out, upto, at = np.zeros((len(count), 2)), np.cumsum(count), 0
    while at < len(count):
        # As many rows as make up SCORES ranks; a row of more ranks goes through them in pieces.
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + SCORES, "right")))
        if end == at + 1:
            for i in range(0, int(count[at]), SCORES):
                z = z_of(first[at] + np.arange(i + 1, min(i + SCORES, int(count[at])) + 1), size[at])
                out[at] += z.sum(), (z * z).sum()
        else:
            own = count[at:end].astype(int)
            begin = np.cumsum(own) - own
            z = z_of(np.arange(1, own.sum() + 1) + np.repeat(first[at:end] - begin, own), np.repeat(size[at:end], own))
            out[at:end] = np.stack([np.add.reduceat(z, begin), np.add.reduceat(z * z, begin)], axis=1)
        at = end
    return pd.DataFrame(out, columns=["m", "mm"])


@F.pandas_udf(StructType([StructField("w", DoubleType()), StructField("p_value", DoubleType())]))
def _royston(n: pd.Series, mm: pd.Series, mx: pd.Series, x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series, ss: pd.Series) -> pd.DataFrame:
    rows = zip(n, mm, mx, x1, x2, y2, y1, ss)
    return pd.DataFrame([special.shapiro_from_sums(*r) if r[0] >= 3 and r[3] < r[6] else (None, None) for r in rows], columns=["w", "p_value"], dtype=float)


def shapiro(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, w, p_value) over all values of each feature, null below 3 of them or where all are
    equal. W comes from running counts over distinct values; beyond 5000 values Royston's
    approximation of the p-value is carried on."""
    r = running(long.select(feature, value), [feature], value, {"m": F.lit(1)})
    r = r.withColumn("s", _scores("m_before", "m", "m_all"))
    held = lambda k: F.max(F.when((F.col("m_before") < k) & (k <= F.col("m_before") + F.col("m")), F.col(value)))
    n = F.col("m_all")
    per = r.groupBy(feature).agg(
        F.max("m_all").alias("n"), F.sum("s.mm").alias("mm"), F.sum(F.col("s.m") * F.col(value)).alias("mx"),
        held(F.lit(1)).alias("x1"), held(F.lit(2)).alias("x2"), held(n - 1).alias("y2"), held(n).alias("y1"))
    spread = long.groupBy(feature).agg((F.var_pop(value) * F.count("*")).alias("ss"))
    told = per.join(spread, feature).withColumn("t", _royston(*(F.col(c).cast("double") for c in ("n", "mm", "mx", "x1", "x2", "y2", "y1", "ss"))))
    return told.select(feature, "t.w", "t.p_value")


def assumptions(long: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value", alpha: float = 0.05) -> DataFrame:
    """(feature, shapiro_p, levene_p, normal, equal_variance): what an analysis of variance assumes,
    by Shapiro-Wilk on its residuals and by Brown-Forsythe."""
    normal = shapiro(residuals(long, feature, group, value), feature, "residual").select(feature, F.col("p_value").alias("shapiro_p"))
    spread = brown_forsythe(long, feature, group, value).select(feature, f_sf("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")).alias("levene_p"))
    return normal.join(spread, feature, "full").select(feature, "shapiro_p", "levene_p", (F.col("shapiro_p") > alpha).alias("normal"), (F.col("levene_p") > alpha).alias("equal_variance"))


def eligible(df: DataFrame, skip: set[str]) -> list[str]:
    """Numeric columns outside ``skip``, by the schema; booleans count."""
    from pyspark.sql.types import BooleanType, NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in skip]


def effects(df: DataFrame, group: str, skip: set[str], use_anova: bool = False, alpha: float = 0.05) -> DataFrame:
    """feature, effect, p_value, test, p_adj, p_adj_bh, sig: chi-squared with Cramer's V for columns
    of 0 and 1, else Kruskal-Wallis or ANOVA; columns with one value are left out."""
    columns = eligible(df, skip | {group})
    long = melt(df.withColumn("_id", F.lit(0)).withColumn("grp", F.col(group)), "_id", columns, "grp")
    kinds = long.groupBy("feature").agg(F.max((~F.col("value").isin(0.0, 1.0)).cast("int")).alias("wide"), (F.max("value") > F.min("value")).alias("varies")).filter("varies")
    numeric = long.join(kinds.filter("wide = 1").select("feature"), "feature", "left_semi")
    binary = long.join(kinds.filter("wide = 0").select("feature"), "feature", "left_semi")
    if use_anova:
        tested = anova(numeric).select("feature", "effect", f_sf("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")).alias("p_value"), F.lit("anova").alias("test"))
    else:
        tested = kruskal(numeric).select("feature", "effect", chi2_sf("h", (F.col("groups") - 1).cast("double")).alias("p_value"), F.lit("kruskal").alias("test"))
    cells = binary.groupBy("feature", "grp").agg(F.sum("value").alias("k"), F.count("*").alias("gn"))
    tot = cells.groupBy("feature").agg(F.sum("k").alias("hits"), F.sum("gn").alias("rows"), F.count("*").alias("groups"))
    cell = cells.join(tot, "feature").withColumn("e", F.col("gn") * F.col("hits") / F.col("rows"))
    gap = F.abs(F.col("k") - F.col("e"))
    gap = F.when(F.col("groups") == 2, gap - F.least(dbl(0.5), gap)).otherwise(gap)
    chi = cell.groupBy("feature", "rows", "groups").agg(F.sum(gap * gap * (1 / F.col("e") + 1 / (F.col("gn") - F.col("e")))).alias("x"))
    tested = tested.unionByName(chi.filter("groups >= 2").select("feature", F.sqrt(F.col("x") / F.col("rows")).alias("effect"), chi2_sf("x", (F.col("groups") - 1).cast("double")).alias("p_value"), F.lit("chi2").alias("test")))
    return bh(tested.filter("p_value IS NOT NULL")).withColumn("sig", F.col("p_adj") < alpha)

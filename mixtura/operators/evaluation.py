"""Evaluation of class probabilities: ROC, strict AUC, signed information, accuracy, McNemar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mixtura.functions import special
from mixtura.functions.vec import dbl, safe_log
from mixtura.operators.ranking import running


@F.pandas_udf(DoubleType())
def midp(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([special.mcnemar_midp(x, y) for x, y in zip(b, c)], dtype=float)


def roc_points(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(p, fpr, tpr) for each threshold "score >= p", from running counts over distinct scores."""
    r = running(df.select(p, y), [], p, {"pos": (F.col(y) == 1).cast("long"), "neg": (F.col(y) == 0).cast("long")})
    at_least = lambda n: (F.col(f"{n}_all") - F.col(f"{n}_before")).cast("double") / F.col(f"{n}_all")
    return r.select(p, at_least("neg").alias("fpr"), at_least("pos").alias("tpr"))


def auc_strict(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """auc: the share of (positive, negative) pairs with the positive strictly higher; ties count 0."""
    r = running(df.select(p, y), [], p, {"pos": (F.col(y) == 1).cast("long"), "neg": (F.col(y) == 0).cast("long")})
    return r.agg((F.sum(F.col("pos").cast("double") * F.col("neg_before")) / (F.max("pos_all").cast("double") * F.max("neg_all"))).alias("auc"))


def _prior(df: DataFrame, y: str) -> DataFrame:
    return F.broadcast(df.agg(F.avg(F.col(y).cast("double")).alias("_prior")))  # one row


def information(df: DataFrame, p: str = "p", y: str = "y", wrong: str = "negate") -> DataFrame:
    """shannon: mean KL divergence in bits of each posterior from the prior; of misclassified rows
    negated, or 0 with ``wrong='zero'``."""
    q, prior = F.col(p), F.col("_prior")
    term = lambda a, b: F.when(a <= 0, dbl(0)).otherwise(a * (F.log2(a) - F.log2(b)))
    kl = term(q, prior) + term(1 - q, 1 - prior)
    right = (q > 0.5).cast("int") == F.col(y)
    return df.select(p, y).crossJoin(_prior(df, y)).agg(F.avg(F.when(right, kl).otherwise(-kl if wrong == "negate" else dbl(0))).alias("shannon"))


def accuracy(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: accuracy and majority_accuracy in percent, the discordant counts b and c, p_value."""
    guess = (F.col(p) > 0.5).cast("int") == F.col(y)
    default = F.when(F.col("_prior") < 0.5, F.lit(0)).otherwise(F.lit(1)) == F.col(y)
    one = df.select(p, y).crossJoin(_prior(df, y)).agg(
        (F.avg(guess.cast("double")) * 100).alias("accuracy"), (F.avg(default.cast("double")) * 100).alias("majority_accuracy"),
        F.sum((guess & ~default).cast("long")).alias("b"), F.sum((~guess & default).cast("long")).alias("c"))
    return one.withColumn("p_value", midp(F.col("b").cast("double"), F.col("c").cast("double")))


def evaluate(df: DataFrame, method: str, p: str = "p", y: str = "y") -> DataFrame:
    """A row for the metric store: mthd, auc, acc, pval, shannon. Its curve is ``roc_table``."""
    one = auc_strict(df, p, y).crossJoin(accuracy(df, p, y).select(F.col("accuracy").alias("acc"), F.col("p_value").alias("pval"))).crossJoin(information(df, p, y))  # one row each
    return one.select(F.lit(method).alias("mthd"), "auc", "acc", "pval", "shannon")


def evaluate_all(df: DataFrame, method: str = "mthd", p: str = "p", y: str = "y") -> DataFrame:
    """The metric store's rows (mthd, auc, acc, pval, shannon) of many methods at once: ``df`` has the
    held-out chances of each. All methods share each job; none is a group of one task."""
    df = df.select(F.col(method).alias("mthd"), F.col(p).alias("p"), F.col(y).alias("y"))
    r = running(df, ["mthd"], "p", {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") == 0).cast("long")})
    auc = r.groupBy("mthd").agg((F.sum(F.col("pos").cast("double") * F.col("neg_before")) / (F.max("pos_all").cast("double") * F.max("neg_all"))).alias("auc"))
    prior = F.broadcast(df.groupBy("mthd").agg(F.avg(F.col("y").cast("double")).alias("b")))  # a row for each method
    term = lambda u, v: F.when(u <= 0, dbl(0)).otherwise(u * (F.log2(u) - F.log2(v)))
    kl = term(F.col("p"), F.col("b")) + term(1 - F.col("p"), 1 - F.col("b"))
    right, default = (F.col("p") > 0.5).cast("int") == F.col("y"), F.when(F.col("b") < 0.5, F.lit(0)).otherwise(F.lit(1)) == F.col("y")
    rest = df.join(prior, "mthd").groupBy("mthd").agg((F.avg(right.cast("double")) * 100).alias("acc"), F.sum((right & ~default).cast("double")).alias("won"), F.sum((~right & default).cast("double")).alias("lost"), F.avg(F.when(right, kl).otherwise(-kl)).alias("shannon"))
    return auc.join(rest, "mthd").select("mthd", "auc", "acc", midp("won", "lost").alias("pval"), "shannon")


def roc_table(df: DataFrame, method: str, p: str = "p", y: str = "y") -> DataFrame:
    """(mthd, p, rocx, rocy): a row for each threshold."""
    return roc_points(df, p, y).select(F.lit(method).alias("mthd"), F.col(p).alias("p"), F.col("fpr").alias("rocx"), F.col("tpr").alias("rocy"))


def majority(df: DataFrame, y: str = "y") -> DataFrame:
    """label, n, prior of the most frequent class, the smallest of equals."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(F.struct(F.col(y).alias("label"), "n"), F.struct("n", -F.col(y))).alias("m"), F.sum("n").alias("total")).select("m.label", "m.n", (F.col("m.n") / F.col("total").cast("double")).alias("prior"))


def loglik(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """loglik: sum of the log probability given to the true class."""
    return df.agg(F.sum(safe_log(F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p)))).alias("loglik"))


def folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """``fold`` for each row, stratified: the rows of a class are dealt in turn, in the order of a hash
    of their key, so folds of a class differ by one row at most. Ranks come from running counts. Rows
    without label are a class of their own."""
    rows = df.withColumns({"_h": F.xxhash64(key, label), "_l": F.xxhash64(F.col(label).isNull(), label)})
    r = running(rows.select("_l", "_h"), ["_l"], "_h", {"_m": F.lit(1)}).select("_l", "_h", "_m_before")
    tied = Window.partitionBy("_l", "_h").orderBy(key)
    at = F.col("_m_before") + F.row_number().over(tied) - 1
    return rows.join(r, ["_l", "_h"]).withColumn("fold", F.pmod(at, F.lit(k)).cast("int")).select(*df.columns, "fold")


def store_legend(store: DataFrame) -> DataFrame:
    from mixtura.functions.vec import stars

    return store.select("mthd", F.format_string("%s (AUC %.3f, acc %.2f%% %s)", "mthd", "auc", "acc", stars("pval")).alias("legend"))

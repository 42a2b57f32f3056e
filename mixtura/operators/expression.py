"""An expression set: long values (feature_id, sample_id, v), feature and sample annotation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """The three tables do not fit each other."""


@dataclass(frozen=True)
class ExpressionSet:
    exprs: DataFrame
    fdata: DataFrame
    pdata: DataFrame

    def checked(self) -> ExpressionSet:
        for key, side in (("feature_id", self.fdata), ("sample_id", self.pdata)):
            if not self.exprs.select(key).distinct().join(side, key, "left_anti").isEmpty():
                raise ExpressionError(f"values without annotation of their {key}")
        return self

    def subset(self, features: DataFrame | None = None, samples: DataFrame | None = None) -> ExpressionSet:
        """Only the features and samples in the given key tables."""
        e, f, p = self.exprs, self.fdata, self.pdata
        if features is not None:
            e, f = e.join(features, "feature_id", "left_semi"), f.join(features, "feature_id", "left_semi")
        if samples is not None:
            e, p = e.join(samples, "sample_id", "left_semi"), p.join(samples, "sample_id", "left_semi")
        return ExpressionSet(e, f, p)

    def updated(self, values: DataFrame) -> ExpressionSet:
        """With the values of (feature_id, sample_id, v) put in place of its own."""
        new = values.select("feature_id", "sample_id", F.col("v").alias("_new"))
        return ExpressionSet(self.exprs.join(new, ["feature_id", "sample_id"], "left").withColumn("v", F.coalesce("_new", "v")).drop("_new"), self.fdata, self.pdata)

    def labelled(self, features: list, labels: list[str]) -> DataFrame:
        """Samples by features, with label columns of the sample annotation."""
        wide = self.exprs.groupBy("sample_id").agg(*(F.max(F.when(F.col("feature_id") == f, F.col("v"))).alias(f"f{f}") for f in features))
        return wide.join(self.pdata.select("sample_id", *labels), "sample_id")

    def save(self, base: str, power: bool = True) -> None:
        values = self.exprs.withColumn("v", F.pow(F.lit(2.0), "v")) if power else self.exprs
        values.write.parquet(f"{base}/exprs")
        self.fdata.write.parquet(f"{base}/fdata")
        self.pdata.write.parquet(f"{base}/pdata")


def load(spark: SparkSession, base: str, log: bool = True) -> ExpressionSet:
    """Values are kept as log2; with ``log=False`` as they are stored."""
    read = lambda n: spark.read.parquet(f"{base}/{n}")
    values = read("exprs")
    return ExpressionSet(values.withColumn("v", F.log2("v")) if log else values, read("fdata"), read("pdata")).checked()


#: Endings of the three text files of a set.
DATA, FEATURES, SAMPLES = "_AMP_data.csv", "_features.csv", "_pheno.csv"


def load_text(spark: SparkSession, base: str, log: bool = True, sep: str = "\t") -> ExpressionSet:
    """A set from its three text files. The first column of each holds the keys; where the header lacks
    its name, the names stand one place further left. Values are a feature a line, a sample a column."""

    def table(ending: str) -> tuple[list[str], DataFrame]:
        # The first line of each file is its header; a data line may well read like one.
        first = [r.value.split(sep) for r in spark.read.text(base + ending).head(2)]
        names = first[0]
        width = len(first[1]) if len(first) > 1 else len(names)
        names = names[1:] if width == len(names) else names
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        rows = spark.read.csv(base + ending, sep=sep, header=True, schema=schema, quote="", emptyValue="", nullValue="\0")
        return names, rows.select(F.array(*rows.columns).alias("p"))

    names, parts = table(DATA)
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("sample_id"), F.expr(f"try_cast(p[{i}] AS double)").alias("v")) for i, n in enumerate(names, 1))))
    values = parts.select(F.col("p")[0].alias("feature_id"), cells.alias("c")).select("feature_id", "c.sample_id", F.col("c.v").alias("v"))
    sides = []
    for ending, key in ((FEATURES, "feature_id"), (SAMPLES, "sample_id")):
        names, parts = table(ending)
        sides.append(parts.select(F.col("p")[0].alias(key), *(F.col("p")[i].alias(n) for i, n in enumerate(names, 1))))
    return ExpressionSet(values.withColumn("v", F.log2("v")) if log else values, *sides).checked()


def save_text(e: ExpressionSet, base: str, samples: list[str], power: bool = True, sep: str = "\t") -> None:
    """Folders with the three tables as text with full headers; ``samples`` gives the order of the columns."""
    values = e.exprs.withColumn("v", F.pow(F.lit(2.0), "v")) if power else e.exprs
    wide = values.groupBy("feature_id").agg(*(F.max(F.when(F.col("sample_id") == s, F.col("v"))).alias(s) for s in samples))
    for df, ending in ((wide, DATA), (e.fdata, FEATURES), (e.pdata, SAMPLES)):
        df.write.csv(base + ending, header=True, sep=sep)

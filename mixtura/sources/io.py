"""Sources and sinks: feature tables, embeddings, lookups, column lists, allocations, metric stores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Base:
    """Paths under one folder, passed on as a value rather than kept in a global."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def csv(self, name: str, schema: str | StructType, header: bool = True, sep: str = ",") -> DataFrame:
        return self.spark.read.csv(self.path(name), schema=schema, header=header, sep=sep, nullValue="", nanValue="NaN")

    def lookup(self, name: str, schema: str) -> DataFrame:
        """A tab-separated category table, codes trimmed."""
        df = self.csv(name, schema, sep="\t")
        return df.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))

    def column_list(self, name: str) -> list[str]:
        """Names of a short text file, parted by commas."""
        rows = self.spark.read.text(self.path(name), wholetext=True).collect()
        return [c.strip() for r in rows for c in r.value.split(",") if c.strip()]

    def words(self, name: str) -> DataFrame:
        return self.spark.read.text(self.path(name)).select(F.trim("value").alias("word")).filter("word <> ''")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here, as null is."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def extract(df: DataFrame, id_col: str, columns: list[str] = (), drop: bool = False, y: str | None = None, labels: list[str] = ()) -> DataFrame:
    """id, x (array<double>) and y. Keep mode takes exactly ``columns``; drop mode, and an empty list,
    take all numeric columns but the id, the labels and (in drop mode) ``columns``."""
    if columns and not drop:
        chosen = list(columns)
    else:
        out = {id_col, *labels, *([y] if y else []), *(columns if drop else [])}
        chosen = [c for c, t in df.dtypes if c not in out and t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or c not in out and t.startswith("decimal")]
    x = F.array(*(F.col(c).cast("double") for c in chosen))
    return df.select(F.col(id_col).alias("id"), x.alias("x"), *([F.col(y).alias("y")] if y and y in df.columns else []))


def embeddings(df: DataFrame, id_col: str, y: str, prob: str | None = None, prefix: str = "emb_", width: int = 512) -> DataFrame:
    """id, y and x of the embedding columns that are there, or p of the probability column."""
    if prob:
        return df.select(F.col(id_col).alias("id"), F.col(y).alias("y"), F.col(prob).cast("double").alias("p"))
    chosen = [f"{prefix}{i}" for i in range(width) if f"{prefix}{i}" in df.columns]
    return df.select(F.col(id_col).alias("id"), F.col(y).alias("y"), F.array(*(F.col(c).cast("double") for c in chosen)).alias("x"))


def write_allocations(df: DataFrame, path: str, id_col: str = "id", rows: int | None = None) -> None:
    """(id, label, q); a row without assignment is an error, and so is another number of ``rows``."""
    n, empty = df.agg(F.count("*"), F.count_if(F.col("q").isNull())).first()
    if empty or rows not in (None, n):
        raise ValueError(f"{empty} of {n} rows without assignment, {rows} rows expected")
    df.select(id_col, "label", "q").write.parquet(path)


def read_allocations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("int"))


def renamed_either(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns that come under one of several names under a common one; the first that is there counts."""
    found = {next((c for c in old if c in df.columns), None): new for new, old in names.items() if new not in df.columns}
    return df.withColumnsRenamed({old: new for old, new in found.items() if old})


def mentions(column: str, words: list[str]) -> Column:
    """Whether a text holds any of the words, in either case."""
    return reduce(or_, (F.lower(column).contains(w.lower()) for w in words), F.lit(False))


def read_metrics(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """The metric store, of some methods only where given."""
    df = spark.read.parquet(path)
    return df if methods is None else df.filter(F.col("mthd").isin(methods))


def append_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)

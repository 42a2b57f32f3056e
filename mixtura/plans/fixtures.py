"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtura.functions.vec import as_double, dbl, literal, softmax, sqdist

#: Sharpness of the soft assignments.
TAU = 0.5


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", as_double("embedding").alias("x"))


def emb_long(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, feature, grp, value)."""
    return emb(spark, d).select("vec_id", F.col("label").alias("grp"), F.posexplode("x").alias("feature", "value"))


def centroids(spark: SparkSession, d: str) -> np.ndarray:
    """Mean vector of each label: K x D numbers."""
    rows = emb_long(spark, d).groupBy("grp", "feature").agg(F.avg("value").alias("m")).collect()
    labels = sorted({r.grp for r in rows})
    out = np.zeros((len(labels), 1 + max((r.feature for r in rows), default=-1)))
    for r in rows:
        out[labels.index(r.grp), r.feature] = r.m
    return out


def scores_to_centroids(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("vec_id", "label", "x", F.array(*(dbl(-TAU) * sqdist("x", literal(c)) for c in centroids(spark, d))).alias("s"))


def qin(spark: SparkSession, d: str) -> DataFrame:
    return scores_to_centroids(spark, d).select("vec_id", "label", softmax("s").alias("q"))


def emb_missing(spark: SparkSession, d: str) -> DataFrame:
    """One cell of every seventh vector missing."""
    hole = lambda v, i: F.when((F.col("vec_id") % 7 == 0) & (i == F.col("vec_id") % 64), F.lit(None).cast("double")).otherwise(v)
    return emb(spark, d).withColumn("x", F.transform("x", hole))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, y, p): quality, and a logistic of the standardised length."""
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    stats = rows.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return rows.crossJoin(F.broadcast(stats)).select("doc_id", "y", (1 / (1 + F.exp(-(F.col("n_chars") - F.col("m")) / F.col("s")))).alias("p"))  # one row of statistics


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """(feature, metric, v): four importance-like figures of each embedding dimension."""
    per = emb_long(spark, d).groupBy(F.concat(F.lit("f"), F.col("feature").cast("string")).alias("feature")).agg(
        F.avg(F.abs("value")).alias("gini"), F.stddev_pop("value").alias("entropy"), F.max("value").alias("bayes_logodds"), F.exp(-F.avg(F.col("value") * F.col("value"))).alias("SVC_McNemar"))
    names = ["gini", "entropy", "bayes_logodds", "SVC_McNemar"]
    return per.select("feature", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names))).alias("x")).select("feature", "x.*")


#: The same inputs for DuckDB, as common table expressions.
SQL = {
    "lng": "lng AS (SELECT vec_id, label AS grp, generate_subscripts(embedding, 1) - 1 AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "cent": "cent AS (SELECT grp AS k, feature, avg(value) AS c, count(*) AS n FROM lng GROUP BY ALL)",
    "d2": "d2 AS (SELECT vec_id, grp AS label, k, sum((value - c) * (value - c)) AS d FROM lng JOIN cent USING (feature) GROUP BY ALL)",
    "qin": f"ex AS (SELECT vec_id, label, k, exp(CAST(-{TAU} AS DOUBLE) * (d - min(d) OVER (PARTITION BY vec_id))) AS e FROM d2), qin AS (SELECT vec_id, label, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)",
    "scores": "raw AS (SELECT l.doc_id, quality AS y, CAST(n_chars AS DOUBLE) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id), scores AS (SELECT doc_id, y, 1 / (1 + exp(-(n - avg(n) OVER ()) / stddev_pop(n) OVER ())) AS p FROM raw)",
    "metrics": "per AS (SELECT 'f' || feature AS feature, avg(abs(value)) AS gini, stddev_pop(value) AS entropy, max(value) AS bayes_logodds, exp(-avg(value * value)) AS \"SVC_McNemar\" FROM lng GROUP BY ALL), metrics AS (SELECT feature, 'gini' AS metric, gini AS v FROM per UNION ALL SELECT feature, 'entropy', entropy FROM per UNION ALL SELECT feature, 'bayes_logodds', bayes_logodds FROM per UNION ALL SELECT feature, 'SVC_McNemar', \"SVC_McNemar\" FROM per)",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([SQL[n] for n in names] + ([more] if more else [])) + " "

"""PCA, k-means sweeps with their criteria, Gaussian mixture responsibilities.

Rows carry ``x`` (array<double>). Each pass returns sufficient statistics only; the algebra on
D x D matrices is done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtura.functions.vec import argmax, dbl, literal, softmax, sqdist
from mixtura.operators.blocks import silhouettes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, parts, size: int) -> np.ndarray:
    """The sum over all rows of the vectors that ``parts`` makes of record batches; partial sums are
    added up by Spark, place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                acc += parts(batch)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "v": pa.array(acc)})

    out = np.zeros(size)
    for r in df.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out


def moments(df: DataFrame, x: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and population covariance, in one pass."""
    d = df.select(F.size(x)).first()
    if d is None:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    d = d[0]

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        m = _matrix(batch.column(0))
        return np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])

    v = summed(df.select(x), parts, 1 + d + d * d)
    mean = v[1 : 1 + d] / v[0]
    return v[0], mean, v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean)


class Pca:
    """Components by falling variance; the largest loading of each is positive."""

    def __init__(self, df: DataFrame, x: str = "x"):
        self.n, self.mean, cov = moments(df, x)
        values, vectors = np.linalg.eigh(cov)
        order = values.argsort()[::-1]
        vectors = vectors[:, order].T
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
        self.components, self.variance = vectors * signs[:, None], np.maximum(values[order], 0) * self.n / max(1, self.n - 1)

    def spectrum(self, spark: SparkSession) -> DataFrame:
        """(component, variance, ratio, cumulative)."""
        ratio = self.variance / self.variance.sum()
        rows = [(i, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(self.variance, ratio, ratio.cumsum()))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")

    def count_upto(self, share: float = 0.975) -> int:
        return int((self.variance.cumsum() / self.variance.sum() <= share).sum())

    def transform(self, df: DataFrame, k: int, x: str = "x", whiten: bool = False) -> DataFrame:
        w = self.components[:k] / (np.sqrt(np.maximum(self.variance[:k], 1e-300))[:, None] if whiten else 1)
        mean = self.mean

        @F.pandas_udf("array<double>")
        def projected(col: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(col.to_numpy()) - mean) @ w.T)) if len(col) else pd.Series([], dtype=object)

        return df.withColumn(x, projected(x))


def nearest_center(x: str, centers: np.ndarray):
    """(distance squared, 0-based place) of the nearest of fixed centres."""
    d = F.array(*(sqdist(x, literal(c)) for c in centers))
    return F.array_min(d), (F.array_position(d, F.array_min(d)) - 1).cast("int")


def kmeans_criteria(df: DataFrame, centers: np.ndarray, x: str = "x") -> DataFrame:
    """One row: llh, aic, bic, sumdist for fixed centres; llh is minus the summed squared distances
    plus the entropy of the sizes."""
    d, at = nearest_center(x, centers)
    per = df.select(d.alias("d"), at.alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    tot = per.agg(F.sum("n").alias("rows"), F.sum("s").alias("sumdist"))
    llh = per.crossJoin(F.broadcast(tot.select("rows"))).agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("rows"))).alias("e"))  # one row
    p = float(np.asarray(centers).size)
    out = tot.crossJoin(llh).withColumn("llh", -F.col("sumdist") + F.col("e"))
    return out.select("llh", (F.col("llh") - dbl(p)).alias("aic"), (F.col("llh") - dbl(0.5 * p) * F.log(F.col("rows"))).alias("bic"), "sumdist")


def silhouette(df: DataFrame, centers: np.ndarray, x: str = "x") -> DataFrame:
    """One row: the mean of 1 - a / b, with a and b a row's distances to the nearest centre and the next."""
    d = F.array_sort(F.array(*(F.sqrt(sqdist(x, literal(c))) for c in centers)))
    near, far = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    return df.agg(F.avg(F.when(far > 0, 1 - near / far).otherwise(dbl(0))).alias("silhouette"))


def calinski_harabasz(df: DataFrame, label: str, x: str = "x") -> DataFrame:
    """One row: ch, from per-cluster sums."""
    long = df.select(F.col(label).alias("k"), F.posexplode(x).alias("dim", "v"))
    per = long.groupBy("k", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    mean = per.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    j = per.join(mean, "dim").agg(F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"), F.countDistinct("k").alias("K"), (F.sum("n") / F.countDistinct("dim")).alias("N"))
    return j.select(((F.col("between") / (F.col("K") - 1)) / (F.col("within") / (F.col("N") - F.col("K")))).alias("ch"))


def kmeans_sweep(df: DataFrame, ks: list[int], repeats: int, x: str = "x", seed: int = 1, max_iter: int = 20, exact: bool = False) -> DataFrame:
    """(k, seed, llh, aic, bic, sumdist, silhouette, ch) for fits of each size; the rows are cached over
    the sweep. The silhouette is the simplified one, by distances to centres, in one pass; with ``exact``
    it is the mean over all pairs of rows, by tiles. Null for one centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(x).alias("features"), x, F.monotonically_increasing_id().alias("_id")).cache()

    def measured(data: DataFrame, centers: np.ndarray) -> float | None:
        if not exact:
            return silhouette(data, centers, x).first()[0]
        return silhouettes(data.select("_id", x, nearest_center(x, centers)[1].alias("_at")), "_id", "_at", x).agg(F.avg("silhouette")).first()[0]

    rows = []
    for k in ks:
        for r in range(repeats):
            # One centre is the mean, which the built-in fit does not take.
            centers = moments(data, x)[1][None] if k == 1 else np.array(KMeans(k=k, seed=seed + r, maxIter=max_iter).fit(data).clusterCenters())
            one = kmeans_criteria(data, centers, x).first()
            rest = (None, None) if len(centers) < 2 else (measured(data, centers), calinski_harabasz(data.withColumn("_at", nearest_center(x, centers)[1]), "_at", x).first()[0])
            rows.append((k, seed + r, *map(float, one), *rest))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, seed int, llh double, aic double, bic double, sumdist double, silhouette double, ch double")


def best_models(sweep: DataFrame) -> DataFrame:
    """(criterion, k, seed, value): the first best by aic and by bic."""
    pick = lambda c: sweep.agg(F.max_by(F.struct("k", "seed", F.col(c).alias("value")), F.struct(c, -F.col("k"), -F.col("seed"))).alias("m")).select(F.lit(c).alias("criterion"), "m.*")
    return pick("aic").unionByName(pick("bic"))


def responsibilities(df: DataFrame, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, kind: str = "full", x: str = "x") -> DataFrame:
    """``df`` with ``q``: posterior chances of each component; kinds full, tied, diag, spherical."""
    means = np.asarray(means, dtype=float)
    k, d = means.shape
    if kind not in ("full", "tied", "diag", "spherical"):
        raise ValueError(f"unknown covariance kind {kind!r}")
    if kind in ("diag", "spherical"):
        covariances, kind = np.array([np.diag(np.broadcast_to(np.asarray(covariances[i], dtype=float), d)) for i in range(k)]), "full"
    # K x D x D numbers: better as matrix products on Arrow batches than as literals.
    roots = np.array([np.linalg.cholesky(np.linalg.inv(covariances[i] if kind == "full" else covariances)) for i in range(k)])
    const = np.log(weights) - d / 2 * np.log(2 * np.pi) + np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)

    @F.pandas_udf("array<double>")
    def log_joint(col: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype=object)
        m = np.stack(col.to_numpy())
        parts = [const[i] - 0.5 * (((m - means[i]) @ roots[i]) ** 2).sum(axis=1) for i in range(k)]
        return pd.Series(list(np.stack(parts, axis=1)))

    return df.withColumn("q", softmax(log_joint(x)))


def assign(df: DataFrame, q: str = "q") -> DataFrame:
    return df.withColumn("cluster", argmax(q))

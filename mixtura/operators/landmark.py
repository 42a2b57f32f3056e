"""Kernel machines over any number of rows, through landmark (Nystroem) features.

A kernel's features are its values at m landmarks, whitened by the kernel among the landmarks. With
every row a landmark they give the full kernel's own results; with fewer they give its best stand-in in
their span. A pass over the rows returns sums of m or m x m numbers for every fold and grid point
together; the algebra on them is done on the driver, and ``m`` and the grid bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.operators.evaluation import folds
from mixtura.operators.sums import lbfgs, matrix, summed

#: Rows whose features are held at once.
ROWS = 1024


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def landmarks(df: DataFrame, m: int, gamma: float, id_col: str = "id", x: str = "x") -> np.ndarray:
    """At most ``m`` rows of ``x``: all rows where there are no more, else drawn by leverage in one pass.

    A row's leverage is what the span of ``m`` rows in the order of a hash leaves of its kernel
    function; rows are drawn without replacement with such weights, by keys that follow from the id.
    """
    rows = df.select(F.xxhash64(F.lit(7), id_col).alias("h"), F.col(id_col).alias("id"), x)
    seed = rows.orderBy("h", "id").limit(m + 1).collect()  # m + 1 rows
    z = np.array([r[x] for r in seed[:m]], dtype=float)
    if len(seed) <= m:
        return z
    whiten = _whitener(z, gamma)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                xs = matrix(b.column(1))
                phis = (rbf(xs[at : at + ROWS], z, gamma) @ whiten for at in range(0, len(xs), ROWS))
                left = np.concatenate([np.clip(1 - (phi * phi).sum(axis=1), 1e-3, 1.0) for phi in phis])
                u = (b.column(0).to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
                yield pa.RecordBatch.from_arrays([pa.array(-np.log(u + 2.0**-54) / left), b.column(0), b.column(1)], ["key", "h", "x"])

    drawn = rows.select("h", F.col(x).cast("array<double>").alias("x")).mapInArrow(keys, "key double, h long, x array<double>").orderBy("key", "h", "x").limit(m).collect()  # m rows
    return np.array([r.x for r in drawn])


def _whitener(z: np.ndarray, gamma: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(rbf(z, z, gamma))
    held = values > 1e-10 * values.max()
    return vectors[:, held] / np.sqrt(values[held])


class Features:
    """Landmark features for each of some kernel widths, padded to one length, with a constant last."""

    def __init__(self, z: np.ndarray, gammas: list[float]):
        self.z, self.gammas, self.whiten = z, gammas, [_whitener(z, g) for g in gammas]
        self.p = max(w.shape[1] for w in self.whiten) + 1

    def __call__(self, x: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros((len(x), self.p))
        w = self.whiten[i]
        out[:, : w.shape[1]] = rbf(x, self.z, self.gammas[i]) @ w
        out[:, -1] = 1
        return out


def _good(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))


def fold_data(df: DataFrame, k: int, id_col: str, x: str, y: str) -> DataFrame:
    """(x, y, fold, id); rows without label, vector or finite components take no part."""
    dealt = folds(_good(df, x, y).select(F.col(id_col).alias("id"), x, y), "id", y, k)
    return dealt.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), "id")


def chances_of(data: DataFrame, chance, id_col: str) -> DataFrame:
    """(id, y, fold, p) with ``chance`` of (x, fold)."""
    kind = dict(data.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                p = chance(matrix(part.column(0)), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(3), pa.array(part.column(1).to_numpy().astype("i4")), part.column(2), pa.array(p)], [id_col, "y", "fold", "p"])

    return data.mapInArrow(run, f"{id_col} {kind}, y int, fold int, p double")


def _loglik(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(1e-100, np.where(y == 1, p, 1 - p)))


def logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def three_folds(k: int) -> None:
    if k < 3:
        raise ValueError("a choice inside each fold needs three folds at least")


def no_chances(data: DataFrame, id_col: str) -> DataFrame:
    return data.selectExpr(f"id as {id_col}", "cast(y as int) as y", "fold", "cast(null as double) as p")


def kernel_ridge(df: DataFrame, gammas: list[float], ridges: list[float], k: int = 5, m: int = 256, target: float = 4.0, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, y, fold, p): chances of class 1 by kernel ridge regression on +-``target``, one regression a
    class and a softmax of both, from models that have not seen the row.

    For each fold, width and ridge are chosen by the log-likelihood of every other fold under models
    that have seen neither. All sums of squares come from one pass: a fold's own are taken off the
    total. Three passes in all, for any number of rows. An empty table gives no rows.
    """
    if len(gammas) * len(ridges) > 1:
        three_folds(k)
    data = fold_data(df, k, id_col, x, y).persist()
    z = landmarks(data, m, gammas[len(gammas) // 2])
    if not len(z):
        return no_chances(data, id_col)
    feats = Features(z, gammas)
    p = feats.p - 1  # no constant: the regression has none

    def grams(b: pa.RecordBatch) -> np.ndarray:
        xs, t, fold = matrix(b.column(0)), np.where(b.column(1).to_numpy() == 1, target, -target), b.column(2).to_numpy()
        out = np.zeros((k, len(gammas), p, p + 1))
        for i in range(len(gammas)):
            phi = feats(xs, i)[:, :-1]
            for f in np.unique(fold):
                own = phi[fold == f]
                out[f, i, :, :p] += own.T @ own
                out[f, i, :, p] += own.T @ t[fold == f]
        return out

    g = summed(data, grams, (k, len(gammas), p, p + 1))
    total = g.sum(axis=0)
    solve = lambda s, i: np.stack([np.linalg.solve(s[i, :, :p] + r * np.eye(p), s[i, :, p]) for r in ridges], axis=1)
    # Weights without folds f and h, for each width, by ridge.
    w = {(f, h): np.stack([solve(total - g[f] - (g[h] if h != f else 0), i) for i in range(len(gammas))]) for f in range(k) for h in range(f, k)}
    chances = lambda s: logistic(2 * s)  # noqa: E731  the two classes' scores are each other's negatives
    of = lambda f, h: w[min(f, h), max(f, h)]

    def held_out(b: pa.RecordBatch) -> np.ndarray:
        xs, ys, fold = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
        out = np.zeros((k, len(gammas), len(ridges)))
        for i in range(len(gammas)):
            phi = feats(xs, i)[:, :-1]
            for h in np.unique(fold):
                own = fold == h
                for f in range(k):
                    if f != h:
                        out[f, i] += _loglik(chances(phi[own] @ of(f, h)[i]), ys[own, None]).sum(axis=0)
        return out

    best = [(0, 0)] * k
    if len(gammas) * len(ridges) > 1:
        scores = summed(data, held_out, (k, len(gammas), len(ridges)))
        best = [tuple(int(v) for v in np.unravel_index(s.argmax(), s.shape)) for s in scores]

    def chance(xs: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros(len(xs))
        for f in np.unique(fold):
            i, r = best[f]
            own = fold == f
            out[own] = chances(feats(xs[own], i)[:, :-1] @ of(f, f)[i][:, r])
        return out

    return chances_of(data, chance, id_col)


class Svm:
    """Support vector machines with squared hinge loss, a constant without penalty, and Platt's
    probabilities, for every fold left out and every pair of folds, at all grid points together."""

    def __init__(self, df: DataFrame, gammas: list[float], costs: list[float], k: int = 5, m: int = 128, id_col: str = "id", x: str = "x", y: str = "y", rounds: int = 60):
        three_folds(k)
        self.id_col, self.k, self.gammas, self.costs = id_col, k, gammas, costs
        self.data = fold_data(df, k, id_col, x, y).persist()
        z = landmarks(self.data, m, gammas[len(gammas) // 2])
        self.empty = not len(z)
        if self.empty:
            return
        self.feats = feats = Features(z, gammas)
        self.out = [(f, h) for f in range(k) for h in range(f, k)]
        nc, p = len(costs), feats.p
        # Models in the order of width, folds left out, cost.
        c = np.tile(np.array(costs), len(self.out))
        shut = np.repeat(np.array([[g not in pair for g in range(k)] for pair in self.out]), nc, axis=0)

        def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            per = w.reshape(len(gammas), -1, p)
            # Weights on the kernel's values, so that rows need not be whitened; gradients are, once summed.
            spans = [feats.whiten[i] @ per[i, :, : feats.whiten[i].shape[1]].T for i in range(len(gammas))]
            size = len(z) + 2

            def parts(b: pa.RecordBatch) -> np.ndarray:
                xs, s, fold = matrix(b.column(0)), np.where(b.column(1).to_numpy() == 1, 1.0, -1.0), b.column(2).to_numpy()
                res = np.zeros((len(gammas), per.shape[1], size))
                for i in range(len(gammas)):
                    near = rbf(xs, z, gammas[i])
                    lack = np.maximum(0, 1 - s[:, None] * (near @ spans[i] + per[i, :, -1])) * shut[:, fold].T
                    signed = lack * s[:, None]
                    res[i, :, :-2] = -2 * signed.T @ near
                    res[i, :, -2] = -2 * signed.sum(axis=0)
                    res[i, :, -1] = (lack * lack).sum(axis=0)
                return res

            raw = summed(self.data.select("x", "y", "fold"), parts, (len(gammas), per.shape[1], size))
            v = np.zeros((len(gammas), per.shape[1], p + 1))
            v[:, :, -2:] = raw[:, :, -2:]
            for i, white in enumerate(feats.whiten):
                v[i, :, : white.shape[1]] = raw[i, :, :-2] @ white
            free = per.copy()
            free[:, :, -1] = 0
            f = 0.5 * (free * free).sum(axis=2) + c * v[:, :, p]
            return f.ravel(), (free + c[:, None] * v[:, :, :p]).reshape(w.shape)

        self.w = lbfgs(value, np.zeros((len(gammas) * len(self.out) * nc, p)), rounds).reshape(len(gammas), len(self.out), nc, p)

    def platt(self, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) for each fold left out and grid point, fitted on the scores of the other folds by
        models that have not seen them; and their log-likelihoods."""
        k, feats, w, at = self.k, self.feats, self.w, {pair: i for i, pair in enumerate(self.out)}
        shape = (k, len(self.gammas), len(self.costs))
        ab = np.zeros((*shape, 2))
        ab[..., 0] = 1.0
        for _ in range(steps):

            def parts(b: pa.RecordBatch, ab: np.ndarray = ab) -> np.ndarray:
                xs, ys, fold = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
                res = np.zeros((*shape, 6))
                for i in range(shape[1]):
                    phi = feats(xs, i)
                    for h in np.unique(fold):
                        own = fold == h
                        t = ys[own, None]
                        for f in (f for f in range(k) if f != h):
                            s = phi[own] @ w[i, at[min(f, h), max(f, h)]].T
                            q = logistic(ab[f, i, :, 0] * s + ab[f, i, :, 1])
                            v = q * (1 - q)
                            res[f, i] += np.stack([x.sum(axis=0) for x in ((q - t) * s, q - t, v * s * s, v * s, v, _loglik(q, t))], axis=1)
                return res

            v = summed(self.data.select("x", "y", "fold"), parts, (*shape, 6))
            haa, hab, hbb = v[..., 2] + 1e-6, v[..., 3], v[..., 4] + 1e-6
            det = np.maximum(haa * hbb - hab * hab, 1e-12)
            move = np.stack([(hbb * v[..., 0] - hab * v[..., 1]) / det, (haa * v[..., 1] - hab * v[..., 0]) / det], axis=-1)
            if np.abs(move).max() < 1e-6:
                break
            ab = ab - move / np.maximum(1.0, np.abs(move).max(axis=-1, keepdims=True) / 5)
        return ab, v[..., 5]

    def out_of_fold(self) -> DataFrame:
        """(id, y, fold, p) at the grid point that each fold's other folds choose."""
        if self.empty:
            return no_chances(self.data, self.id_col)
        ab, lik = self.platt()
        best = [tuple(int(v) for v in np.unravel_index(s.argmax(), s.shape)) for s in lik]
        chosen = [(i, *ab[f, i, j], self.w[i, self.out.index((f, f)), j]) for f, (i, j) in enumerate(best)]
        feats = self.feats

        def chance(xs: np.ndarray, fold: np.ndarray) -> np.ndarray:
            out = np.zeros(len(xs))
            for f in np.unique(fold):
                i, a, b, w = chosen[f]
                own = fold == f
                out[own] = logistic(a * (feats(xs[own], i) @ w) + b)
            return out

        return chances_of(self.data, chance, self.id_col)


def feature_evidence(df: DataFrame, y: str = "y", x: str = "x", scales: list[float] | None = None, m: int = 12, rounds: int = 30) -> DataFrame:
    """(feature, scale, log_odds): for each component of ``x``, the evidence of a Gaussian process
    classifier on it over that of a constant alone, both by Laplace's approximation.

    The process is spanned by ``m`` inducing values of the feature, at its quantiles; where a feature has
    no more distinct values, that is the full process. ``scales`` are tried and the best kept. All
    features and scales share each Newton step, one job that sums m x m numbers for each.
    """
    scales = scales or [0.05, 0.15, 0.5, 1.5, 5.0]
    data = _good(df, x, y).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).persist()
    at = [(i + 0.5) / m for i in range(m)]
    cuts = data.select(F.posexplode("x").alias("feature", "v")).groupBy("feature").agg(F.percentile_approx("v", F.array(*map(F.lit, at)), 10_000).alias("z"), F.approx_count_distinct("v").alias("n")).orderBy("feature").collect()  # m numbers a feature
    if not cuts:
        data.unpersist()
        return df.sparkSession.createDataFrame([], "feature int, scale double, log_odds double")
    few = [r.feature for r in cuts if r.n <= 2 * m]
    exact = {r.feature: sorted(r.z) for r in data.select(F.posexplode("x").alias("feature", "v")).filter(F.col("feature").isin(few)).groupBy("feature").agg(F.collect_set("v").alias("z")).collect()} if few else {}  # about 2 m values a feature
    places = [np.array(exact[r.feature] if len(exact.get(r.feature, [0] * (m + 1))) <= m else sorted(set(r.z))) for r in cuts]
    names, d, ns = [r.feature for r in cuts], len(cuts), len(scales)
    maps = []
    for z in places:
        for s in scales:
            maps.append((z, s, _whitener(z[:, None], 0.5 / s**2)))
    p = max(w.shape[1] for *_, w in maps)

    def newton(models: int, phis, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log evidences and weights after Newton's steps; ``phis`` makes models x rows x p of a batch."""
        value = np.full(models, -np.inf)
        eye = np.eye(w.shape[1])
        for _ in range(rounds):

            def parts(b: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
                t = b.column(1).to_numpy()
                phi = phis(matrix(b.column(0)))
                f = np.einsum("mnp,mp->mn", phi, w)
                q = logistic(f)
                res = np.empty((models, 1 + w.shape[1] + w.shape[1] ** 2))
                res[:, 0] = -np.logaddexp(0, -(2 * t - 1) * f).sum(axis=1)
                res[:, 1 : 1 + w.shape[1]] = ((t - q)[:, None] @ phi)[:, 0]
                res[:, 1 + w.shape[1] :] = (phi.transpose(0, 2, 1) @ (phi * (q * (1 - q))[:, :, None])).reshape(models, -1)
                return res

            v = summed(data, parts, (models, 1 + w.shape[1] + w.shape[1] ** 2), 256)
            h = v[:, 1 + w.shape[1] :].reshape(models, w.shape[1], -1) + eye
            new = v[:, 0] - 0.5 * (w * w).sum(axis=1) - 0.5 * np.linalg.slogdet(h)[1]
            step = np.linalg.solve(h, (v[:, 1 : 1 + w.shape[1]] - w)[:, :, None])[:, :, 0]
            if np.abs(new - value).max() < 1e-7 and np.abs(step).max() < 1e-6:
                break
            value, w = new, w + step
        return new, w

    def all_phis(xs: np.ndarray) -> np.ndarray:
        out = np.zeros((d * ns, len(xs), p))
        for j, (z, s, white) in enumerate(maps):
            out[j, :, : white.shape[1]] = rbf(xs[:, [names[j // ns]]], z[:, None], 0.5 / s**2) @ white
        return out

    base, _ = newton(1, lambda xs: np.ones((1, len(xs), 1)), np.zeros((1, 1)))
    found, _ = newton(d * ns, all_phis, np.zeros((d * ns, p)))
    data.unpersist()
    best = found.reshape(d, ns)
    rows = [(names[i], float(scales[best[i].argmax()]), float(best[i].max() - base[0])) for i in range(d)]
    return df.sparkSession.createDataFrame(rows, "feature int, scale double, log_odds double")


class KernelPca:
    """Principal components of the centred kernel in the landmarks' span, from summed moments."""

    def __init__(self, df: DataFrame, gamma: float, k: int = 10, m: int = 256, id_col: str = "id", x: str = "x"):
        self.x = x
        data = df.select(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x"))
        self.feats = feats = Features(landmarks(data, m, gamma), [gamma])
        p = feats.p

        def parts(b: pa.RecordBatch) -> np.ndarray:
            phi = feats(matrix(b.column(0)), 0)
            return phi.T @ phi

        s = summed(data.select("x"), parts, (p, p))
        self.n, self.mean = s[-1, -1], s[-1, :-1] / s[-1, -1]
        values, vectors = np.linalg.eigh(s[:-1, :-1] - self.n * np.outer(self.mean, self.mean))
        order = values.argsort()[::-1][:k]
        #: Eigenvalues of the centred kernel matrix, and the components in feature space.
        self.values, v = np.maximum(values[order], 0), vectors[:, order]
        self.components = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``x`` replaced by its components."""
        feats, mean, v = self.feats, self.mean, self.components

        @F.pandas_udf("array<double>")
        def projected(col: pd.Series) -> pd.Series:
            return pd.Series(list((feats(np.stack(col.to_numpy()).astype(float), 0)[:, :-1] - mean) @ v)) if len(col) else pd.Series([], dtype=object)

        return df.withColumn(self.x, projected(self.x))

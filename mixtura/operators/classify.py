"""Perceptrons and forests with chances from held-out folds, and small dense kernel machines.

``KernelRidge`` and ``GaussianProcess`` hold all rows: they are for small arrays, and what the landmark
forms (``landmark``) are compared with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.operators.evaluation import folds
from mixtura.operators.landmark import chances_of, fold_data, logistic, no_chances, rbf, three_folds
from mixtura.operators.sums import lbfgs, matrix, summed


class KernelRidge:
    """One kernel ridge regression a class on targets of +-``target``; softmax of the scores."""

    def __init__(self, gamma: float = 0.1, ridge: float = 1.0, target: float = 4.0):
        self.gamma, self.ridge, self.target = gamma, ridge, target

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelRidge:
        self.x, self.classes = x, np.unique(y)
        t = np.where(y[:, None] == self.classes[None], self.target, -self.target)
        self.coef = np.linalg.solve(rbf(x, x, self.gamma) + self.ridge * np.eye(len(x)), t)
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        s = rbf(x, self.x, self.gamma) @ self.coef
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class GaussianProcess:
    """Binary Laplace approximation with an RBF or Matern kernel; ``log_marginal`` is its evidence."""

    def __init__(self, scale: float = 1.0, variance: float = 1.0, nu: float | None = None):
        self.scale, self.variance, self.nu = scale, variance, nu

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)) / self.scale
        if self.nu is None:
            k = np.exp(-0.5 * d * d)
        elif self.nu == 0.5:
            k = np.exp(-d)
        elif self.nu == 1.5:
            k = (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d)
        elif self.nu == 2.5:
            k = (1 + np.sqrt(5) * d + 5 / 3 * d * d) * np.exp(-np.sqrt(5) * d)
        else:
            raise ValueError("nu must be 0.5, 1.5 or 2.5")
        return self.variance * k

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.classes = x, np.unique(y)
        t = (y == self.classes[-1]).astype(float)
        k, f = self.kernel(x, x), np.zeros(len(x))
        value = -np.inf
        for _ in range(50):
            p = 1 / (1 + np.exp(-f))
            w = np.sqrt(p * (1 - p))
            low = np.linalg.cholesky(np.eye(len(x)) + w[:, None] * k * w[None])
            b = w * w * f + t - p
            a = b - w * np.linalg.solve(low.T, np.linalg.solve(low, w * (k @ b)))
            f = k @ a
            new = float(-0.5 * a @ f - np.logaddexp(0, -(2 * t - 1) * f).sum() - np.log(np.diag(low)).sum())
            if abs(new - value) < 1e-9:
                break
            value = new
        self.log_marginal, self.grad = value, t - 1 / (1 + np.exp(-f))
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(self.kernel(x, self.x) @ self.grad)))
        return np.stack([1 - p, p], axis=1)


class _Layout:
    """Where the weights of a perceptron with tanh layers and one logistic output stand in a vector."""

    def __init__(self, inputs: int, hidden: tuple[int, ...]):
        self.sizes = [inputs, *hidden, 1]
        self.p = sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) of each layer, for models x p parameters."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((w[:, at : at + a * b].reshape(-1, a, b), w[:, at + a * b : at + (a + 1) * b].reshape(-1, 1, b)))
            at += (a + 1) * b
        return out

    def start(self, rng: np.random.Generator) -> np.ndarray:
        bounds = [np.sqrt(6 / (a + b)) for a, b in zip(self.sizes, self.sizes[1:])]
        return np.concatenate([rng.uniform(-u, u, (a + 1) * b) for u, a, b in zip(bounds, self.sizes, self.sizes[1:])])

    def scores(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of each layer (models x rows x units), the scores last."""
        seen, layers = [np.broadcast_to(x, (len(w), *x.shape))], self.layers(w)
        for i, (m, b) in enumerate(layers):
            s = seen[-1] @ m + b
            seen.append(np.tanh(s) if i < len(layers) - 1 else s)
        return seen

    def losses(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log losses of rows with ``weight`` (models x rows), and their gradients."""
        seen = self.scores(w, x)
        s = seen[-1][:, :, 0]
        loss = (weight * np.logaddexp(0, np.where(y == 1, -s, s))).sum(axis=1)
        back, parts = (weight * (logistic(s) - y))[:, :, None], []
        for i, (m, _) in reversed(list(enumerate(self.layers(w)))):
            parts.append(np.concatenate([(seen[i].transpose(0, 2, 1) @ back).reshape(len(w), -1), back.sum(axis=1)], axis=1))
            back = (back @ m.transpose(0, 2, 1)) * (1 - seen[i] * seen[i]) if i else back
        return loss, np.concatenate(parts[::-1], axis=1)

    def penalised(self) -> np.ndarray:
        """1 at weights, 0 at biases."""
        return np.concatenate([np.repeat([1.0, 0.0], [a * b, b]) for a, b in zip(self.sizes, self.sizes[1:])])


def perceptrons(df: DataFrame, hidden: list[tuple[int, ...]], alphas: list[float], k: int = 3, rounds: int = 60, seed: int = 1, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, y, fold, p): chances of class 1 by perceptrons with tanh layers, from models that have not
    seen the row; for each fold, layout and penalty are chosen by the log-likelihood of every other fold
    under models that have seen neither.

    The loss is the mean log loss plus ``alpha`` / 2n times the squared weights, as minimised by L-BFGS.
    Back-propagation sums of all layouts, penalties and sets of folds come from one job a step.
    """
    three_folds(k)
    data = fold_data(df, k, id_col, x, y).persist()
    first = data.select("x").first()
    if first is None:
        return no_chances(data, id_col)
    out = [(f, h) for f in range(k) for h in range(f, k)]
    layouts, na = [_Layout(len(first.x), tuple(h)) for h in hidden], len(alphas)
    per, p = len(out) * na, max(v.p for v in layouts)
    shut = np.repeat(np.array([[g not in pair for g in range(k)] for pair in out], float), na, axis=0)
    alpha = np.tile(np.array(alphas, float), len(out))
    sizes = np.zeros(k)
    for r in data.groupBy("fold").count().collect():
        sizes[r.fold] = r["count"]
    n = np.maximum(1.0, shut @ sizes)
    free = np.stack([np.pad(v.penalised(), (0, p - v.p)) for v in layouts])

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = w.reshape(len(layouts), per, p)

        def parts(b: pa.RecordBatch) -> np.ndarray:
            xs, ys, fold = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            res = np.zeros((len(layouts), per, p + 1))
            for i, v in enumerate(layouts):
                res[i, :, p], res[i, :, : v.p] = v.losses(w[i, :, : v.p], xs, ys, shut[:, fold])
            return res

        v = summed(data.select("x", "y", "fold"), parts, (len(layouts), per, p + 1), 256)
        held = w * free[:, None]
        f = (v[:, :, p] + alpha / 2 * (held * held).sum(axis=2)) / n
        return f.ravel(), ((v[:, :, :p] + alpha[:, None] * held) / n[:, None]).reshape(-1, p)

    rng = np.random.default_rng(seed)
    start = np.concatenate([np.repeat(np.pad(v.start(rng), (0, p - v.p))[None], per, axis=0) for v in layouts])
    w = lbfgs(value, start, rounds).reshape(len(layouts), len(out), na, p)
    at = {pair: i for i, pair in enumerate(out)}

    def held_out(b: pa.RecordBatch) -> np.ndarray:
        xs, ys, fold = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
        res = np.zeros((k, len(layouts), na))
        for h in np.unique(fold):
            own = fold == h
            for f in (f for f in range(k) if f != h):
                for i, v in enumerate(layouts):
                    s = v.scores(w[i, at[min(f, h), max(f, h)]][:, : v.p], xs[own])[-1][:, :, 0]
                    res[f, i] -= np.logaddexp(0, np.where(ys[own] == 1, -s, s)).sum(axis=1)
        return res

    best = [np.unravel_index(s.argmax(), s.shape) for s in summed(data.select("x", "y", "fold"), held_out, (k, len(layouts), na), 256)]
    chosen = [(layouts[i], w[i, at[f, f], j][None, : layouts[i].p]) for f, (i, j) in enumerate(best)]

    def chance(xs: np.ndarray, fold: np.ndarray) -> np.ndarray:
        res = np.zeros(len(xs))
        for f in np.unique(fold):
            v, own = chosen[f][0], fold == f
            res[own] = logistic(v.scores(chosen[f][1], xs[own])[-1][0, :, 0])
        return res

    return chances_of(data, chance, id_col)


def forests(df: DataFrame, columns: list[str], trees: list[int], impurities: list[str], depths: list[int], k: int = 3, seed: int = 1, id_col: str = "id", y: str = "y") -> DataFrame:
    """(id, y, fold, p): chances of class 1 by Spark's random forests from models that have not seen the
    row; for each fold, the grid point with the best log-likelihood over the other folds."""
    from functools import reduce

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    dealt = folds(df.filter(F.col(y).isNotNull()).select(id_col, y, *columns), id_col, y, k)
    data = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(dealt).select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("label"), "fold", "features").persist()
    if data.isEmpty():
        return no_chances(data.withColumn("y", F.col("label")), id_col)
    grid = [(t, i, d) for t in trees for i in impurities for d in depths]
    fit = lambda g, shut: RandomForestClassifier(numTrees=g[0], impurity=g[1], maxDepth=g[2], seed=seed).fit(data.filter(~F.col("fold").isin(list(shut))))
    p = vector_to_array("probability")[1]
    best = dict.fromkeys(range(k), grid[0])
    if len(grid) > 1:
        three_folds(k)
        total = {(f, g): 0.0 for f in range(k) for g in grid}
        for f in range(k):
            for h in range(f + 1, k):
                for g in grid:  # a model without two folds scores both
                    lik = fit(g, (f, h)).transform(data.filter(F.col("fold").isin(f, h))).groupBy("fold").agg(F.sum(F.log(F.greatest(F.lit(1e-100), F.when(F.col("label") == 1, p).otherwise(1 - p)))).alias("l"))
                    for r in lik.collect():
                        total[f if r.fold == h else h, g] += r.l
        best = {f: max(grid, key=lambda g, f=f: total[f, g]) for f in range(k)}
    done = [fit(best[f], (f,)).transform(data.filter(F.col("fold") == f)) for f in range(k)]
    return reduce(DataFrame.union, done).select(F.col("id").alias(id_col), F.col("label").cast("int").alias("y"), "fold", p.alias("p"))


def forest_importance(df: DataFrame, columns: list[str], y: str = "y", impurity: str = "gini", trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """(feature, importance) of Spark's random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumn("label", F.col(y).cast("double"))).select("features", "label")
    model = RandomForestClassifier(impurity=impurity, numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")

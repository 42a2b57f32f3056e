"""Gaussian mixtures by expectation-maximisation, and their choice by held-out likelihood.

All mixtures of a call (sizes times folds) are fitted together: one Spark job a round sends, for each,
K (1 + d + d (d + 1) / 2) + 2 sums over the rows outside its fold. Rows are written once, in blocks of
one fold, and all mixtures that use a block meet it in the same matrix products. Only start values come
from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.operators.ensemble import cv_summary
from mixtura.operators.sums import matrix, summed
from mixtura.sources.shared import stored

#: Numbers in a block of rows, bytes of rows that a task writes, and the fold of rows that no mixture leaves out.
BLOCK, PART, NEVER = 1 << 12, 1 << 26, -2


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # K x d x d

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        out = []
        for w, m, c in zip(self.weights, self.means, self.covariances):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out.append(np.log(max(w, 1e-300)) - d / 2 * np.log(2 * np.pi) - np.log(np.diagonal(root)).sum() - 0.5 * (z * z).sum(axis=0))
        return np.stack(out, axis=1)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        j = self.log_joint(x)
        m = j.max(axis=1)
        return m + np.log(np.exp(j - m[:, None]).sum(axis=1))


@dataclass
class Grid:
    """Mixtures side by side, those of one size in a run. Component c maps a row, less ``center``, to
    ``maps[:, c] @ (1, row)``, whose squares add up to its Mahalanobis distance."""

    sizes: np.ndarray  # components of each mixture
    center: np.ndarray
    maps: np.ndarray  # d x components x (1 + d)
    logs: np.ndarray  # of each component, the log density where that distance is 0, with its weight

    @classmethod
    def of(cls, models: Sequence[Mixture]) -> Grid:
        w, m, c = (np.concatenate([getattr(a, name) for a in models]) for name in ("weights", "means", "covariances"))
        center, d = m.mean(axis=0), m.shape[1]
        roots = np.linalg.cholesky(c)
        inverse = np.linalg.inv(roots)
        shift = np.einsum("kij,kj->ki", inverse, m - center)
        maps = np.concatenate([-shift[:, :, None], inverse], axis=2).transpose(1, 0, 2)
        logs = np.log(np.maximum(w, 1e-300)) - d / 2 * np.log(2 * np.pi) - np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
        return cls(np.array([len(a.weights) for a in models]), center, np.ascontiguousarray(maps), logs)

    def only(self, which: np.ndarray) -> Grid:
        c = np.repeat(which, self.sizes)
        return Grid(self.sizes[which], self.center, np.ascontiguousarray(self.maps[:, c]), self.logs[c])

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each component's share of each row (components x rows), and the log densities (mixtures x rows)."""
        y = np.vstack([np.ones(len(x)), (x - self.center).T])
        q = np.zeros((len(self.logs), len(x)))
        for i, a in enumerate(self.maps):
            z = a[:, : i + 2] @ y[: i + 2]  # roots are lower triangles
            z *= z
            q += z
        q *= -0.5
        q += self.logs[:, None]
        density, at = [], 0
        for k, run in groupby(self.sizes):
            m = len(list(run))
            part = q[at : at + m * k].reshape(m, k, len(x))
            top = part.max(axis=1)
            part -= top[:, None]
            np.exp(part, out=part)
            total = part.sum(axis=1)
            part /= total[:, None]
            density.append(top + np.log(total))
            at += m * k
        return q, np.concatenate(density)


def _products(x: np.ndarray) -> np.ndarray:
    """Of each row 1, its values, and the products of two of them, each once: (1 + d + d (d + 1) / 2) x rows."""
    y = np.ascontiguousarray(x.T)
    i, j = np.triu_indices(len(y))
    return np.concatenate([np.ones((1, len(x))), y, y[i] * y[j]])


def _unfolded(v: np.ndarray, d: int) -> np.ndarray:
    """Of sums of ``_products``, a row for each component: the sizes, sums and full sums of x x^T, end to end."""
    i, j = np.triu_indices(d)
    square = np.empty((len(v), d, d))
    square[:, i, j] = square[:, j, i] = v[:, 1 + d :]
    return np.concatenate([v[:, 0], v[:, 1 : 1 + d].ravel(), square.ravel()])


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted sums of x x^T for each column of ``q``, as matrix products."""
    return np.concatenate([((x * w[:, None]).T @ x).ravel() for w in q.T])


def _updated(v: np.ndarray, k: int, d: int, kind: str, ridge: float) -> Mixture:
    n = np.maximum(v[:k], 1e-10)
    means = v[k : k + k * d].reshape(k, d) / n[:, None]
    cov = v[k + k * d :].reshape(k, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", means, means)
    if kind == "tied":
        cov = np.repeat(np.einsum("k,kij->ij", n / n.sum(), cov)[None], k, axis=0)
    if kind in ("diag", "spherical"):
        var = np.diagonal(cov, axis1=1, axis2=2)
        cov = np.einsum("ki,ij->kij", var if kind == "diag" else np.repeat(var.mean(axis=1, keepdims=True), d, axis=1), np.eye(d))
    elif kind not in ("full", "tied"):
        raise ValueError(f"unknown covariance kind {kind!r}")
    return Mixture(n / n.sum(), means, cov + ridge * np.eye(d))


def _start(sample: np.ndarray, k: int, kind: str, ridge: float, rng: np.random.Generator) -> Mixture:
    """From k centres, each far from those before, and a few rounds of k-means on the sample."""
    centers = sample[rng.choice(len(sample), 1)]
    while len(centers) < k:
        far = ((sample[:, None] - centers[None]) ** 2).sum(-1).min(1)
        centers = np.vstack([centers, sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))]])
    for _ in range(10):
        at = ((sample[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        centers = np.array([sample[at == i].mean(0) if (at == i).any() else centers[i] for i in range(k)])
    d = sample.shape[1]
    q = np.eye(k)[at]
    v = np.concatenate([q.sum(0), (q.T @ sample).ravel(), _squares(q, sample)])
    start = _updated(v, k, d, kind, ridge)
    spread = np.cov(sample.T).reshape(d, d) / k ** (2 / d) + ridge * np.eye(d)
    thin = q.sum(0) <= d  # too few rows for a covariance of its own
    start.covariances[thin] = spread if kind in ("full", "tied") else np.diag(np.diag(spread))
    return start


def blocked(df: DataFrame, folds: int, x: str = "x", fold: str = "fold") -> tuple[DataFrame, int, int]:
    """(fold, rows): the vectors, as bytes, at most BLOCK numbers of one fold together; and how many there
    are, of what length. They are dealt evenly to as many tasks as run at once, more if a task's share
    were above PART bytes, and written once: what a round costs is its products, not its rows."""
    own = F.col(fold).cast("int")
    data = df.select(x, F.when(own.between(0, folds - 1), own).otherwise(NEVER).alias("fold") if folds else F.lit(NEVER).alias("fold"))
    d, n = data.select(F.size(x)).first()[0], data.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * d * 8 // PART))
    most = max(1, BLOCK // d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, of = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
                held = [(f, mine[i : i + most].tobytes()) for f in np.unique(of) for mine in [rows[of == f]] for i in range(0, len(mine), most)]
                yield pa.RecordBatch.from_pydict({"fold": pa.array([f for f, _ in held], pa.int32()), "rows": pa.array([r for _, r in held], pa.binary())})

    return stored(data.repartition(tasks).mapInArrow(pack, "fold int, rows binary"), "mixture-blocks"), n, d


def _unpacked(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    for f, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield f, np.frombuffer(rows.as_buffer()).reshape(-1, d)


def fit_folds(df: DataFrame, ks: Sequence[int], folds: int, x: str = "x", fold: str = "fold", kind: str = "full", inits: int = 1, max_iter: int = 50, tolerance: float = 1e-4, ridge: float = 1e-6, sample: int = 5_000, seed: int = 0, blocks: tuple[DataFrame, int, int] | None = None) -> tuple[dict[tuple[int, int, int], Mixture], dict[tuple[int, int, int], list[float]]]:
    """Mixtures by (k, fold, start), each fitted to the rows outside its fold, and the mean log-likelihood
    of these rows before each round. A fold of -1 leaves no row out; ``folds`` = 0 fits this one only.
    ``sample`` bounds the rows that start values are found on; ``blocks`` are those of ``df``, if made."""
    data, n, d = blocks or blocked(df, folds, x, fold)
    some = df.select(x) if n <= sample else df.select(x).sample(fraction=sample / n, seed=seed)  # a fraction given by place would drop the seed
    points = np.array([r[0] for r in some.limit(2 * sample).collect()])
    rng = np.random.default_rng(seed)
    state = {(k, f, i): _start(points, k, kind, ridge, rng) for k in ks for f in (range(folds) if folds else [-1]) for i in range(inits)}
    history: dict[tuple[int, int, int], list[float]] = {key: [] for key in state}
    live = set(state)
    width = 1 + d + d * (d + 1) // 2
    for _ in range(max_iter):
        order = sorted(live)
        of, components = np.array([key[1] for key in order]), sum(key[0] for key in order)
        known = data.sparkSession.sparkContext.broadcast(Grid.of([state[key] for key in order]))  # parameters of the grid

        def parts(batch: pa.RecordBatch) -> np.ndarray:
            grid = known.value  # noqa: B023
            llh, sums = np.zeros((len(of), 2)), np.zeros((components, width))  # noqa: B023
            without: dict[int, tuple[np.ndarray, np.ndarray, Grid]] = {}
            for f, rows in _unpacked(batch, d):
                if f not in without:
                    used = of != f  # noqa: B023
                    without[f] = used, np.repeat(used, grid.sizes), grid.only(used)
                used, places, some = without[f]
                if used.any():
                    q, density = some.posterior(rows)
                    llh[used] += np.stack([np.full(len(density), float(len(rows))), density.sum(axis=1)], axis=1)
                    sums[places] += q @ _products(rows).T
            return np.concatenate([llh.ravel(), sums.ravel()])

        v = summed(data, parts, (2 * len(order) + components * width,))
        llh, sums = v[: 2 * len(order)].reshape(-1, 2), v[2 * len(order) :].reshape(components, width)
        at = 0
        for key, (rows, total) in zip(order, llh, strict=True):
            own = sums[at : at + key[0]]
            at += key[0]
            history[key].append(total / max(1.0, rows))
            if len(history[key]) > 1 and history[key][-1] - history[key][-2] < tolerance:
                live.discard(key)
            else:
                state[key] = _updated(_unfolded(own, d), key[0], d, kind, ridge)
        if not live:
            break
    return state, history


def cross_validate(df: DataFrame, ks: Sequence[int], folds: int, x: str = "x", fold: str = "fold", **options) -> DataFrame:
    """(k, fold, score): the mean log-likelihood of each fold's rows under the mixture fitted without
    them, of the start that fits its own rows best."""
    data, n, d = blocked(df, folds, x, fold)
    state, history = fit_folds(df, ks, folds, x, fold, blocks=(data, n, d), **options)
    best = {}
    for key in sorted(state):
        if key[:2] not in best or history[key][-1] > history[best[key[:2]]][-1]:
            best[key[:2]] = key
    order = sorted(best)
    of = np.array([f for _, f in order])
    known = df.sparkSession.sparkContext.broadcast(Grid.of([state[best[key]] for key in order]))

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(order), 2))
        held: dict[int, Grid] = {}
        for f, rows in _unpacked(batch, d):
            own = of == f
            if own.any():
                if f not in held:
                    held[f] = known.value.only(own)
                density = held[f].posterior(rows)[1]
                out[own] += np.stack([np.full(len(density), float(len(rows))), density.sum(axis=1)], axis=1)
        return out

    v = summed(data, parts, (len(order), 2))
    rows = [(k, f, float(total / n)) for (k, f), (n, total) in zip(order, v) if n]
    return df.sparkSession.createDataFrame(rows, "k int, fold int, score double")


def chosen(scores: DataFrame) -> DataFrame:
    """Mean and summed score of each size, and whether it is the best: the smallest of equals."""
    table = cv_summary(scores, ["k"])
    top = table.agg(F.max_by("k", F.struct("meanscore", -F.col("k"))).alias("_best"))
    return table.crossJoin(F.broadcast(top)).withColumn("best", F.col("k") == F.col("_best")).drop("_best")  # one row

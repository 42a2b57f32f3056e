"""Variational-Bayes Gaussian mixture with a hierarchical Wishart prior.

Weights are Dirichlet, means Gaussian, precisions Wishart whose scale matrix is Wishart in turn;
``full`` or ``diag`` precisions, ``individual`` or ``shared`` over components. All that a pass over the
rows returns are the sums N_k, S1_k, S2_k and the summed log normaliser, so a pass is one Spark job
of partial sums (``fit``), or NumPy on rows that lie in memory (``fit_local``), with the same update in
between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtura.functions.special import digamma, digamma_multi, gammaln, gammaln_multi, pinv
from mixtura.operators.sums import matrix, summed
from mixtura.sources.shared import stored


#: What a fit can fail with.
NUMERIC = (np.linalg.LinAlgError, FloatingPointError, ValueError)


def inverse(m: np.ndarray) -> np.ndarray:
    """The inverse; of a singular matrix or one that is not finite, the repaired pseudo-inverse."""
    try:
        out = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return pinv(m)
    return out if np.isfinite(out).all() else pinv(m)


@dataclass(frozen=True)
class Params:
    """Hyper-parameters of one fit. ``init`` is kmeans or random (rows as first means); with ``perturb``, the
    first means move by normal noise of variance 1 / (perturb k)."""

    k: int = 1
    dirichlet: float = 10.0
    g: float = 0.05
    h: float | np.ndarray = 2.0
    alpha: float = 1.5
    kappa: float = 1.0
    covtyp: str = "full"
    covmode: str = "individual"
    inits: int = 5
    max_iter: int = 300
    tolerance: float = 1e-9
    patience: int = 5
    restarts: int = 5
    seed: int = 0
    init: str = "kmeans"
    perturb: float = 0.0

    def __post_init__(self):
        if self.init not in ("kmeans", "random"):
            raise ValueError(f"init must be kmeans or random, not {self.init!r}")
        if self.covtyp not in ("full", "diag"):
            raise ValueError(f"covtyp must be full or diag, not {self.covtyp!r}")
        if self.covmode not in ("individual", "shared"):
            raise ValueError(f"covmode must be individual or shared, not {self.covmode!r}")
        if self.k < 1:
            raise ValueError("k must be 1 or more")


class Convergence:
    """Converged when a score and the one before agree in their first digits ``patience`` calls in a
    row: their difference, over ten to the mean of their exponents, is ``tolerance`` at most. ``fell``
    tells that a score went the wrong way (down, or up with ``rising=False``); ``reset`` forgets the last
    score, where the next may not continue it."""

    def __init__(self, tolerance: float, patience: int, rising: bool = True):
        self.tolerance, self.patience, self.rising, self.last, self.streak, self.fell = tolerance, patience, rising, None, 0, False

    def reset(self) -> None:
        self.last, self.streak = None, 0

    def __call__(self, score: float) -> bool:
        if self.last is None:
            self.last = score
            return False
        exponents = [np.trunc(np.log10(max(abs(v), 1e-300))) for v in (score, self.last)]
        near = abs(abs(score) - abs(self.last)) / 10.0 ** (sum(exponents) / 2) <= self.tolerance
        self.streak = self.streak + 1 if near else 0
        self.fell |= not near and (score < self.last if self.rising else score > self.last)
        self.last = score
        if self.streak < self.patience:
            return False
        self.streak = 0
        return True


@dataclass
class Posterior:
    """Dirichlet counts, means with precisions, Wishart degrees and scale matrices, and the scale's
    own Wishart."""

    params: Params
    d: int
    xi: np.ndarray
    kappa: np.ndarray
    g0: float
    h0: np.ndarray
    a0: float
    delta: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    mean_cov: np.ndarray = field(default=None)
    a: np.ndarray = field(default=None)
    b: np.ndarray = field(default=None)
    g: float = 0.0
    hm: np.ndarray = field(default=None)
    history: list = field(default_factory=list)

    # -- expectations
    @property
    def slots(self) -> int:
        return self.params.k if self.params.covmode == "individual" else 1

    def at(self, k: int) -> int:
        return k if self.params.covmode == "individual" else 0

    def precision(self, k: int) -> np.ndarray:
        i = self.at(k)
        return self.a[i] * inverse(self.b[i])

    def log_det(self, k: int) -> float:
        i = self.at(k)
        if self.params.covtyp == "diag":
            return float((digamma(self.a[i]) - np.log(np.diag(self.b[i]))).sum())
        return float(digamma_multi(self.a[i], self.d) - np.linalg.slogdet(self.b[i])[1])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Constants, linear terms and quadratic forms of each component's expected log density."""
        k, d = self.params.k, self.d
        const, lin, quad = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        e_pi = digamma(self.delta) - digamma(self.delta.sum())
        for i in range(k):
            p = self.precision(i)
            m = self.mean[i]
            const[i] = e_pi[i] - d / 2 * np.log(2 * np.pi) + 0.5 * self.log_det(i) - 0.5 * (m @ p @ m + np.trace(p @ self.mean_cov[i]))
            lin[i], quad[i] = p @ m, p
        return const, lin, quad

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        const, lin, quad = self.tables()
        return const + x @ lin.T - 0.5 * np.stack([((x @ q) * x).sum(axis=1) for q in quad], axis=1)

    # -- one round of updates from the sums
    def update(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> None:
        k, p = self.params.k, self.params
        self.delta = p.dirichlet + n
        for i in range(k):
            prec = self.precision(i)
            self.mean_cov[i] = inverse(self.kappa + n[i] * prec)
            self.mean[i] = self.mean_cov[i] @ (self.kappa @ self.xi + prec @ s1[i])
        e_beta = self._scale_mean()
        scatter = [s2[i] + n[i] * (np.outer(self.mean[i], self.mean[i]) + self.mean_cov[i]) - np.outer(self.mean[i], s1[i]) - np.outer(s1[i], self.mean[i]) for i in range(k)]
        if p.covmode == "shared":
            scatter, counts = [sum(scatter)], [n.sum()]
        else:
            counts = n
        for i, (c, s) in enumerate(zip(counts, scatter)):
            if p.covtyp == "diag":
                self.a[i], self.b[i] = self.a0 + 0.5 * c, np.diag(np.diag(e_beta) + 0.5 * np.diag(s))
            else:
                # Wishart with density |L|^(a - (d+1)/2) exp(-tr(b L)): both take half the data's part.
                self.a[i], self.b[i] = self.a0 + 0.5 * c, e_beta + 0.5 * s
        self.g = self.g0 + self.a0 * self.slots
        total = sum(self.a[i] * inverse(self.b[i]) for i in range(self.slots))
        self.hm = self.h0 + (np.diag(np.diag(total)) if p.covtyp == "diag" else total)

    def _scale_mean(self) -> np.ndarray:
        return self.g * inverse(self.hm)

    # -- the bound
    def _wishart_kl(self, a: float, b: np.ndarray, a0: float, e_log_b0: float, e_b0: np.ndarray) -> float:
        d = self.d
        if self.params.covtyp == "diag":
            bd = np.diag(b)
            e_log = digamma(a) - np.log(bd)
            return float((a * np.log(bd) - gammaln(a) + (a - 1) * e_log - a).sum() - (e_log_b0 - d * gammaln(a0) + (a0 - 1) * e_log.sum() - (np.diag(e_b0) * a / bd).sum()))
        _, ld = np.linalg.slogdet(b)
        e_log = digamma_multi(a, d) - ld
        own = a * ld - gammaln_multi(a, d) + (a - (d + 1) / 2) * e_log - a * d
        prior = e_log_b0 - gammaln_multi(a0, d) + (a0 - (d + 1) / 2) * e_log - a * np.trace(e_b0 @ np.linalg.inv(b))
        return float(own - prior)

    def bound(self, sum_log: float) -> float:
        """Negative free energy; ``sum_log`` is the summed log normaliser of the assignments."""
        p, d, k = self.params, self.d, self.params.k
        d0 = np.full(k, p.dirichlet)
        kl = gammaln(self.delta.sum()) - gammaln(self.delta).sum() - gammaln(d0.sum()) + gammaln(d0).sum() + ((self.delta - d0) * (digamma(self.delta) - digamma(self.delta.sum()))).sum()
        ld0 = np.linalg.slogdet(self.kappa)[1]
        for i in range(k):
            gap = self.mean[i] - self.xi
            kl += 0.5 * (np.trace(self.kappa @ self.mean_cov[i]) + gap @ self.kappa @ gap - d - ld0 - np.linalg.slogdet(self.mean_cov[i])[1])
        if p.covtyp == "diag":
            e_log_beta = self.a0 * float((digamma(self.g) - np.log(np.diag(self.hm))).sum())
        else:
            e_log_beta = self.a0 * float(digamma_multi(self.g, d) - np.linalg.slogdet(self.hm)[1])
        e_beta = self._scale_mean()
        for i in range(self.slots):
            kl += self._wishart_kl(self.a[i], self.b[i], self.a0, e_log_beta, e_beta)
        log_h0 = float(np.log(np.diag(self.h0)).sum()) if p.covtyp == "diag" else float(np.linalg.slogdet(self.h0)[1])
        kl += self._wishart_kl(self.g, self.hm, self.g0, self.g0 * log_h0, self.h0)
        return float(sum_log - kl)

    # -- use
    def predict_log_density(self, x: np.ndarray) -> np.ndarray:
        j = self.log_joint(x)
        m = j.max(axis=1)
        return m + np.log(np.exp(j - m[:, None]).sum(axis=1))

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        j = self.log_joint(x)
        e = np.exp(j - j.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sample(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """n draws from the expected parameters, with their components."""
        rng = np.random.default_rng(seed)
        z = rng.choice(self.params.k, n, p=self.delta / self.delta.sum())
        covs = [inverse(self.precision(i)) for i in range(self.params.k)]
        return np.array([rng.multivariate_normal(self.mean[i], covs[i]) for i in z]), z


def start(params: Params, low: np.ndarray, high: np.ndarray) -> Posterior:
    """Priors from the ranges of the data."""
    d = len(low)
    r2 = np.maximum(high - low, 1e-12) ** 2
    h = np.asarray(params.h, dtype=float)
    h0 = h if h.ndim == 2 else np.diag(np.full(d, h) / r2)
    # Degrees of freedom are halved: the Wishart here has the density |L|^(a - (d+1)/2) exp(-tr(b L)).
    # A matrix H comes with its own degrees of freedom. Diagonal covariances are Gamma distributed, and
    # their H is halved too, so that the moments are those of the full case.
    more = 0 if h.ndim == 2 else d - 1
    if h.ndim != 2 and params.covtyp == "diag":
        h0 = h0 / 2
    return Posterior(params, d, (low + high) / 2, np.diag(params.kappa / r2), (params.g + more) / 2, h0, (params.alpha + more) / 2)


def seeded(post: Posterior, sample: np.ndarray, total: float) -> None:
    """Start values by k-means on a sample of rows, or from rows drawn at random."""
    p, d, k = post.params, post.d, post.params.k
    rng = np.random.default_rng(p.seed)
    mean, dev = sample.mean(0), sample.std(0)
    best = None
    for _ in range(max(1, p.inits)):
        centers = sample[rng.choice(len(sample), 1)]
        while len(centers) < k:  # far points are likelier
            dist = ((sample[:, None] - centers[None]) ** 2).sum(-1).min(1)
            centers = np.vstack([centers, sample[rng.choice(len(sample), p=dist / dist.sum()) if dist.sum() > 0 else rng.integers(len(sample))]])
        for _ in range(25):
            at = ((sample[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
            centers = np.array([sample[at == i].mean(0) if (at == i).any() else centers[i] for i in range(k)])
        cost = ((sample - centers[at]) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, centers, at
    _, centers, at = best
    if p.init == "random":
        centers = sample[rng.choice(len(sample), k, replace=len(sample) < k)]
        at = ((sample[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
    if p.perturb:
        centers = centers + rng.normal(0, np.sqrt(1 / (p.perturb * k)), centers.shape)
    n = np.bincount(at, minlength=k) * total / len(sample)
    spread = np.cov(sample.T).reshape(d, d) / max(1, k) ** (2 / d) + 1e-9 * np.eye(d)
    post.delta, post.mean = p.dirichlet + n, centers.copy()
    post.g = post.g0 + post.a0 * post.slots
    post.hm = post.h0.copy()
    post.a = np.array([post.a0 + 0.5 * (n[i] if post.slots > 1 or k == 1 else total) for i in range(post.slots)])
    cov = []
    for i in range(post.slots):
        own = sample[at == i] if post.slots == k else sample - centers[at] + mean
        if len(own) < d:  # a thin cluster is filled up with rows like all rows
            own = np.vstack([own, rng.normal(mean, dev, (d - len(own), d))])
        c = np.cov(own.T).reshape(d, d) if len(own) > d else spread
        cov.append((np.diag(np.diag(c)) if p.covtyp == "diag" else c) + 1e-6 * np.diag(np.diag(spread)))
    post.b = np.array([post.a[i] * cov[i] for i in range(post.slots)])
    post.mean_cov = np.array([cov[post.at(i)] / max(n[i], 1.0) for i in range(k)])
    post.hm = post.h0 + sum(post.a[i] * np.linalg.inv(post.b[i]) for i in range(post.slots))


def _sums(post: Posterior, x: np.ndarray) -> np.ndarray:
    j = post.log_joint(x)
    m = j.max(axis=1, keepdims=True)
    e = np.exp(j - m)
    z = e.sum(axis=1, keepdims=True)
    q = e / z
    squares = [((x * w[:, None]).T @ x).ravel() for w in q.T]
    return np.concatenate([[float((m + np.log(z)).sum())], q.sum(0), (q.T @ x).ravel(), *squares])


def _iterate(post: Posterior, sums) -> Posterior:
    p, k, d = post.params, post.params.k, post.d
    done = Convergence(p.tolerance, p.patience)
    for _ in range(p.max_iter):
        v = sums(post)
        score = post.bound(v[0])
        post.history.append(score)
        if done(score):
            break
        post.update(v[1 : 1 + k], v[1 + k : 1 + k + k * d].reshape(k, d), v[1 + k + k * d :].reshape(k, d, d))
    return post


def fit_local(x: np.ndarray, params: Params) -> Posterior:
    """A fit on rows in memory, for small arrays and tests; numeric failures restart with the next seed."""
    error: Exception | None = None
    for r in range(params.restarts):
        try:
            post = start(Params(**{**params.__dict__, "seed": params.seed + 7919 * r}), x.min(0), x.max(0))
            seeded(post, x, len(x))
            return _iterate(post, lambda p: _sums(p, x))
        except NUMERIC as e:
            error = e
    raise error or RuntimeError("no restart allowed")


def fit_many(df: DataFrame, grid: list[Params], x: str = "x", sample: int = 20_000) -> list[Posterior | None]:
    """A fit on all rows of ``df`` for each point of ``grid``, together: one Spark job of partial sums
    for each round, whatever the number of points. Only the start values come from a bounded sample.
    A fit that fails numerically starts again with another seed, ``restarts`` times, and is then None.
    The rows' vectors are written once, so a round reads them and nothing of what made them."""
    data = stored(df.select(F.col(x).cast("array<double>").alias(x)), "mixture-rows")
    d = data.select(F.size(x)).first()[0]
    bounds = data.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i").collect()
    n = data.count()
    some = np.array([r[0] for r in (data if n <= sample else data.sample(sample / n, seed=grid[0].seed)).collect()])
    low, high = np.array([b.low for b in bounds]), np.array([b.high for b in bounds])

    def begun(params: Params, tries: int) -> tuple[Posterior, Convergence, int] | None:
        for t in range(tries, params.restarts):
            try:
                post = start(Params(**{**params.__dict__, "seed": params.seed + 7919 * t}), low, high)
                seeded(post, some, n)
                return post, Convergence(params.tolerance, params.patience), t
            except NUMERIC:
                continue
        return None

    state = [begun(p, 0) for p in grid]
    live = {i for i, s in enumerate(state) if s}
    while live:
        order = sorted(live)
        sizes = [1 + state[i][0].params.k * (1 + d + d * d) for i in order]
        known = df.sparkSession.sparkContext.broadcast([state[i][0] for i in order])  # parameters of the grid

        def parts(batch: pa.RecordBatch) -> np.ndarray:
            rows = matrix(batch.column(0))
            return np.concatenate([_sums(p, rows) for p in known.value])  # noqa: B023

        v = np.split(summed(data, parts, (sum(sizes),)), np.cumsum(sizes)[:-1])
        for i, own in zip(order, v):
            post, done, tries = state[i]
            k = post.params.k
            try:
                score = post.bound(own[0])
                if not np.isfinite(score):
                    raise FloatingPointError("the bound is not finite")
                post.history.append(score)
                if done(score) or len(post.history) >= post.params.max_iter:
                    live.discard(i)
                else:
                    post.update(own[1 : 1 + k], own[1 + k : 1 + k + k * d].reshape(k, d), own[1 + k + k * d :].reshape(k, d, d))
            except NUMERIC:
                state[i] = begun(grid[i], tries + 1)
                if not state[i]:
                    live.discard(i)
    return [s[0] if s else None for s in state]


def fit(df: DataFrame, params: Params, x: str = "x", sample: int = 20_000) -> Posterior:
    """A fit on all rows of ``df``: one Spark job of partial sums for each round."""
    (post,) = fit_many(df, [params], x, sample)
    if post is None:
        raise np.linalg.LinAlgError("no start led to a fit")
    return post


def predict(df: DataFrame, post: Posterior, x: str = "x") -> DataFrame:
    """``df`` with q, log_density and the 1-based component."""
    state = df.sparkSession.sparkContext.broadcast(post)

    @F.pandas_udf("struct<q:array<double>,log_density:double,component:int>")
    def run(col: pd.Series) -> pd.DataFrame:
        m = np.stack(col.to_numpy())
        q = state.value.predict_proba(m)
        return pd.DataFrame({"q": list(q), "log_density": state.value.predict_log_density(m), "component": (q.argmax(1) + 1).astype("int32")})

    return df.withColumn("_p", run(F.col(x))).select("*", "_p.q", "_p.log_density", "_p.component").drop("_p")


def remapped(post: Posterior, order: list[int]) -> Posterior:
    """The posterior with its components (0-based) in another order."""
    if sorted(order) != list(range(post.params.k)):
        raise ValueError("not an order of all components")
    own = list(order) if post.slots == post.params.k else slice(None)
    return replace(post, delta=post.delta[order], mean=post.mean[order], mean_cov=post.mean_cov[order], a=post.a[own], b=post.b[own])


def report(post: Posterior) -> dict[str, str]:
    """Texts on a fit: its settings and state, and the expected parameters of each component."""
    p, weight = post.params, post.delta / post.delta.sum()
    settings = f"{p.k} components, {p.covtyp} covariances, {p.covmode}, {post.d} dimensions"
    state = f"{len(post.history)} rounds, bound {post.history[-1]:.6g}" if post.history else "not fitted"
    shown = [f"{i + 1}: weight {weight[i]:.4f}, mean {np.array2string(post.mean[i], precision=4)}, variances {np.array2string(np.diag(np.linalg.inv(post.precision(i))), precision=4)}" for i in range(p.k)]
    return {"settings": settings, "state": state, "parameters": "\n".join(shown)}


def majority_map(df: DataFrame, true: str = "true", pred: str = "component") -> DataFrame:
    """(true, component): for each true label the component that most of its rows have, the lowest of
    equals. Two labels may share a component."""
    counts = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    return counts.groupBy(true).agg(F.max_by(pred, F.struct("n", -F.col(pred))).alias(pred))


def draws(spark: SparkSession, post: Posterior, n: int, seed: int = 0, expected: bool = False, block: int = 4096) -> DataFrame:
    """(id, component, x): n draws of the mixture, from the expected parameters or, for each row anew,
    from parameters that are drawn from the posterior: weights from gamma variates (Dirichlet), means
    from their normal, precisions by Bartlett's factors of the Wishart.

    A block of ids has a counter-based generator of its own, so a task that runs again repeats its draws.
    """
    d, k = post.d, post.params.k
    diag = post.params.covtyp == "diag"
    slots = [post.at(i) for i in range(k)]
    # The Wishart here has 2 a degrees of freedom and the scale (2 b)^-1.
    scale = [np.linalg.cholesky(inverse(2 * b)) for b in post.b] if not diag else None
    mean_root = [np.linalg.cholesky(c + 1e-15 * np.trace(c) * np.eye(d)) for c in post.mean_cov]
    roots = [np.linalg.cholesky(inverse(post.precision(i))) for i in range(k)]

    def of_block(at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.Philox(key=[seed, at]))
        if expected:
            z = rng.choice(k, size, p=post.delta / post.delta.sum())
        else:
            w = rng.gamma(post.delta, size=(size, k))
            z = (w.cumsum(axis=1) / w.sum(axis=1, keepdims=True) < rng.random((size, 1))).sum(axis=1)
        noise, x = rng.normal(size=(size, d)), np.empty((size, d))
        means = rng.normal(size=(size, d))
        for i in range(k):
            own = np.flatnonzero(z == i)
            m = len(own)
            if expected:
                x[own] = post.mean[i] + noise[own] @ roots[i].T
                continue
            centre = post.mean[i] + means[own] @ mean_root[i].T
            if diag:
                x[own] = centre + noise[own] / np.sqrt(rng.gamma(post.a[slots[i]], 1 / np.diag(post.b[slots[i]]), (m, d)))
                continue
            low = np.tril(rng.normal(size=(m, d, d)), -1)
            low[:, np.arange(d), np.arange(d)] = np.sqrt(rng.chisquare(2 * post.a[slots[i]] - np.arange(d), (m, d)))
            factor = scale[slots[i]] @ low  # precision = factor factor^T
            x[own] = centre + np.linalg.solve(factor.transpose(0, 2, 1), noise[own][:, :, None])[:, :, 0]
        return z, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                size = min(block, n - at * block)
                z, x = of_block(at, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at * block, at * block + size)), pa.array((z + 1).astype("i4")), pa.array(list(x), pa.list_(pa.float64()))], ["id", "component", "x"])

    return spark.range(-(-n // block)).mapInArrow(run, "id long, component int, x array<double>")


def kernel_divergences(spark: SparkSession, post: Posterior) -> DataFrame:
    """(a, b, kl): Kullback-Leibler divergence of component b (1-based) from a, as normal distributions
    with their expected parameters."""
    k, d, rows = post.params.k, post.d, []
    for i in range(k):
        cov = inverse(post.precision(i))
        for j in range(k):
            other, gap = post.precision(j), post.mean[j] - post.mean[i]
            kl = 0.5 * (np.trace(other @ cov) + gap @ other @ gap - d - np.linalg.slogdet(cov)[1] - np.linalg.slogdet(other)[1])
            rows.append((i + 1, j + 1, float(max(kl, 0.0))))
    return spark.createDataFrame(rows, "a int, b int, kl double")


def model_stats(df: DataFrame, post: Posterior, x: str = "x") -> DataFrame:
    """One row for each component: rows that it wins, weight, mean, log determinant, condition number
    and rank of its precision, the log density at its mean, the divergences of its mean's and its
    precision's posterior from their priors, and of the covariance of its own rows the log determinant,
    rank and condition number (null below two rows). One pass of second moments."""
    d, k = post.d, post.params.k
    known = df.sparkSession.sparkContext.broadcast(post)

    def parts(b: pa.RecordBatch) -> np.ndarray:
        m = matrix(b.column(0))
        at = known.value.log_joint(m).argmax(axis=1)
        return np.stack([np.concatenate([[(at == i).sum()], m[at == i].sum(axis=0), (m[at == i].T @ m[at == i]).ravel()]) for i in range(k)])

    v = summed(df.select(x), parts, (k, 1 + d + d * d))
    e_beta = post._scale_mean()
    if post.params.covtyp == "diag":
        e_log = post.a0 * float((digamma(post.g) - np.log(np.diag(post.hm))).sum())
    else:
        e_log = post.a0 * float(digamma_multi(post.g, d) - np.linalg.slogdet(post.hm)[1])
    out = []
    for i in range(k):
        precision, slot, gap = post.precision(i), post.at(i), post.mean[i] - post.xi
        peak = float(post.predict_log_density(post.mean[i][None])[0])
        kl_mean = 0.5 * (np.trace(post.kappa @ post.mean_cov[i]) + gap @ post.kappa @ gap - d - np.linalg.slogdet(post.kappa)[1] - np.linalg.slogdet(post.mean_cov[i])[1])
        kl_precision = post._wishart_kl(post.a[slot], post.b[slot], post.a0, e_log, e_beta)
        n = v[i, 0]
        own: tuple = (None, None, None)
        if n > 1:
            cov = (v[i, 1 + d :].reshape(d, d) - np.outer(v[i, 1 : 1 + d], v[i, 1 : 1 + d]) / n) / (n - 1)
            own = (float(np.linalg.slogdet(cov)[1]), int(np.linalg.matrix_rank(cov)), float(np.linalg.cond(cov)))
        out.append((i + 1, int(n), float(post.delta[i] / post.delta.sum()), post.mean[i].tolist(), float(np.linalg.slogdet(precision)[1]), float(np.linalg.cond(precision)), int(np.linalg.matrix_rank(precision)), peak, float(kl_mean), float(kl_precision), *own))
    return df.sparkSession.createDataFrame(out, "component int, n long, weight double, mean array<double>, log_det double, cond double, rank int, peak double, kl_mean double, kl_precision double, sample_log_det double, sample_rank int, sample_cond double")

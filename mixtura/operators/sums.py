"""Sums over all rows of large arrays, added up in a tree of tasks, and many models fitted by them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Numbers in a block, and numbers that the driver gets beside the sums themselves.
BLOCK, DRIVER = 1 << 16, 1 << 21


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def summed(df: DataFrame, parts: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], batch: int = 1024) -> np.ndarray:
    """The sum over all rows of the arrays of ``shape`` that ``parts`` makes of at most ``batch`` rows.

    A task sums what it reads; its sum is cut into blocks, and other tasks add up the partial sums of a
    block. The driver adds what few of them are left, no more than DRIVER numbers beside the result's
    own, whose size the caller's parameters bound.
    """
    size = int(np.prod(shape))
    salts = max(1, min(64, DRIVER // max(1, size)))
    kind = "block int, salt int, v binary"

    def row(block: int, salt: int, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, some = np.zeros(shape), False
        for b in batches:
            for i in range(0, b.num_rows, batch):
                acc += parts(b.slice(i, batch))
                some = True
        flat = acc.ravel()
        for at in range(0, size * some, BLOCK):
            yield row(at // BLOCK, TaskContext.get().partitionId() % salts, flat[at : at + BLOCK])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, salt, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[block, salt] = sums.get((block, salt), 0) + np.frombuffer(v)
        for at, v in sums.items():
            yield row(*at, v)

    out = np.zeros(size)
    for r in df.mapInArrow(local, kind).repartition("block", "salt").mapInArrow(add, kind).collect():
        v = np.frombuffer(r.v)
        out[r.block * BLOCK : r.block * BLOCK + len(v)] += v
    return out.reshape(shape)


def lbfgs(value: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, rounds: int = 60, tolerance: float = 1e-5, memory: int = 10) -> np.ndarray:
    """Minimises many functions side by side. ``value`` maps parameters (models x p) to values and
    gradients, in one job for all; models that are done keep their place, and a step that does not
    lower a model's value enough is halved for that model alone."""
    w = start.astype(float).copy()
    f, g = value(w)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        live = np.abs(g).max(axis=1) > tolerance * np.maximum(1.0, np.abs(w).max(axis=1))
        if not live.any():
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s * q).sum(axis=1)
            alphas.append(a)
            q -= a[:, None] * y
        if steps:
            s, y, rho = steps[-1]
            yy = (y * y).sum(axis=1)
            q *= np.where(rho > 0, 1 / np.maximum(rho * yy, 1e-300), 1 / np.maximum(1.0, np.linalg.norm(g, axis=1)))[:, None]
        else:
            q /= np.maximum(1.0, np.linalg.norm(g, axis=1))[:, None]
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            q += (a - rho * (y * q).sum(axis=1))[:, None] * s
        down = -(q * g).sum(axis=1)
        q[down >= 0], down = g[down >= 0], np.where(down >= 0, -(g * g).sum(axis=1), down)
        t, open_ = np.where(live, 1.0, 0.0), live.copy()
        new, fn, gn = w.copy(), f.copy(), g.copy()
        for _ in range(20):
            trial = np.where(open_[:, None], w - t[:, None] * q, new)
            ft, gt = value(trial)
            good = open_ & (ft <= f + 1e-4 * t * down)
            new[good], fn[good], gn[good] = trial[good], ft[good], gt[good]
            open_ &= ~good
            if not open_.any():
                break
            t[open_] /= 2
        s, y = new - w, gn - g
        sy = (s * y).sum(axis=1)
        steps = [*steps, (s, y, np.where(sy > 1e-12, 1 / np.where(sy > 1e-12, sy, 1), 0.0))][-memory:]
        w, f, g = new, fn, gn
        if not np.abs(s).max() > 0:
            break
    return w

"""Quality classifier by positive-unlabelled learning.

The trusted positives are the rows labelled 1; all documents are the unlabelled sample. With prior
p of good texts, the classifier f minimises the non-negative unbiased risk
``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` with logistic loss over a linear model of hinged
text features. With this loss the unclipped risk is convex, and Newton steps minimise it; a step
that would make the second part negative is halved until it does not.

The prior is estimated from the data: over upper level sets of a first classifier's score, the
share of unlabelled texts divided by the share of positives is never below the prior, and comes
down to it where no bad text is left; the least such ratio, plus its standard error, is taken.

Features see the whole text and nothing else; all sums run over all documents as Spark jobs. Each
document's features are computed once and stored in the shared folder.

Cases: a null or empty text has all counts zero and is scored like any other. Without positives
every score is 0.5. A null id is never a training row and is scored. Repeated labels of an id count
once (the largest). Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written
from mixtura.llm.logistic import matrix, sigmoid, softplus, summed

FEATURES = ("log_words", "word_length", "distinct_words", "distinct_pairs", "same_as_last", "upper", "digits", "symbols", "bars", "exclaims", "stops", "dup_lines", "line_words", "letters")
_UPPER, _DIGIT, _LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
_SYMBOL, _STOP = b"#*$%&<>{}[]^~=+_\\/@", b".,;:"
#: Bins of the score with which the prior is estimated.
BINS = 400


def features(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, islice(words, 1, None))))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(set(words)) / n**0.8,
        pairs / max(1, len(words) - 1),
        sum(map(eq, words, islice(words, 1, None))) / n,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(b"|"), share(b"!"), share(_STOP),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        share(_LETTER),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.float64())), *part.columns[2:]], names=["doc_id", "x", *part.schema.names[2:]])


def _hinged(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Constant, standard scores, and how far they lie out on each side."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, np.maximum(0, z - 1), np.maximum(0, -1 - z)])


class Risk:
    """The parts of the non-negative risk and their derivatives, summed over all rows."""

    def __init__(self, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, penalty: float):
        self.rows, self.mean, self.scale, self.penalty, self.size = rows, mean, scale, penalty, 1 + 3 * len(mean)

    def at(self, w: np.ndarray) -> dict:
        mean, scale, d = self.mean, self.scale, self.size

        def parts(batch: pa.RecordBatch) -> np.ndarray:
            x, positive = _hinged(matrix(batch.column(0)), mean, scale), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            z = x @ w
            s = sigmoid(z)
            head = [len(z), positive.sum(), softplus(z).sum(), softplus(z[positive]).sum(), z[positive].sum()]
            return np.concatenate([head, x.T @ s, x[positive].sum(axis=0), ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

        v = summed(self.rows, parts, 5 + 2 * d + d * d)
        n, p = max(1, v[0]), max(1, v[1])
        return {"minus_u": v[2] / n, "minus_p": v[3] / p, "z_p": v[4] / p, "g_u": v[5 : 5 + d] / n, "g_p": v[5 + d : 5 + 2 * d] / p, "h": v[5 + 2 * d :].reshape(d, d) / n, "n": v[0], "positives": v[1]}

    def value(self, w: np.ndarray, r: dict, prior: float) -> float:
        return r["minus_u"] - prior * r["z_p"] + self.penalty * w[1:] @ w[1:]

    def least(self, prior: float, w: np.ndarray, steps: int) -> np.ndarray:
        r = self.at(w)
        if not r["positives"]:
            return np.zeros(self.size)
        for _ in range(steps):
            ridge = np.full(self.size, 2 * self.penalty)
            ridge[0] = 1e-9
            step = np.linalg.solve(r["h"] + np.diag(ridge + 1e-6), r["g_u"] - prior * r["g_p"] + ridge * w)
            for _ in range(6):
                new = w - step
                at_new = self.at(new)
                if at_new["minus_u"] >= prior * at_new["minus_p"] and self.value(new, at_new, prior) <= self.value(w, r, prior):
                    break
                step = step / 2
            else:
                return w
            gain = self.value(w, r, prior) - self.value(new, at_new, prior)
            w, r = new, at_new
            if gain < 1e-5:
                break
        return w


def _prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    def parts(batch: pa.RecordBatch) -> np.ndarray:
        z = _hinged(matrix(batch.column(0)), mean, scale) @ w
        at = np.clip(((z + 20) / 40 * BINS).astype(int), 0, BINS - 1)
        positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    counts = summed(rows, parts, 2 * BINS)
    u, p = counts[:BINS][::-1].cumsum(), counts[BINS:][::-1].cumsum()
    share_u, share_p = u / max(1, u[-1]), p / max(1, p[-1])
    ok = share_p >= 0.3
    ratio = share_u[ok] / share_p[ok]
    error = np.sqrt((1 - share_p[ok]) / np.maximum(1, p[ok]) + (1 - share_u[ok]) / np.maximum(1, u[ok]))
    return float(np.clip((ratio * (1 + error)).min(), 0.05, 0.98)) if ok.any() else 0.5


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, threshold: float = 0.5, penalty: float = 12.0, steps: int = 10, key_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score (that the text is good), predicted, for every row of ``docs``, and the
    row's ``key_col`` (a long), where given. Labels of the held-out fold are not used."""
    keys = [key_col] if key_col else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys)
    kept = "".join(f", {k} long" for k in keys)
    rows = written(named.mapInArrow(_featured, f"doc_id long, x array<double>{kept}"), "quality-features")
    known = labels.filter(~in_fold(F.col("doc_id").cast("long"), folds, held_fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("positive"))
    rows = written(rows.join(known, "doc_id", "left").select("doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive"), *keys), "quality-rows")
    w, mean, scale = fit(rows.select("x", "positive"), penalty, steps)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            score = sigmoid(_hinged(x, mean, scale) @ w) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *keys])

    out = rows.select("doc_id", "x", *keys).mapInArrow(scored, f"doc_id long, score double{kept}")
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keys)


def fit(rows: DataFrame, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, and the mean and spread of the features, from rows (x, positive). ``penalty`` is
    the strength of the ridge in positive rows."""
    d = len(FEATURES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = summed(rows, moments, 1 + 2 * d)
    penalty = penalty / max(1, rows.filter("positive").count())
    n = max(1, m[0])
    mean = m[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(m[1 + d :] / n - mean**2, 1e-12))
    risk = Risk(rows, mean, scale, penalty)
    first = risk.least(0.7, np.zeros(risk.size), steps)
    if not first.any():
        return first, mean, scale
    return risk.least(_prior(rows, mean, scale, first), first, steps), mean, scale

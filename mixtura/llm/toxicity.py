"""Toxicity by maximum-scoring segments.

Terms (words, and word beginnings, so that inflected forms are caught) get the log-odds of their
use in toxic against other texts, under an informative Dirichlet prior that follows their overall
use. Terms whose log-odds are significant score these; every other token scores a small loss. A
single linear pass over a text finds all its maximal scoring segments. Their scores are judged by
extreme-value statistics: with the decay L of the score distribution (the root of sum p e^(Ls) = 1)
and the scale K fitted on texts that are not toxic, a segment of score S in a text of n tokens is
expected K n e^(-LS) times by chance. Segments expected less than ``significant`` times are the text's
toxic passages, given with their place (code points, ends exclusive), score and expectation. A text's
evidence, its best segment's score and -log expectation and the sum of the latter over its segments, is
turned into a probability on the training labels.

Training reads a sample of labelled rows: each row of the training fold with a probability that
makes ``sample`` rows in the mean, chosen by a hash of the id. Near copies among them would count
as evidence many times over, so texts that share the least hash of their five-word passages share
one weight. All terms of the sample that are significant are used, so the sample bounds their number.

Cases: a null or empty text has no segments and gets the score of a text without evidence. Without
labels of both classes every score is 0. A null id is never a training row and is scored; repeated
labels of an id count once (the largest). Empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written
from mixtura.llm.logistic import sigmoid
from mixtura.llm.quality_pu import in_fold

_STRIP = ".,;:!?\"()'*#$%&|<>[]{}"
_WORD = re.compile(r"\S+")
#: Lengths of the word beginnings that are terms of their own.
STEMS = (3, 4, 5)


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _signature(words: list[str]) -> int:
    """The least hash of the five-word passages; near copies mostly share it."""
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))), default=0)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_signature(tokens(t or "")) for t in part.column(0).to_pylist()], pa.int64())], names=["text", "toxic", "sig"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted numbers of toxic and other texts that use each term, of one task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        both = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_pydict({"term": pa.array(both, pa.string()), "other": pa.array([counts[0][t] for t in both], pa.float64()), "toxic": pa.array([counts[1][t] for t in both], pa.float64())})
        for c in counts:
            c.clear()
        return batch

    for batch in batches:
        for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns)):
            into = counts[toxic]
            for term in {t for w in set(tokens(text or "")) for t in terms(w)}:
                into[term] += weight
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
    yield out()


class Model:
    """Scores of terms, the loss of other tokens, and the extreme-value and final parameters."""

    def __init__(self, scores: dict[str, float], loss: float, decay: float = 0.0, scale: float = 1.0, weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)):
        self.scores, self.loss, self.decay, self.scale, self.weights = scores, loss, decay, scale, weights
        self._seen: dict[str, float] = {}

    def score(self, word: str) -> float:
        """The highest score among a word's terms, or the loss."""
        if (s := self._seen.get(word)) is None:
            s = max((self.scores[t] for t in terms(word) if t in self.scores), default=-self.loss)
            if len(self._seen) > 500_000:
                self._seen.clear()
            self._seen[word] = s
        return s

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score), in one pass; long losing stretches
        between hits are one step."""
        # start, end, sum before it, sum up to its end, place of the nearest earlier one with a smaller sum before
        held: list[tuple[int, int, float, float, int]] = []
        total, last = 0.0, 0
        for i, s in ((i, s) for i, s in enumerate(map(self.score, words)) if s > 0):
            total -= self.loss * (i - last)
            last = i + 1
            start, left, right = i, total, total + s
            total = right
            while True:
                # From the last one on, each step skips all that cannot lie to the left of this one; what a
                # later segment skips once, it passes over by one link, so walks add up to linear time.
                j = len(held) - 1
                while j >= 0 and held[j][2] >= left:
                    j = held[j][4]
                if j < 0 or held[j][3] >= right:
                    held.append((start, i + 1, left, right, j))
                    break
                start, left = held[j][0], held[j][2]
                del held[j:]
        return [(s, e, right - left) for s, e, left, right, _ in held]

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the segments."""
        words = tokens(text)
        return len(words), self.segments(words)

    def evidence(self, n: int, scores: list[float]) -> tuple[float, float, float, float]:
        """Constant, best score and -log expectation of the best, both levelling off near 20, and the
        logarithm of the latter's sum over segments expected less than once."""
        base = np.log(self.scale * max(1, n))
        bits = [max(0.0, self.decay * s - base) for s in scores]
        level = -20 * np.expm1(-np.array([max(scores, default=0.0), max(bits, default=0.0)]) / 20)
        return 1.0, float(level[0]), float(level[1]), float(np.log1p(sum(bits)))

    def passages(self, text: str, significant: float, found: tuple[int, list[tuple[int, int, float]]] | None = None) -> list[dict]:
        """The significant ones of a text's segments (``found``, if known): start, end, score, expectation."""
        n, segments = found or self.found(text)
        kept = [(s, e, score, self.scale * n * float(np.exp(-self.decay * score))) for s, e, score in segments]
        kept = [x for x in kept if x[3] < significant]
        if not kept:
            return []
        places = [(m.start() + len(m[0]) - len(m[0].lstrip(_STRIP)), m.start() + len(m[0].rstrip(_STRIP))) for m in _WORD.finditer(text) if m[0].strip(_STRIP)]
        return [{"start": places[s][0], "end": places[e - 1][1], "score": score, "expectation": x} for s, e, score, x in kept]

    def probability(self, found: list[tuple[int, list[tuple[int, int, float]]]]) -> np.ndarray:
        return sigmoid(np.array([self.evidence(n, [s for *_, s in held]) for n, held in found]).reshape(-1, 4) @ np.array(self.weights))


def _decay(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p e^(Ls) = 1, by halving; 0 where there is none."""
    if not (s > 0).any() or p @ s >= 0:
        return 0.0
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * s, 700)) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * s, 700)) < 1 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, sample: int, loss: float, least_z: float) -> Model | None:
    spark = docs.sparkSession
    known = written(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    share = min(1.0, sample / max(1, known.count()))
    # Bounded by ``sample``, so it may go to every executor.
    known = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    # Of rows that share an id one text counts, so the sample keeps its bound.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    signed = written(texts.mapInArrow(_signatures, "text string, toxic int, sig long"), "toxic-sample")
    used = signed.join(F.broadcast(signed.groupBy("sig").agg((1 / F.count("*")).alias("weight"))), "sig").select("text", "toxic", "weight")
    counts = written(used.mapInArrow(_term_counts, "term string, other double, toxic double").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")), "toxic-terms")
    sums = counts.filter(~F.col("term").endswith("*")).agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).first()
    if not sums.other or not sums.toxic:
        return None
    # The prior of a term follows its overall use; its weight is that of ``strength`` uses in all.
    strength = 2000.0
    prior = strength * (F.col("other") + F.col("toxic")) / (sums.other + sums.toxic) + 0.5
    odds = lambda y, n: F.log((y + prior) / (F.greatest(n - y, F.lit(0.0)) + strength))
    delta = odds(F.col("toxic"), F.lit(sums.toxic)) - odds(F.col("other"), F.lit(sums.other))
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    found = counts.filter("toxic > 0").withColumns({"delta": delta, "z": z}).filter((F.col("z") >= least_z) & (F.col("delta") > 0)).orderBy("term").collect()  # of the sample's terms
    model = Model({r.term: r.delta for r in found}, loss)
    if not found:
        return model
    # Background chances of each score: words and word beginnings overlap, so they are an upper bound.
    p = np.array([(r.other + 0.5) / (sums.other + 1) for r in found])
    p *= min(1.0, 0.5 / max(p.sum(), 1e-12))
    model.decay = _decay(np.append(p, 1 - p.sum()), np.append([r.delta for r in found], -loss))

    seen = spark.sparkContext.broadcast(model)  # terms of the sample

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [seen.value.found(t or "") for t in batch.column(0).to_pylist()]
            scores = [[s for *_, s in segments] for _, segments in held]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([max(s, default=0.0) for s in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["n", "best", "scores", "toxic", "weight"])

    rows = written(used.mapInArrow(judged, "n long, best double, scores array<double>, toxic int, weight double"), "toxic-found")
    # The scale at which the best scores of plain texts are likeliest.
    mean = rows.filter("toxic = 0").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.greatest("n", F.lit(1)) * F.exp(-model.decay * F.col("best"))).alias("e")).first()
    model.scale = float((mean.w or 0.0) / max(mean.e or 0.0, 1e-12))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.evidence(n, s) for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column(2), batch.column(3)], names=["x0", "x1", "x2", "x3", "toxic", "weight"])

    # Six numbers for each row of the sample.
    fit = rows.select("n", "scores", "toxic", "weight").mapInArrow(weighed, "x0 double, x1 double, x2 double, x3 double, toxic int, weight double").toPandas()
    model.weights = tuple(_fit(fit[["x0", "x1", "x2", "x3"]].to_numpy(), fit.toxic.to_numpy(), fit.weight.to_numpy()))
    return model


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = 0.3, sample: int = 100_000, loss: float = 0.2, least_z: float = 4.0, significant: float = 0.01) -> DataFrame:
    """doc_id, held_out, score, predicted, and the toxic passages (an array of start, end, score,
    expectation in the text's order), for every row of ``docs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, folds, held_fold, sample, loss, least_z))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [m.found(t) if m is not None else (0, []) for t in texts]
            score = np.zeros(len(texts)) if m is None else m.probability(found)
            # A text with a significant segment has evidence, and so a score above the least.
            least = 0.0 if m is None else m.probability([(1, [])])[0]
            passages = [m.passages(t, significant, f) if m is not None and s != least else [] for t, s, f in zip(texts, score, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, _PASSAGES_ARROW)], names=["doc_id", "score", "passages"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, f"doc_id long, score double, passages {_PASSAGES}")
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


_PASSAGES = "array<struct<start:int,end:int,score:double,expectation:double>>"
_PASSAGES_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))

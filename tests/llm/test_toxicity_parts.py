"""The fitted numbers of the toxicity model against plain sums over its training rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mixtura.llm import toxicity as tox

WORDS = [f"{a}{b}" for a in ("ra", "te", "mo", "li", "su") for b in ("n", "s", "nd", "le")]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for i in range(400):
        words = rng.choices(WORDS, k=rng.randint(10, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileone", "grimword"])
        elif i % 17 == 0:
            words.append("grimword")
        out.append((i, " ".join(words), toxic))
    return [*out, (1000, out[0][1], 1), (1001, None, 0), (1002, "", 0)]


def test_terms_scale_and_weights_match_plain_sums(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "no id")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels, 4, 2, 100_000, 0.2, 4.0)
    used = [(t or "", y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    sign = [tox._signature(tox.tokens(t)) for t, _ in used]
    weight = np.array([1 / Counter(sign)[s] for s in sign])
    y = np.array([v for _, v in used])

    counts = {0: Counter(), 1: Counter()}
    for (t, v), w in zip(used, weight, strict=True):
        for term in {x for word in set(tox.tokens(t)) for x in tox.terms(word)}:
            counts[v][term] += w
    n0, n1 = (sum(c for t, c in counts[v].items() if not t.endswith("*")) for v in (0, 1))
    want = {}
    for term, c in counts[1].items():
        other = counts[0][term]
        prior = 2000 * (other + c) / (n0 + n1) + 0.5
        odds = lambda k, n, prior=prior: np.log((k + prior) / (max(n - k, 0) + 2000))
        delta = odds(c, n1) - odds(other, n0)
        if delta > 0 and delta / np.sqrt(1 / (c + prior) + 1 / (other + prior)) >= 4:
            want[term] = delta
    assert want and model.scores == pytest.approx(want)
    p = np.array([(counts[0][t] + 0.5) / (n0 + 1) for t in sorted(want)])
    p *= min(1, 0.5 / p.sum())
    s = np.array([want[t] for t in sorted(want)])
    assert p @ np.exp(model.decay * s) + (1 - p.sum()) * np.exp(-0.2 * model.decay) == pytest.approx(1)

    found = [model.found(t) for t, _ in used]
    best = np.array([max((s for *_, s in segments), default=0.0) for _, segments in found])
    n = np.array([max(1, k) for k, _ in found])
    plain = y == 0
    assert model.scale == pytest.approx(weight[plain].sum() / (weight * n * np.exp(-model.decay * best))[plain].sum())
    x = np.array([model.evidence(k, [s for *_, s in segments]) for k, segments in found])
    w = np.array(model.weights)
    share = weight / weight.sum()
    gradient = x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-3 * w
    assert np.abs(gradient).max() < 1e-6


def test_an_id_of_many_rows_counts_once(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    more = docs.union(docs.filter("doc_id = 7")).union(docs.filter("doc_id = 7"))
    one, two = (tox.train(d, labels, 4, 2, 100_000, 0.2, 4.0) for d in (docs, more))
    assert one.scores == pytest.approx(two.scores) and one.scale == pytest.approx(two.scale)

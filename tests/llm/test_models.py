"""Classifiers by held-out accuracy, tokens and packing by exact checks."""

import random
import zlib

import numpy as np
import pytest

from mixtura.llm import toxicity as tox
from mixtura.llm.lattice import Lattice, best_states, product
from mixtura.llm.packing import Schedule, pack
from mixtura.llm.quality_pu import quality_classifier
from mixtura.llm.sentencepiece_scan import Model, decode, encode
from mixtura.llm.tokens import BpeEncoder

WORDS = [f"{a}{b}" for a in ("ra", "te", "mo", "li", "su", "ko") for b in ("n", "s", "nd", "le", "ra")]


def corpus(spark, bad):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(WORDS, k=rng.randint(30, 120))
        one = i % 6 == 0
        rows.append((i, bad(words, rng) if one else " ".join(words).capitalize() + "."))
        if i % 2:
            labels.append((i, int(not one), int(one)))
    labels += [(i, int(i % 6 != 0), int(i % 6 == 0)) for i in range(0, 900, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark, lambda w, r: " ".join(f"{x}###" for x in w) if r.random() < 0.5 else " ".join(x for x in w for _ in range(9)))
    got = quality_classifier(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got[~got.held_out]) and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_quality_hard_cases(docs, labels, empty):
    assert quality_classifier(docs, labels).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_classifier(docs, labels.filter("1 = 0")).filter("score = 0.5").count() == docs.count()
    assert quality_classifier(empty, labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    def insult(words, rng):
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(["vileone", "viletwo", "grimword"])
        return " ".join(words)

    docs, labels = corpus(spark, insult)
    got = tox.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97


def test_segments_are_the_maximal_ones():
    m = tox.Model({"bad": 2.0}, 0.5)
    rng = random.Random(3)
    for _ in range(200):
        words = rng.choices(["bad", "ok"], weights=[1, 3], k=rng.randint(0, 30))
        found = m.segments(words)
        scores = [2.0 if w == "bad" else -0.5 for w in words]
        best = max((sum(scores[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)), default=0)
        assert max((s for *_, s in found), default=0) == pytest.approx(max(0, best))
        assert all(sum(scores[a:b]) == pytest.approx(s) and s > 0 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:])) and sum(b - a for a, b, _ in found) >= words.count("bad")


def test_segments_of_a_million_hits_far_apart_in_linear_time():
    import time

    m = tox.Model({"vile": 1.0}, 0.2)
    began = time.perf_counter()
    n = len(m.segments((["vile"] + ["calm"] * 9) * 1_000_000))
    assert n == 1_000_000 and time.perf_counter() - began < 60


def test_decay_solves_its_equation():
    p, s = np.array([0.05, 0.95]), np.array([2.0, -0.3])
    assert p @ np.exp(tox._decay(p, s) * s) == pytest.approx(1)


def test_toxicity_hard_cases(docs, labels, empty):
    assert tox.toxicity(docs, labels).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert tox.toxicity(docs, labels.filter("1 = 0")).filter("score = 0").count() == docs.count()
    assert tox.toxicity(empty, labels).count() == 0


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, library = BpeEncoder(limit=50), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(0)
    alphabet = ["a", "B", "é", "日", " ", "  ", "\n", "\t", "'s", "12", ".", "<|endoftext|>", " the", "!?", " ", "𐍈"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        assert np.frombuffer(own.packed(text), dtype=own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, pieces, length):
    own = BpeEncoder()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, t in rows.items():
        ids = np.frombuffer(own.packed(t or ""), dtype=own.dtype).astype("<u4").tolist() + [1]
        at = 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    windows = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == windows.get(p.sequence_id, 0)
        windows[p.sequence_id] = p.offset + p.length
    assert sorted(windows) == list(range(len(windows))) and all(n == length for k, n in windows.items() if k < len(windows) - 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_is_exact_and_keeps_the_mixture(spark, parts):
    rng = random.Random(2)
    sources = ["a"] * 6 + ["b"] * 3 + ["c"]
    rows = [(i, rng.choice(sources), None if i == 7 else " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    pieces = pack(df, length=128).collect()
    check_packing({i: t for i, _, t in rows}, pieces, 128)
    of = {i: s for i, s, _ in rows}
    total = sum(p.length for p in pieces)
    for s in "abc":
        share = sum(p.length for p in pieces if of[p.doc_id] == s) / total
        sent = 0
        for k in range(max(p.sequence_id for p in pieces)):
            sent += sum(p.length for p in pieces if p.sequence_id == k and of[p.doc_id] == s)
            assert abs(sent - 128 * (k + 1) * share) <= 1


def test_schedule_sends_everything():
    s = Schedule([1000, 1, 37], 64)
    for q, n in enumerate([1000, 1, 37]):
        spans = list(s.pieces(q, 0, n))
        assert [x[2] for x in spans][0] == 0 and spans[-1][3] == n and all(a[3] == b[2] for a, b in zip(spans, spans[1:]))


def test_passages_have_places():
    model = tox.Model({"vile": 3.0, "awful": 2.5}, 0.2, decay=2.0, scale=0.1)
    text = "  A calm start, (Vile) and awful,  vile! words. Then " + "plain words " * 30 + "and 'awful' once"
    (found,) = model.passages(text, 0.01)
    assert text[found["start"] : found["end"]] == "Vile) and awful,  vile"
    assert found["score"] == pytest.approx(8.3) and found["expectation"] == pytest.approx(0.1 * len(tox.tokens(text)) * np.exp(-2 * 8.3))
    assert model.passages("", 0.01) == [] == model.passages("calm words", 0.01)


def test_evidence_has_no_ceiling():
    model = tox.Model({"vile": 3.0}, 0.2, decay=2.0, scale=0.1, weights=(-2.0, 0.5, 0.5, 0.1))
    scores = model.probability([model.found("vile " * n) for n in (1, 10, 100, 1000)])
    assert (np.diff(scores) > 0).all()


def test_packing_hard_cases(docs, empty):
    assert pack(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(empty).count() == 0


@pytest.mark.parametrize("chunk", [3, 11])
def test_scan_equals_the_library(spark, chunk):
    m = Model("piece_bpe_32k.model")
    rng = random.Random(chunk)
    rows = [(i, "".join(rng.choices("aaabcdethe  \n12é日𐍈.,", k=rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = encode(df, giant=20, chunk=chunk)
    by = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in got.collect()}
    assert by == {i: m.sp.encode(t) for i, t in rows}
    assert {r.doc_id: r.text for r in decode(got).collect()} == dict(rows)


def test_words_take_the_librarys_pieces():
    """Batches of words, with characters outside the vocabulary, runs of spaces and space marks."""
    m = Model("piece_bpe_32k.model")
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "e", "th", "ing", "Über", "日", "本", "𐍈", "\t", "\n", " ", "  ", "▁", ".", "12", "ß", "\u0301", "\ue000"], k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["x" * 300, "strange " * 50, "\x00", "▁", " ▁ ", " lead", "trail "]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in m.packed(texts)] == [m.sp.encode(t) for t in texts]
    assert [m.text_of(b) for b in m.packed(texts)] == [m.sp.decode(m.sp.encode(t)) for t in texts]


def test_unigram_weights_and_associativity():
    """Any grouping of the products gives the weight of the best path, found by brute force."""
    rng = random.Random(4)
    pieces = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -2.1, "aab": -2.4, "bb": -2.0}
    lat = Lattice(pieces, bpe=False)
    lat.words = False
    for _ in range(60):
        text = "".join(rng.choices("ab", k=rng.randint(5, 14)))
        best = {0: 0.0}
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 3) + 1):
                if i in best and text[i:j] in pieces:
                    best[j] = max(best.get(j, -1e9), best[i] + pieces[text[i:j]])
        cuts = [text[i : i + 4] for i in range(0, len(text), 4)]
        ms = [lat.transfer(text[max(0, 4 * k - 3) : 4 * k], text[4 * k : 4 * k + len(c) + 3], len(c), lambda t: 0.0) for k, c in enumerate(cuts)]
        left = ms[0]
        for x in ms[1:]:
            left = product(left, x)
        right = ms[-1]
        for x in ms[-2::-1]:
            right = product(x, right)
        assert left[0, ""][0, ""] == pytest.approx(best[len(text)]) == right[0, ""][0, ""]
        assert best_states(ms, (0, ""), (0, ""))[0] == (0, "")


def test_scan_hard_cases(docs, empty):
    assert encode(docs, giant=1000, chunk=700).count() == docs.count()
    assert encode(empty).count() == 0

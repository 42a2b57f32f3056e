"""Exact copies and near copies against brute force."""

import hashlib
import random

import pyarrow as pa
import pytest

from mixtura.llm import jaccard_join as jj
from mixtura.llm.components import components
from mixtura.llm.exact_dedup import exact_dedup

WORDS = [f"w{i}" for i in range(60)]


def texts(seed: int, n: int) -> list[str]:
    """Random texts, many of them edited copies, and shared passages."""
    rng = random.Random(seed)
    shared = " ".join(rng.choices(WORDS, k=40))
    out: list[str] = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words) if rng.random() < 0.8 else " ".join(words).upper())
        else:
            out.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 70))) + (f" {shared}" if rng.random() < 0.3 else ""))
    return out


def brute(rows: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(rows)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in rows}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 40)])
def test_components_match_brute_force(spark, seed, parts):
    rows = dict(enumerate(texts(seed, 160)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = rng.choices(WORDS, k=80)
    rows = {}
    for i in range(300):
        w = list(base)
        w[rng.randrange(80)] = f"u{i}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(30)
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(df, held_keys=50).collect()}
    assert got == brute(rows)


def test_long_lists_of_few_entries(spark):
    rows = dict(enumerate(texts(9, 120)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(20)
    assert {r.doc_id: r.component_id for r in jj.jaccard_components(df, short=2).collect()} == brute(rows)


def test_pair_lists_sort_out_runs():
    entries = [(5, 1, 0), (5, 2, 0), (9, 1, 5), (9, 2, 5)]
    rows = [(k, c, jj._pack(10, 10, 0 if k == 5 else 1), b, 0) for k, c, b in entries]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "cid", "pack", "before", "deal"])
    out = [r for b in jj._lists(jj.SHORT, jj.ROW)(iter([batch])) for r in b.to_pylist()]
    assert [(r["a"], r["b"], r["n"]) for r in out] == [(1, 2, 1)]


def test_join_hard_cases(docs, empty):
    got = jj.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[0, 0] == 0 and by[2, 0] == 2 and by[5, 1] == by[6, 1] == 5 and by[None, 1] is None
    assert jj.jaccard_components(empty).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("block,parts", [(4, 1), (3, 6), (4096, 4)])
def test_dedup_matches_brute_force(spark, block, parts):
    rng = random.Random(block)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 9))) if rng.random() < 0.9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in exact_dedup(df, block=block).collect()} == want


def test_dedup_hard_cases(docs, empty):
    got = exact_dedup(docs, block=64, local_bytes=1000).collect()
    assert len(got) == docs.count()
    blank = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in blank} == {1} and sum(r.kept for r in blank) == 1 and {r.group_size for r in blank} == {3}
    assert [r.kept for r in got if r.doc_id is None] == [False] or [r.keep_id for r in got if r.doc_id is None] == [None]
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_dealt_lists_and_small_rows(spark, parts):
    """Long lists dealt to several tasks, rows of few entries, clusters of few sets."""
    rng = random.Random(parts)
    base = rng.choices(WORDS, k=90)
    rows = {}
    for i in range(240):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(90)] = f"u{rng.randrange(400)}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(parts)
    want = brute(rows)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in jj.jaccard_components(df, row=16, dealt=40, variants=3).collect()} == want


def test_marks_never_rule_out_a_link():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 400)
        base = [rng.getrandbits(64) for _ in range(n)]
        edited = [x if rng.random() < 0.88 else rng.getrandbits(64) for x in base]
        a, b = (jj.np.unique(jj.np.array(x, dtype=jj.np.uint64)) for x in (base, edited))
        left, right = jj._marks([jj.mark_of(a)]), jj._marks([jj.mark_of(b)])
        zero = jj.np.zeros(1, dtype=int)
        sure, _ = jj._excess(left, right, zero, zero)
        differ = len(a) + len(b) - 2 * jj.overlap(a, b)
        assert sure[0] <= 7 * differ - len(a) - len(b)
        if jj.linked(jj.overlap(a, b), len(a), len(b)):
            assert sure[0] <= 0


def test_numbering_does_not_follow_arrival(spark):
    """Rows that reach a naming round in another order leave it with the same order and names."""
    from mixtura.llm import exact_dedup as ed

    rng = random.Random(7)
    names = [[rng.randrange(6) for _ in range(4)] for _ in range(30)]
    rows = [(rng.choice([None, i]), f"{names[i % 30]}", 4, names[i % 30]) for i in range(60)]  # equal digests: equal texts
    outs = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, sha string, blocks long, names array<long>").coalesce(1)
        once = ed._exchanged(df.mapInArrow(ed._local(ed._pairs_of, 1 << 20, ed.SLICES), ed._ROW)).mapInArrow(ed._answered, ed._ROW)
        outs.append(once.select("task", "doc_id", "sha", "names").collect())
    assert outs[0] == outs[1] == outs[2]

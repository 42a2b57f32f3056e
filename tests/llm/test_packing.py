"""Mixture control with many small sources and with given targets."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from test_models import check_packing

from mixtura.llm.packing import Schedule, pack


def taken(pieces, of):
    """Tokens of each source in each window."""
    out = Counter()
    for p in pieces:
        out[p.sequence_id, of[p.doc_id]] += p.length
    return out


def test_a_hundred_even_sources_each_get_their_share(spark):
    rows = [(i, f"s{i % 100}", "one two three four five six seven") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    pieces = pack(df, length=256).collect()
    check_packing({i: t for i, _, t in rows}, pieces, 256)
    of = {i: s for i, s, _ in rows}
    got, full = taken(pieces, of), max(p.sequence_id for p in pieces)
    for s in set(of.values()):
        sent = 0
        for k in range(full):
            sent += got[k, s]
            assert abs(got[k, s] - 2.56) <= 1 and abs(sent - 2.56 * (k + 1)) <= 1


def test_targets_hold_until_a_source_ends(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), " ".join(rng.choices(["stone", "river", "cloud"], k=rng.randint(1, 40)))) for i in range(200)]
    rows.append((200, None, "no source"))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    pieces = pack(df, length=64, targets={"a": 0.25, "b": 0.5, "": 0.25, "absent": 1}).collect()
    check_packing({i: t for i, _, t in rows}, pieces, 64)
    got = taken(pieces, {i: s for i, s, _ in rows})
    last_b = max(k for k, s in got if s == "b")
    for k in range(1, last_b):
        assert abs(got[k, "a"] - 64 / 3) <= 1 and abs(got[k, "b"] - 128 / 3) <= 1
    with pytest.raises(ValueError):
        pack(df, targets={"a": 1.0, "b": 1.0})


def test_schedules_of_many_shapes_fill_every_window():
    rng = random.Random(4)
    for _ in range(60):
        totals = [rng.randint(1, 900) for _ in range(rng.randint(1, 40))]
        targets = [Fraction(rng.randint(1, 9)) for _ in totals] if rng.random() < 0.5 else None
        schedule, windows = Schedule(totals, 32, targets), {}
        for q, n in enumerate(totals):
            at = 0
            for k, offset, start, stop in schedule.pieces(q, 0, n):
                assert start == at < stop
                at = stop
                windows.setdefault(k, []).append((offset, stop - start))
            assert at == n
        for k in range(len(windows)):
            at = 0
            for offset, n in sorted(windows[k]):
                assert offset == at
                at += n
            assert at == min(32, sum(totals) - 32 * k)

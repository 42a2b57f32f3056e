"""Prefix trie and structure repair against brute force, and their hard cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mixtura.llm import edit_lattice as el
from mixtura.llm.centroid import subtree_sums
from mixtura.llm.ordered import numbered
from mixtura.llm.prefix_trie import rebuilt_trie
from mixtura.llm.repair import audits, repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, depth long, hash string"


def table(spark, rows, parts=3):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 7, "x") for r in rows], SCHEMA).repartition(parts)


def own_turns(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in own.items()}


def brute_trie(rows):
    own, built = own_turns(rows), {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ended = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ended(p).encode()).hexdigest()) for p, m in members.items())


def some_turns(seed, n=60):
    rng = random.Random(seed)
    rows = [(c, t if t or rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, "", "c" * 5])) for c in [*range(-7, n), 1000] for t in range(rng.choice([1, 2, 3, 9, 15, 30]))]
    return [*rows, (None, 1, "user", "no conversation")]


@pytest.mark.parametrize("members,levels", [(256, 1024), (3, 4)])
def test_trie_matches_brute_force(spark, members, levels):
    rows = some_turns(3)
    got = rebuilt_trie(table(spark, rows), members=members, levels=levels).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_hot_conversation(spark):
    assert rebuilt_trie(table(spark, [])).collect() == []
    rows = [(c, t, "user", "same") for c in range(40) for t in range(3)] + [(c, 0, None, None) for c in (5, 6)]
    got = rebuilt_trie(table(spark, rows, 7)).collect()
    assert {r.conv_id for r in got if r.depth == 0} == {0} and max(r.n_convs for r in got) == 40


@pytest.mark.parametrize("seed", range(4))
def test_centroid_sums(seed):
    rng = np.random.default_rng(seed)
    for shape in ("any", "chain", "star"):
        n = int(rng.integers(1, 200))
        parent, depth = np.full(n, -1), np.zeros(n, int)
        for i in range(1, n):
            if rng.random() < 0.95:
                parent[i] = i - 1 if shape == "chain" else 0 if shape == "star" else rng.integers(0, i)
                depth[i] = depth[parent[i]] + 1
        mixed = rng.permutation(n)
        back = np.argsort(mixed)
        parent, depth, values = np.where(parent[mixed] >= 0, back[parent[mixed]], -1), depth[mixed], rng.integers(-9, 9, (n, 2))
        want = values.copy()
        for i in np.argsort(-depth, kind="stable"):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert (subtree_sums(parent, depth, values) == want).all()


def test_places_and_running_xor_over_partitions(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.getrandbits(60)) for k, n in ((1, 500), (2, 1), (3, 30)) for t in range(n)]
    got = numbered(spark.createDataFrame(rows, "k long, t long, x long").repartition(5), "k", ["t"], ["x"]).collect()
    run, want = defaultdict(int), []
    for k, t, x in rows:
        run[k] ^= x
        want.append((k, t, run[k], t))
    assert sorted(map(tuple, got)) == want


def every_audit(codes):
    """The cheapest audit by trying all edits, with three insertions in a place at most."""
    best = (10**9, "")

    def go(i, q, cost, audit, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and q in el.ENDS:
            best = min(best, (cost, audit))
        if inserted < 3:
            go(i, el.TO[el.NEXT[q]], cost + 3, audit + "I", inserted + 1)
        for w, e, to in el._moves(codes[i], q) if i < len(codes) else []:
            go(i + 1, to, cost + w, audit + e, 0)

    go(0, 0, 0, "", 0)
    return best


def test_audits_match_all_edits():
    rng = random.Random(2)
    for _ in range(400):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randrange(6)))
        assert el.solve(codes) == every_audit(codes)


def test_stretches_join_to_the_whole(spark):
    rng = random.Random(4)
    convs = {c: "".join(rng.choice("suaxSUAX-uauaua") for _ in range(rng.choice([1, 9, 40, 130]))) for c in range(30)}
    df = spark.createDataFrame([(c, i, x) for c, codes in convs.items() for i, x in enumerate(codes)], "conv_id long, place long, code string").repartition(4)
    for chunk, fan in ((1024, 16), (8, 2)):
        got = {r.conv_id: (r.cost, r.audit) for r in audits(df, chunk, fan).collect()}
        assert got == {c: el.solve(codes) for c, codes in convs.items()}


def brute_repair(rows):
    convs, out = defaultdict(list), {}
    for c, t, r, x in rows:
        if c is None:
            continue
        convs[c] = convs[c]
        how = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how:
            row = (t is not None, t or 0, "user" if how == 4 else r, "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x)
            convs[c] += [row] * (1 + (how == 3))
    for c, v in convs.items():
        v.sort()
        seen, codes, faults, lines = set(), "", [], []
        for _, _, r, x in v:
            words = re.findall(r"[^\x20\x09-\x0D]+", x)
            fault = "blank" if not words else "duplicate" if (r, x) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
            seen.add((r, x))
            initial = r[:1] if r[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            faults.append(fault)
        cost, audit = el.solve(codes)
        for (_, _, r, x), step in itertools.zip_longest(v, el.steps(codes, audit)[:-1]):
            lines += [{"u": "user:", "a": "assistant:"}[k] for k in step[:-1]]
            lines += [] if step[-1] == "D" else [f"{ {'U': 'user', 'A': 'assistant'}.get(step[-1], r)}:{x}"]
        lines += [{"u": "user:", "a": "assistant:"}[k] for k in el.steps(codes, audit)[-1]]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
        turns = [t for known, t, *_ in v if known]
        illegal = sum(p[2][:1] + q[2][:1] not in ("su", "ua", "au") for p, q in itertools.pairwise(v))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1024, 4])
def test_repair_matches_brute_force(spark, chunk):
    rng = random.Random(6)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, "", "tool"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2], rng.choice([None, "", " \t", "Yes.", "No", f"t{t}!", f"é {t}"])) for c in range(80) for t in range(rng.choice([1, 2, 5, 14]))]
    rows += [(None, 1, "user", "none"), (200, None, None, None), (201, 3, "user", "x" * 50_000)]
    rows += [(c, 0, "user", "a.") for c in range(300, 330)]
    once = list(dict.fromkeys((c, t, r, x) for c, t, r, x in rows if (c, t) not in {(None, None)}))
    distinct = {}
    for c, t, r, x in once:  # one row a turn: rows of one turn with other texts have an order of their own
        distinct.setdefault((c, t), (c, t, r, x))
    rows = list(distinct.values())
    got = {r.conv_id: tuple(r)[1:] for r in repair(table(spark, rows, 5), damage=True, chunk=chunk).collect()}
    assert got == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert repair(table(spark, []), damage=True).collect() == []

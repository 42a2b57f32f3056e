"""Exact set similarity join on word shingles, using the relations between sets.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is 0.75 or more;
documents reachable over links form a component.

1. One pass counts shingles in a hashed table of fixed size over all documents; shingles are then
   ordered from rare to common. Any common order is right; this one keeps passages that many
   documents share out of the prefixes.
2. Each map task clusters its own documents: a set that links with a leader found over its prefix
   joins it, stored as its difference from the leader. A cluster enters each prefix shingle once,
   with the range of its sizes and its first position. So a group of copies adds one index entry
   for each task and shingle, however many copies there are. Each different set of a cluster leaves a
   mark, the parities of its shingles over ``MARK_BITS`` places: two sets differ in at least as many
   shingles as their marks do in bits, so marks rule pairs out before any set is sent.
3. Index lists by shingle are sorted by position and cut into blocks; whole blocks are skipped whose
   positions or sizes rule out the overlap they need. Short lists give all their pairs, long ones
   pair each cluster with the least id first. Lists that the counts show to be very long are dealt
   to several tasks, whose blocks meet later.
4. Each cluster is verified against its most frequent smaller partner, then components are made.
   Only pairs that would join two components are verified next: of a long list, first a forest of
   the likeliest pairs over its components, and when these are joined, all that are left. No pair
   within a component is made, so a group of near copies costs as many pairs as it has members.
5. A pair of clusters is answered from the overlap of its leaders: a member's overlap follows from
   it by the stored differences, and is worked out only where these could reach the threshold.

Shingles are 64-bit hashes. What is verified is the whole set of each document.

Cases: a null or empty text has the empty set and links with nothing. A text of fewer than five
words has one shingle, the whole sequence. A null id is returned with a null component. Rows that
repeat an id count as one vertex. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written
from mixtura.llm.components import components

WIDTH = 5
#: Places of the table of shingle counts; a fixed 2 MB once ranked.
PLACES = 1 << 20
#: Bytes of a table that go to the driver as one row.
STRETCH = 1 << 15
#: Lists up to this length give all their pairs at once.
SHORT = 8
#: Entries of a long list that are skipped or read together.
BLOCK = 32
#: Entries of a long list that make one row.
ROW = 4096
#: Entries of one key that go to one task; a key with more (by the counts) is dealt to several.
DEALT = 1 << 16
#: Bits of a set's mark.
MARK_BITS = 1024
#: Different sets that a cluster holds; copies of its leader do not count.
VARIANTS = 64
#: Largest number of bits of the filter of ids that are to be verified (8 MB).
FILTER_BITS = 1 << 26
_TOP = (1 << 21) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - WIDTH + 1
    total = h[:n] * _ODD[0]
    for j in range(1, WIDTH):
        total += h[j : j + n] * _ODD[j]
    return np.unique(_mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= 75 * (n + m - common) and common > 0


def _gathered(df: DataFrame, own, fold: np.ufunc, dtype: str, places: int, last=None) -> np.ndarray:
    """One table of ``places`` from all tasks: ``own`` makes a task's, ``fold`` joins two, ``last``
    shrinks what goes to the driver. Tables travel as stretches, those of zeros only not at all."""
    step = STRETCH // np.dtype(dtype).itemsize

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = own(batches)
        used = [i for i in range(0, places, step) if table[i : i + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // step for i in used], pa.int32()), pa.array([zlib.compress(table[i : i + step].tobytes(), 1) for i in used], pa.binary())], names=["stretch", "part"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(part.as_buffer()), dtype=dtype)
                held[i] = fold(held[i], part) if i in held else part
        out = [(last(v) if last else v).tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(out, pa.binary())], names=["stretch", "part"])

    final = np.dtype("<u2") if last else np.dtype(dtype)
    table = np.zeros(places, dtype=final)
    for r in df.mapInArrow(made, "stretch int, part binary").repartition("stretch").mapInArrow(folded, "stretch int, part binary").collect():  # the table's size
        part = np.frombuffer(r.part, dtype=final)
        table[r.stretch * step : r.stretch * step + len(part)] = part
    return table


def _rank(counts: np.ndarray) -> np.ndarray:
    return np.minimum(65535, 2000 * np.log2(1.0 + counts)).astype("<u2")


def shingle_ranks(docs: DataFrame) -> np.ndarray:
    """For each place of the table, how common its shingles are, on a logarithmic scale."""

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table, held, size = np.zeros(PLACES, dtype="<i8"), [], 0
        for batch in batches:
            for text in batch.column(0):
                at = (shingles(text.as_py()) & np.uint64(PLACES - 1)).astype(np.int64)
                held.append(at)
                size += len(at)
                if size > 4 * PLACES:
                    table += np.bincount(np.concatenate(held), minlength=PLACES)
                    held, size = [], 0
        return table + (np.bincount(np.concatenate(held), minlength=PLACES) if held else 0)

    return _gathered(docs.select("text"), counts, np.add, "<i8", PLACES, _rank)


def mark_of(shingle_set: np.ndarray) -> bytes:
    """The set's size and the parities of its shingles over the mark's places."""
    odd = np.bincount((shingle_set >> np.uint64(64 - MARK_BITS.bit_length() + 1)).astype(np.int64), minlength=MARK_BITS) & 1
    return len(shingle_set).to_bytes(8, "little") + np.packbits(odd.astype(bool)).tobytes()


def _marks(packed: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed marks: how many each holds, and sizes and bits of all."""
    counts = np.array([len(p) for p in packed], dtype=np.int64) // (8 + MARK_BITS // 8)
    words = np.frombuffer(b"".join(packed), dtype="<u8").reshape(-1, 1 + MARK_BITS // 64)
    return counts, words[:, 0].astype(np.int64), words[:, 1:]


def _excess(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (i, j) of clusters: seven times the least number of shingles in which sets of the
    two surely differ, less the sizes together, and the same for the likely number. Linked sets of n
    and m differ in (n + m) / 7 at most."""
    (counts, sizes, bits), (counts_r, sizes_r, bits_r) = left, right
    first, first_r = np.cumsum(counts) - counts, np.cumsum(counts_r) - counts_r
    sure, likely = np.zeros(len(i)), np.zeros(len(i))
    each = counts[i] * counts_r[j]
    at = 0
    while at < len(i):
        # So many pairs at once as have some thousands of pairs of sets.
        upto = at + max(1, int(np.searchsorted(np.cumsum(each[at : at + (1 << 15)]), 1 << 15, "right")))
        a, b, n = i[at:upto], j[at:upto], each[at:upto]
        starts = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(starts, n)
        width = np.repeat(counts_r[b], n)
        x, y = np.repeat(first[a], n) + k // width, np.repeat(first_r[b], n) + k % width
        apart = np.bitwise_count(bits[x] ^ bits_r[y]).sum(axis=1, dtype=np.int64)
        both = sizes[x] + sizes_r[y]
        sure[at:upto] = np.minimum.reduceat(7 * apart - both, starts)
        guess = np.log(np.maximum(1 - 2 * apart / MARK_BITS, 1e-9)) / np.log(1 - 2 / MARK_BITS)
        likely[at:upto] = np.minimum.reduceat(7 * guess - both, starts)
        at = upto
    return sure, likely


def ordered(shingle_set: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set's keys from rare to common. A key is the rank and 48 bits of the hash."""
    rank = ranks[(shingle_set & np.uint64(PLACES - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((rank << np.uint64(48)) | (shingle_set >> np.uint64(16)))


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _pack(least: int, most: int, at: int) -> int:
    if most >= _TOP:  # beyond what is packed: no size or position rules it out
        least, most, at = min(least, _TOP), _TOP, 0
    return least << 42 | most << 21 | at


class Cluster:
    def __init__(self, doc_id: int, text: bytes, own: np.ndarray):
        self.ids, self.text, self.own = [doc_id], text, own
        self.members: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.marks = {mark_of(own): None}
        self.least = self.most = len(own)
        self.slots: dict[int, int] = {}
        self.at: list[int] = []
        self.prior: list[int] = []

    def enter(self, keys: list[int]) -> None:
        """Keep each key's first position, and the slot of the key before it there."""
        before = -1
        for at, key in enumerate(keys):
            slot = self.slots.setdefault(key, len(self.at))
            if slot == len(self.at):
                self.at.append(at)
                self.prior.append(before)
            elif at < self.at[slot]:
                self.at[slot], self.prior[slot] = at, before
            before = slot

    def add(self, doc_id: int, other: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.least, self.most = min(self.least, len(other)), max(self.most, len(other))
        self.marks[mark_of(other)] = None
        self.members.append((doc_id, len(other), np.setdiff1d(other, self.own, assume_unique=True), np.setdiff1d(self.own, other, assume_unique=True)))


_MEMBER = "struct<doc_id:long,n:long,added:array<long>,removed:array<long>>"
_CLUSTER = f"cid long, text binary, doc_id long, n long, members array<{_MEMBER}>, keys array<long>, packs array<long>, priors array<int>, marks binary"
_LONGS = pa.list_(pa.int64())
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("added", _LONGS), ("removed", _LONGS)]))
_CLUSTER_ARROW = pa.schema([("cid", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("members", _MEMBERS), ("keys", _LONGS), ("packs", _LONGS), ("priors", pa.list_(pa.int32())), ("marks", pa.binary())])


def _clusters(ranks_of, held_keys: int, variants: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of.value
        open_: list[Cluster] = []
        leader_of: dict[int, int] = {}

        def row(c: Cluster) -> tuple:
            members = [{"doc_id": i, "n": n, "added": a.view(np.int64), "removed": r.view(np.int64)} for i, n, a, r in c.members]
            keys = np.fromiter(c.slots, dtype=np.uint64, count=len(c.slots)).view(np.int64)
            return min(c.ids), c.text, c.ids[0], len(c.own), members, keys, [_pack(c.least, c.most, at) for at in c.at], c.prior, b"".join(c.marks)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _CLUSTER_ARROW)], schema=_CLUSTER_ARROW)

        def flushed() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(open_), 512):
                yield batch_of([row(c) for c in open_[i : i + 512]])
            open_.clear()
            leader_of.clear()

        for batch in batches:
            alone = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                own = shingles(text)
                n = len(own)
                if not n or doc_id is None:
                    alone.append((doc_id, None, doc_id, n, [], [], [], [], None))
                    continue
                keys = ordered(own, ranks)[: prefix_length(n)].tolist()
                near = Counter(i for i in map(leader_of.get, keys) if i is not None)
                for i, _ in near.most_common(3):
                    c = open_[i]
                    common = overlap(own, c.own)
                    if linked(common, n, len(c.own)) and (len(c.marks) < variants or common == n == len(c.own)):
                        c.add(doc_id, own)
                        c.enter(keys)
                        break
                else:
                    c = Cluster(doc_id, text, own)
                    c.enter(keys)
                    for key in keys:
                        if (i := leader_of.get(key)) is None or len(open_[i].marks) >= variants:
                            leader_of[key] = len(open_)
                    open_.append(c)
                    if len(leader_of) > held_keys:
                        yield from flushed()
            if alone:
                yield batch_of(alone)
        yield from flushed()

    return run


def _unpack(packs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packs >> 42, (packs >> 21) & _TOP, packs & _TOP


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two entries of a list can belong to linked sets, by sizes and positions. The overlap
    of linked sets is at least 3/7 of their sizes together, and 3/4 of the larger."""
    (la, ma, pa_), (lb, mb, pb) = _unpack(a), _unpack(b)
    free = (ma == _TOP) | (mb == _TOP)
    return free | ((4 * ma >= 3 * lb) & (4 * mb >= 3 * la) & (7 * np.minimum(ma - pa_, mb - pb) >= 3 * (la + lb)))


_CANDIDATE = "a long, b long, n long, key long, block long, alone boolean, cids array<long>, packs array<long>, befores array<long>"
_CANDIDATE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("alone", pa.bool_()), ("cids", _LONGS), ("packs", _LONGS), ("befores", _LONGS)])


def _candidates(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), type=f.type) for f in _CANDIDATE_ARROW], schema=_CANDIDATE_ARROW)


def _lists(short: int, row: int):
    """Entries sorted by key and deal: pairs of short lists, pairs of long ones with their least id,
    and the long lists themselves, sorted by position and cut into rows.

    Near copies share runs of keys. Two entries with the same key before them met there already,
    at smaller positions and so under weaker bounds; they are told of only where a run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def pairs_of(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, before_a: np.ndarray, before_b: np.ndarray) -> np.ndarray:
            ok = (a != b) & ((before_a != before_b) | (before_a == 0)) & _possible(x, y)
            return np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], axis=1)

        def made(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, cid, pack, before, deal = rows
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])]))
            lengths = np.diff(np.append(starts, len(key)))
            size_of = np.where(deal[starts] == 0, lengths, short + 1)  # of a dealt list, each part is kept
            found, long_lists = [], []
            for n in np.unique(lengths[(size_of > 1) & (size_of <= short)]):
                at = starts[(lengths == n) & (size_of == n)][:, None] + np.arange(n)[None, :]
                c, p, f = cid[at], pack[at], before[at]
                found += [pairs_of(c[:, i], c[:, j], p[:, i], p[:, j], f[:, i], f[:, j]) for i in range(n) for j in range(i + 1, n)]
            for start, n in zip(starts[size_of > short], lengths[size_of > short]):
                c, p, f = (v[start : start + n] for v in (cid, pack, before))
                # A list whose entries all stood together in the list before is part of that one.
                if not deal[start] and f[0] and (f == f[0]).all():
                    continue
                least = np.full(n, c.argmin())
                found.append(pairs_of(c[least], c, p[least], p, f[least], f))
                order = np.argsort(p & _TOP, kind="stable")
                for i in range(0, n, row):
                    o = order[i : i + row]
                    long_lists.append((key[start], (deal[start] << 32) + i // row, n <= row and not deal[start], c[o], p[o], f[o]))
            if found and sum(map(len, found)):
                pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield _candidates(a=pairs[:, 0], b=pairs[:, 1], n=n)
            for i in range(0, len(long_lists), 256):
                yield _candidates(**dict(zip(("key", "block", "alone", "cids", "packs", "befores"), map(list, zip(*long_lists[i : i + 256])))))

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]))
            size += batch.num_rows
            if size > 1 << 18:
                rows = np.concatenate(held, axis=1)
                cut = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[4] != rows[4, -1]))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield from made(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield from made(np.concatenate(held, axis=1))

    return run


class _Entries:
    """Entries of a row, by position, and the bounds of each block of them."""

    def __init__(self, entries: pa.StructArray):
        *columns, marks = entries.flatten()
        order = np.argsort(columns[1].to_numpy() & _TOP, kind="stable")
        self.cid, self.pack, self.before, self.label = (c.to_numpy()[order] for c in columns)
        self.marks = _marks(marks.take(pa.array(order)).to_pylist())
        self.least, self.most, self.at = _unpack(self.pack)
        edges = np.arange(0, len(order), BLOCK)
        self.edges, self.n = edges, len(order)
        self.free = np.maximum.reduceat(self.most, edges) == _TOP
        self.reach = np.maximum.reduceat(self.most - self.at, edges)
        self.low, self.high = np.minimum.reduceat(self.least, edges), np.maximum.reduceat(self.most, edges)
        self.one = np.where(np.minimum.reduceat(self.label, edges) == np.maximum.reduceat(self.label, edges), self.label[edges], -1)


def _crossing(x: _Entries, y: _Entries, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries with different labels that sizes and positions leave possible. Blocks
    no entry of which can reach the overlap that the other block needs are skipped."""
    for k, edge in enumerate(x.edges):
        open_ = x.free[k] | y.free | ((7 * np.minimum(y.reach, x.reach[k]) >= 3 * (y.low + x.low[k])) & (4 * y.high >= 3 * x.low[k]) & (4 * x.high[k] >= 3 * y.low))
        open_ &= (y.one != x.one[k]) | (x.one[k] == -1)
        if same:
            open_[:k] = False
        for some in np.array_split(np.flatnonzero(open_), max(1, open_.sum() // 64)):
            if not len(some):
                continue
            j = (y.edges[some][:, None] + np.arange(BLOCK)).ravel()
            j = j[j < y.n]
            i = np.arange(edge, min(x.n, edge + BLOCK))
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            ok = (x.label[i] != y.label[j]) & (x.cid[i] != y.cid[j]) & ((x.before[i] != y.before[j]) | (x.before[i] == 0))
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            ok = _possible(x.pack[i], y.pack[j])
            yield i[ok], j[ok]


def _across(whole: bool):
    """From rows of long lists with the label of each entry: the pairs across labels that sizes,
    positions and marks leave possible; if not ``whole``, only the likely ones of a forest over labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(*batch.columns):
                x = _Entries(left.values)
                y = _Entries(right.values) if right.is_valid else x
                found = []
                for i, j in _crossing(x, y, not right.is_valid):
                    sure, likely = _excess(x.marks, y.marks, i, j)
                    ok = (sure if whole else likely) <= 0
                    found.append((i[ok], j[ok], likely[ok]))
                i, j, likely = (np.concatenate(v) for v in zip(*found)) if found else ((), (), ())
                if not len(i):
                    continue
                if not whole:
                    order = np.argsort(likely, kind="stable")
                    i, j = i[order], j[order]
                    tree = _forest(x.label[i], y.label[j])
                    i, j = i[tree], j[tree]
                pairs = np.unique(np.sort(np.stack([x.cid[i], y.cid[j]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """The places, in order, at which two labels meet that no earlier ones have joined."""
    root: dict[int, int] = {}

    def of(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    kept = []
    for k, (v, w) in enumerate(zip(left.tolist(), right.tolist())):
        v, w = of(v), of(w)
        if v != w:
            root[v] = w
            kept.append(k)
    return kept


def _answers(a: tuple, b: tuple) -> bool:
    """Whether any document of one cluster links with any of the other."""
    (own_a, members_a), (own_b, members_b) = a, b
    common = overlap(own_a, own_b)
    if linked(common, len(own_a), len(own_b)):
        return True
    side = lambda own, members: [(len(own), 0, None, None), *((n, len(added), added, removed) for n, added, removed in members)]
    left, right = side(own_a, members_a), side(own_b, members_b)
    n, more = np.array([x[0] for x in right]), np.array([x[1] for x in right])
    for size, own_more, added, removed in left:
        most = np.minimum(common + own_more + more, np.minimum(size, n))
        for j in np.flatnonzero(100 * most >= 75 * (size + n - most)):
            # From the leaders' overlap, by what each member adds to and leaves out of its leader.
            x = own_a if added is None else np.union1d(np.setdiff1d(own_a, removed, assume_unique=True), added)
            o = common if added is None else common - overlap(removed, own_b) + overlap(added, own_b)
            _, _, added_b, removed_b = right[j]
            if added_b is not None:
                o += overlap(added_b, x) - overlap(removed_b, x)
            if linked(o, size, int(n[j])):
                return True
    return False


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[int, np.ndarray] = {}

    def own(cid: int, text: bytes) -> np.ndarray:
        if cid not in cache:
            if len(cache) > 200:
                cache.clear()
            cache[cid] = shingles(text)
        return cache[cid]

    def members(row: pa.ListScalar) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of the members that differ from their leader: size, shingles added, shingles left out."""
        if not row.is_valid or not len(row):
            return []
        _, n, added, removed = row.values.flatten()
        of = lambda x: x.values.to_numpy().view(np.uint64)
        return [(k.as_py(), of(x), of(y)) for k, x, y in zip(n, added, removed) if len(x) or len(y)]

    for batch in batches:
        out = []
        for a, b, text_a, members_a, text_b, members_b in zip(*batch.columns):
            a, b = a.as_py(), b.as_py()
            if _answers((own(a, text_a.as_py()), members(members_a)), (own(b, text_b.as_py()), members(members_b))):
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _verify(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The pairs (a, b) of clusters that link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * pairs.count()).bit_length()))
    place = F.pmod(F.xxhash64("cid"), F.lit(bits))

    def asked_bits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(table, at // 8, (1 << (at % 8)).astype(np.uint8))
        return table

    asked = clusters.sparkSession.sparkContext.broadcast(_gathered(ids.select(place.alias("p")), asked_bits, np.bitwise_or, "u1", bits // 8))  # of FILTER_BITS at most

    @F.pandas_udf("boolean")
    def may_be_asked(p: pd.Series) -> pd.Series:
        v = p.to_numpy()
        return pd.Series((asked.value[v // 8] >> (v % 8).astype(np.uint8)) & 1 == 1)

    # Most clusters are in no pair; the filter keeps their texts out of the shuffles.
    some = written(clusters.filter("cid IS NOT NULL AND text IS NOT NULL").select("cid", "text", "members").filter(may_be_asked(place)), "asked-clusters")
    side = lambda k: some.select(F.col("cid").alias(k), F.col("text").alias(f"text_{k}"), F.col("members").alias(f"members_{k}"))
    met = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return met.select("a", "b", "text_a", "members_a", "text_b", "members_b").mapInArrow(_verified, "a long, b long")


def _unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n, marks_a, marks_b) that the marks do not rule out."""
    for batch in batches:
        if batch.num_rows:
            at = np.arange(batch.num_rows)
            sure, _ = _excess(*(_marks(batch.column(i).to_pylist()) for i in (3, 4)), at, at)
            yield batch.select([0, 1, 2]).filter(pa.array(sure <= 0))


def _crossing_pairs(lists: DataFrame, labels: DataFrame, marks: DataFrame, whole: bool) -> DataFrame:
    """(a, b) from the long lists' rows (key, block, alone, cid, pack, before), across labels."""
    labelled = lists.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    entry = F.struct("cid", "pack", "before", "label", "marks").alias("e")
    rows = labelled.join(mixed, "key").join(marks, "cid").select("key", "block", "alone", entry).groupBy("key", "block", "alone").agg(F.collect_list("e").alias("entries"))
    none = F.lit(None).cast(rows.schema["entries"].dataType)
    own = rows.select("entries", none.alias("others"))
    # Rows of one list meet two by two.
    parts = rows.filter("NOT alone").select("key", "block", "entries")
    met = parts.join(parts.toDF("key", "other", "others"), "key").filter("block < other").select("entries", "others")
    return own.union(met).mapInArrow(_across(whole), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_keys: int = 400_000, short: int = SHORT, row: int = ROW, dealt: int = DEALT, variants: int = VARIANTS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ranks = spark.sparkContext.broadcast(shingle_ranks(source))
    clusters = written(source.mapInArrow(_clusters(ranks, held_keys, variants), _CLUSTER), "clusters")
    marks = clusters.filter("marks IS NOT NULL").select("cid", "marks")
    before = F.transform("priors", lambda i: F.when(i >= 0, F.get("keys", i)).otherwise(F.lit(0).cast("long")))
    entries = clusters.select("cid", "keys", "packs", before.alias("before")).select("cid", F.explode(F.arrays_zip("keys", "packs", "before")).alias("e")).select(F.col("e.keys").alias("key"), "cid", F.col("e.packs").alias("pack"), F.col("e.before").alias("before"))
    # A key's rank tells how many documents hold it, with what else falls on its place.
    others = 4 * float(np.exp2(ranks.value / 2000).mean())
    deals = F.ceil((F.pow(F.lit(2.0), F.shiftrightunsigned("key", 48) / 2000) - others) / dealt)
    entries = entries.withColumn("deal", F.when(deals > 1, 1 + F.pmod(F.xxhash64("cid"), deals)).otherwise(F.lit(0).cast("long")))
    candidates = written(entries.repartition("key", "deal").sortWithinPartitions("key", "deal").mapInArrow(_lists(short, row), _CANDIDATE), "candidates")
    met = candidates.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    met = met.join(marks.toDF("b", "marks_b"), "b").join(marks.toDF("a", "marks_a"), "a")
    pairs = written(met.select("a", "b", "n", "marks_a", "marks_b").mapInArrow(_unmarked, "a long, b long, n long"), "pairs")
    # Each cluster with the smaller partner that it shares most prefix shingles with.
    done = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "first-pairs")
    links = written(_verify(done, clusters), "first-links")
    labels = written(components(links), "first-labels")
    entry = F.explode(F.arrays_zip("cids", "packs", "befores")).alias("e")
    lists = written(candidates.filter("cids IS NOT NULL").select("key", "block", "alone", entry).select("key", "block", "alone", F.col("e.cids").alias("cid"), F.col("e.packs").alias("pack"), F.col("e.befores").alias("before")), "long-lists")
    for whole in (False, True):
        of = lambda k: labels.select(F.col("v").alias(k), F.col("label").alias(f"label_{k}"))  # noqa: B023, E731
        open_pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
        asked = written(open_pairs.union(_crossing_pairs(lists, labels, marks, whole)).distinct().join(done, ["a", "b"], "left_anti"), "open-pairs")
        if asked.isEmpty():
            continue
        more = written(_verify(asked, clusters), "more-links")
        done = done.union(asked)
        if not more.isEmpty():
            links = links.union(more)
            labels = written(components(links), "labels")
    member = F.explode(F.concat(F.array(F.struct("doc_id", "n")), F.transform(F.coalesce("members", F.array().cast(f"array<{_MEMBER}>")), lambda m: F.struct(m["doc_id"].alias("doc_id"), m["n"].alias("n")))))
    rows = clusters.select("cid", member.alias("m")).select("cid", F.col("m.doc_id").alias("doc_id"), F.col("m.n").alias("n_shingles"))
    return rows.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("label", "cid", "doc_id").alias("component_id"))

"""Exact deduplication by deterministic block naming.

A text is cut into blocks of ``block`` bytes. All distinct blocks are sorted, and a block's place
in that order is its integer name. Adjacent names are then paired, the distinct pairs sorted and
named in turn, until each document has one integer. Two documents are equal exactly when they have
the same number of blocks and the same last name: names stand for contents, not for hashes, so no
two different texts can meet.

Each naming is one round trip. Every map task first makes a dictionary of its own distinct keys,
so a key that a third of all documents hold travels once for each task, not once for each
document; the keys are dealt by hash, sorted and named, and the names go back to the task's rows.
Only the first round moves text; later ones move pairs of integers, and only of documents that
still have more than one name. In these, a task deals its documents to ``SLICES`` dictionaries, so
what many small tasks hold of them is not gathered again in few.

Keys are numbered in the order of a task's rows, and keys and documents reach their tasks by separate
ways. So that order must be the same whenever an executor is lost and a task runs again: it is that
of a file in the first round, and by all that a row holds in later ones, never that of arrival.

Cases: a null text counts as empty, and empty texts are equal to each other. Rows with a null
``doc_id`` take part; they stay only if no row of the group has an id. Of rows that agree in text
and largest ``doc_id``, exactly one is kept. An empty table gives an empty result. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written

#: kind 1: a distinct key of one task (idx: its number there; a, b: what is known of it);
#: kind 0: a document (names: numbers of its keys in the task, or names).
_ROW = "task long, kind int, idx long, key binary, a long, b long, doc_id long, sha string, blocks long, names array<long>"
_ARROW = pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("idx", pa.int64()), ("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("blocks", pa.int64()), ("names", pa.list_(pa.int64()))])
_STATE = ["doc_id", "sha", "blocks", "names"]
_OUT = 4096
#: Dictionaries of a task after the first round.
SLICES = 8


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= _OUT:
            yield _batch(kept)
            kept = []
    if kept:
        yield _batch(kept)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _slice(doc_id: int | None, sha: str, slices: int) -> int:
    return zlib.crc32(f"{doc_id} {sha}".encode()) % slices if slices > 1 else 0


def _local(keys_of: Callable, limit: int, slices: int) -> Callable:
    """A map step: number the distinct keys of the task's documents, slice by slice. When they exceed
    ``limit`` bytes, new dictionaries begin, so memory stays bounded whatever a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24

        def rows() -> Iterator[tuple]:
            nonlocal first
            seen: list[dict[bytes, int]] = [{} for _ in range(slices)]
            held = 0
            for batch in batches:
                for doc_id, sha, blocks, keys in keys_of(batch):
                    at = _slice(doc_id, sha, slices)
                    own, task, numbers = seen[at], first + at, []
                    for key in keys:
                        if (i := own.get(key)) is None:
                            i = own[key] = len(own)
                            held += len(key)
                            yield task, 1, i, key, None, None, None, None, None, None
                        numbers.append(i)
                    yield task, 0, None, None, None, None, doc_id, sha, blocks, numbers
                    if held > limit:
                        seen, held, first = [{} for _ in range(slices)], 0, first + slices

        yield from _batches(rows())

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by key: each distinct key gets the next integer."""
    high, last, name = TaskContext.get().partitionId() << 40, None, -1

    def rows() -> Iterator[tuple]:
        nonlocal last, name
        for batch in batches:
            for row in _rows(batch):
                if row[1]:
                    if row[3] != last:
                        last, name = row[3], name + 1
                    yield (*row[:3], None, high + name, *row[5:])
                else:
                    yield row

    yield from _batches(rows())


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, its keys first: put the names in place of the numbers."""

    def rows() -> Iterator[tuple]:
        task, names = None, {}
        for batch in batches:
            for row in _rows(batch):
                if row[0] != task:
                    task, names = row[0], {}
                if row[1]:
                    names[row[2]] = row[4]
                else:
                    yield (*row[:9], [names[i] for i in row[9]])

    yield from _batches(rows())


def _exchanged(numbered: DataFrame) -> DataFrame:
    """One round trip: keys are dealt by hash, sorted and named; the names go back to the tasks' rows,
    for ``_answered``. Rows that agree in all that the last sort looks at are equal."""
    route = F.when(F.col("kind") == 1, F.xxhash64("key")).otherwise(F.xxhash64("task", "doc_id"))
    named = numbered.repartition(route).sortWithinPartitions("kind", "key").mapInArrow(_named, _ROW)
    return named.repartition("task").sortWithinPartitions("task", F.desc("kind"), "doc_id", "sha", "blocks", "names")


def _then(step: Callable) -> Callable:
    """``_answered``, and ``step`` on its documents in the same Python worker."""
    return lambda batches: step(b.select(_STATE) for b in _answered(batches))


def _blocks_of(block: int) -> Callable:
    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = text.as_py() or b""
            keys = [whole[i : i + block] for i in range(0, len(whole), block)] or [b""]
            yield doc_id, hashlib.sha256(whole).hexdigest(), len(keys), keys

    return keys_of


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Adjacent names as one key; a last name without a partner goes up with a mark in its place."""
    for doc_id, sha, blocks, names in _rows(batch):
        padded = names + [-1] * (len(names) % 2)
        yield doc_id, sha, blocks, [struct.pack(">qq", *padded[i : i + 2]) for i in range(0, len(padded), 2)]


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each identity in the task's slices, with its largest doc_id and count."""
    first = TaskContext.get().partitionId() * SLICES

    def rows() -> Iterator[tuple]:
        found: list[dict[bytes, list]] = [{} for _ in range(SLICES)]
        for batch in batches:
            for doc_id, sha, blocks, names in _rows(batch):
                at = _slice(doc_id, sha, SLICES)
                one = found[at].setdefault(struct.pack(">qq", blocks, names[0]), [len(found[at]), None, 0])
                one[1], one[2] = max((x for x in (one[1], doc_id) if x is not None), default=None), one[2] + 1
                yield first + at, 0, None, None, None, None, doc_id, sha, None, [one[0]]
        for at, own in enumerate(found):
            for key, (i, most, count) in own.items():
                yield first + at, 1, i, key, most, count, None, None, None, None

    yield from _batches(rows())


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, the largest doc_id first: tell each task the group's; ``blocks`` is 1 for the
    one task that owns the row to keep."""

    def told(group: list[tuple]) -> Iterator[tuple]:
        total = sum(r[5] for r in group)
        for n, r in enumerate(group):
            yield (*r[:3], None, group[0][4], total, None, None, int(n == 0), None)

    def rows() -> Iterator[tuple]:
        group: list[tuple] = []
        for batch in batches:
            for row in _rows(batch):
                if not row[1]:
                    yield row
                elif group and group[0][3] != row[3]:
                    yield from told(group)
                    group = [row]
                else:
                    group.append(row)
        yield from told(group)

    yield from _batches(rows())


_RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string())])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, known, owned = None, {}, {}
    for batch in batches:
        out = []
        for row in _rows(batch):
            if row[0] != task:
                task, known, owned = row[0], {}, {}
            if row[1]:
                known[row[2]], owned[row[2]] = row[4:6], row[8]
                continue
            i = row[9][0]
            keep, size = known[i]
            kept = bool(owned[i]) and row[6] == keep
            if kept:
                owned[i] = 0
            out.append((row[6], keep, size, kept, row[7]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _RESULT_ARROW)], schema=_RESULT_ARROW)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block: int = 4096, local_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id (the largest id among equal texts),
    group_size, kept, text_sha256 (of the whole text in UTF-8)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    first = written(_exchanged(source.mapInArrow(_local(_blocks_of(block), local_bytes, 1), _ROW)).mapInArrow(_answered, _ROW).select(*_STATE), "block-names")
    depth = first.agg(F.max("blocks")).first()[0] or 1
    named = first.filter(F.size("names") == 1).mapInArrow(_identities, _ROW)
    if depth > 1:
        pairs = _local(_pairs_of, local_bytes, SLICES)
        open_ = _exchanged(first.filter(F.size("names") > 1).mapInArrow(pairs, _ROW))
        for _ in range((depth - 1).bit_length() - 1):
            open_ = _exchanged(open_.mapInArrow(_then(pairs), _ROW))
        named = named.union(open_.mapInArrow(_then(_identities), _ROW))
    route = F.when(F.col("kind") == 1, F.xxhash64("key")).otherwise(F.xxhash64("task", "doc_id"))
    return (
        named.repartition(route).sortWithinPartitions("kind", "key", F.desc_nulls_last("a"), "task").mapInArrow(_grouped, _ROW)
        .repartition("task").sortWithinPartitions("task", F.desc("kind")).mapInArrow(_results, _RESULT)
    )

"""Mixture-controlled packing into sequences of fixed length.

Each source is a queue of tokens, however small it is, and every window (a sequence) takes from each
queue its target share and the deficit that the queue carries. The queues are the leaves of a binary
tree that halves the tokens as evenly as it can. Of the first y tokens that a node of n sends, its left
child of a sends ``y a / n``, rounded, and the right child the rest; the rounding is the deficit that
the next token settles. So the place of a token in the corpus follows from its place in its queue by
one way through the tree, no task waits for another, no queue ever runs back, all queues end together,
and only the last sequence can be short. A queue is off its target by half a token at its own node
and by its share of what the node above is off, so by some one token after any window.

Targets are the sources' shares of the corpus, or ``targets``, a proportion for each source. With
these the queues end one after another: in each phase the open queues send in proportion to their
targets until one ends, and the others go on with theirs.

Texts are tokenised once. The ids lie in a table in the shared folder; each row knows its place
within its task's run of the source, and sums for each (task, source) give the place in the queue.
The ways through the tree are a table by source, which is joined.

Cases: a null or empty text is a document of the end id alone. A null source is a source of its
own (in ``targets``, ""). A source without a positive target is an error where ``targets`` are given; a
target without tokens is ignored. Repeated rows are packed each time; a null id is passed on. An empty
table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixtura.llm.common import written
from mixtura.llm.tokens import BpeEncoder

#: Up to so many sums for each (task, source), with the way through the tree of some 400 bytes, are broadcast; beyond, Spark joins by shuffle.
BROADCAST_SUMS = 50_000
_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _tokenised(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = BpeEncoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        sent: dict[str, int] = defaultdict(int)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, source, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    ids = (encoder.packed(text) if text else b"") + end
                    n = len(ids) // encoder.dtype.itemsize
                    rows.append((doc_id, source, part, sent[source], n, ids))
                    sent[source] += n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)

    return run


class Queue:
    """A queue's way through the trees of its phases. A phase is [first token, tokens of the queue
    sent before, tokens of the root, then of each node down to the leaf, negative for a right child]."""

    def __init__(self, phases: list[list[int]], length: int):
        self.length, self.phases = length, []
        for x0, sent0, total, *nodes in phases:
            steps, n = [], total
            for v in nodes:
                own = abs(v)
                if own < n:
                    steps.append((n, n - own if v < 0 else own, v < 0))
                n = own
            self.phases.append((x0, sent0, total, n, steps))

    @staticmethod
    def _at(phase: tuple, x: int) -> tuple[int, int]:
        """Tokens that the queues before this one, and this one, have sent of the first ``x``."""
        x0, sent, total, _, steps = phase
        y, before = min(max(x - x0, 0), total), 0
        for n, a, right in steps:
            c = (2 * y * a + n) // (2 * n)
            if right:
                before += c
                y -= c
            else:
                y = c
        return before, sent + y

    @staticmethod
    def _place(phase: tuple, t: int) -> int:
        """Place in the corpus of the queue's token ``t``: the inverse of ``_at``."""
        x0, sent, _, _, steps = phase
        t -= sent
        for n, a, right in reversed(steps):
            t = -(-(2 * n * (t + 1) - n + right) // (2 * (n - a if right else a))) - 1
        return x0 + t

    def pieces(self, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset in it, from, to) of the queue's tokens from ``start`` up to ``end``."""
        length, at = self.length, self._at
        for phase in self.phases:
            last = min(end, phase[1] + phase[3])
            if start >= last:
                continue
            k = self._place(phase, start) // length
            before, sent = at(phase, k * length)
            while start < last:
                upto, until = at(phase, (k + 1) * length)
                if until <= start:
                    k = self._place(phase, start) // length
                    before, sent = at(phase, k * length)
                    continue
                stop = min(last, until)
                # A phase that begins within the window lies after what earlier phases put there.
                yield k, max(0, phase[0] - k * length) + upto - before + start - sent, start, stop
                start, k, before, sent = stop, k + 1, upto, until


def _ways(totals: list[int]) -> list[list[int]]:
    """For each queue the nodes from the root to it, as in ``Queue``; a queue goes where its middle lies."""
    total, upto, middles = sum(totals), 0, []
    for n in totals:
        middles.append(2 * upto + n)
        upto += n
    bits = (2 * total).bit_length()
    held: dict[tuple[int, int], int] = defaultdict(int)
    for n, m in zip(totals, middles):
        for i in range(bits):
            held[i, m >> i] += n
    return [[total, *(-held[i, m >> i] if m >> i & 1 else held[i, m >> i] for i in range(bits - 1, -1, -1))] for m in middles]


def _phases(totals: list[int], targets: list[Fraction]) -> list[list[list[int]]]:
    """Each queue's phases: the open queues send in proportion to their targets until one ends."""
    left, x0, out = list(totals), 0, [[] for _ in totals]
    while live := [i for i, n in enumerate(left) if n]:
        time = min(left[i] / targets[i] for i in live)
        exact = [time * targets[i] for i in live]
        # Whole tokens, so many as the phase holds, the largest remainders rounded up.
        sent = [int(v) for v in exact]
        for j in sorted(range(len(live)), key=lambda j: sent[j] - exact[j])[: int(sum(exact)) - sum(sent)]:
            sent[j] += 1
        taking = [(i, n) for i, n in zip(live, sent) if n]
        for (i, n), way in zip(taking, _ways([n for _, n in taking])):
            out[i].append([x0, totals[i] - left[i], *way])
            left[i] -= n
        x0 += sum(sent)
    return out


class Schedule:
    """The queues of a list of totals. ``targets``: their proportions, else those of the totals."""

    def __init__(self, totals: list[int], length: int, targets: list[Fraction] | None = None):
        phases = _phases(totals, targets) if targets else [[[0, 0, *w]] for w in _ways(totals)]
        self.queues = [Queue(p, length) for p in phases]

    def pieces(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        return self.queues[queue].pieces(start, end)


def _queues(shares: DataFrame, total: int) -> DataFrame:
    """source and its phases (one), from the tokens of each source; what ``_ways`` does, as a table."""
    spread = shares.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(1024)))
    firsts = spread.groupBy("bucket").agg(F.sum("n").alias("m")).select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("first"))  # 1024 rows
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("source")) - F.col("n")
    bits = (2 * total).bit_length()
    middle = spread.join(F.broadcast(firsts), "bucket").select("source", "n", (2 * (F.col("first") + inside) + F.col("n")).alias("middle"))
    steps = middle.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("node", F.expr("shiftright(middle, i)"))
    steps = written(steps.select("source", "n", "i", "node"), "token-steps")
    nodes = steps.groupBy("i", "node").agg(F.sum("n").alias("held"))
    signed = F.when(F.col("node") % 2 == 1, -F.col("held")).otherwise(F.col("held"))
    way = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), signed.alias("v")))), lambda x: x["v"])
    head = F.array(*(F.lit(v).cast("long") for v in (0, 0, total)))
    return steps.join(nodes, ["i", "node"]).groupBy("source").agg(F.array(F.concat(head, way)).alias("phases"))


def _aimed(shares: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """source and its phases under ``targets``, which bound what comes to the driver."""
    if not all(v > 0 for v in targets.values()):
        raise ValueError("targets must be positive")
    spark = shares.sparkSession
    named = shares.filter(F.col("source").isin(list(targets)))
    missing = shares.filter(~F.col("source").isin(list(targets))).limit(5).collect()
    if missing:
        raise ValueError(f"sources without a target: {[r.source for r in missing]}")
    rows = sorted((r.source, r.n) for r in named.collect())
    phases = _phases([n for _, n in rows], [Fraction(targets[s]) for s, _ in rows])
    return spark.createDataFrame([(s, p) for (s, _), p in zip(rows, phases)], "source string, phases array<array<bigint>>")


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str = "byte_bpe_50k", targets: Mapping[str, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``targets``: proportions of the sources in a window, else their shares of all tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    tokens = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text").mapInArrow(_tokenised(tokenizer, end_id), "doc_id long, source string, part long, at long, n long, ids binary"), "tokens")
    sums = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    shares = sums.groupBy("source").agg(F.sum("n").alias("n"))
    queues = written(_aimed(shares, targets) if targets else _queues(shares, sums.agg(F.sum("n")).first()[0] or 0), "token-queues")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("base")).join(queues, "source")
    if sums.count() <= BROADCAST_SUMS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["source", "part"]).select("source", "phases", "doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    wide = BpeEncoder(tokenizer).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Queue] = {}
        for batch in batches:
            out = []
            phases = batch.column(1)
            for i, (name, doc_id, at, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)))):
                if (queue := known.get(name)) is None:
                    if len(known) >= 10_000:
                        known.clear()
                    queue = known[name] = Queue(phases[i].as_py(), length)
                raw = memoryview(np.frombuffer(ids, dtype=wide).astype("<u4").tobytes())
                for window, offset, start, stop in queue.pieces(at, at + n):
                    out.append((doc_id, start - at, stop - start, zlib.crc32(raw[4 * (start - at) : 4 * (stop - at)]), n, window, offset))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], schema=_PIECES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], schema=_PIECES)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

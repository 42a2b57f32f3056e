"""Exact top-k search by integer inner products: tiles of queries times shards of all vectors.

Vectors are packed into rows of bounded size. Each product of a query tile and a shard is one matrix
product inside a task, from which a query keeps its k best; lists of a tile then merge in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written

#: Numbers in a tile of queries and in a shard, vectors in either at most, shards in a cell, lists merged at once.
TILE_NUMBERS, SHARD_NUMBERS, TILE, SHARD, CELL, FAN = 1 << 16, 1 << 18, 1024, 4096, 8, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_PACKED = "part int, seq long, n int, dims int, exact boolean, ids binary, numbers binary"
_LISTS = "tile_part int, tile_seq long, cell long, n int, ids binary, rows binary, scores binary, counts binary"


def _floors(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as float64 where that holds it, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.all(np.abs(out) < 2**53):
        return out
    return np.array([int(x) * int(scale) if abs(x) >= 2**53 else math.floor(x * scale) for x in values.ravel().tolist()], object).reshape(values.shape)


def _pack(batches: Iterator[pa.RecordBatch], scale: float, numbers: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding) as packed tables of at most so many numbers and vectors. Vectors are
    padded with zeros to the longest of a pack; within it they stand by id."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple[int, np.ndarray]] = []
    wide = 0

    def packed() -> pa.RecordBatch:
        nonlocal held, wide, seq
        held.sort(key=lambda r: r[0])
        m = np.zeros((len(held), wide))
        for i, (_, v) in enumerate(held):
            m[i, : len(v)] = v
        m = _floors(m, scale)
        wide_ints = m.dtype == object
        text = ",".join(map(str, m.ravel())).encode() if wide_ints else (m.astype("<i4") if np.all(np.abs(m) < 2**31) else m).tobytes()
        row = {"part": [part], "seq": [seq], "n": [len(held)], "dims": [wide], "exact": [bool(wide_ints)], "ids": [np.array([r[0] for r in held], "<i8").tobytes()], "numbers": [text]}
        held, wide, seq = [], 0, seq + 1
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("exact", pa.bool_()), ("ids", pa.binary()), ("numbers", pa.binary())]))

    for b in batches:
        lists = b.column("embedding")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for i, e, size in zip(b.column("vec_id").to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
            if held and (len(held) >= most or (len(held) + 1) * max(wide, size) > numbers):
                yield packed()
            held.append((i, flat[e - size : e]))
            wide = max(wide, size)
    if held:
        yield packed()


def _matrix(n: int, dims: int, exact: bool, data: bytes) -> np.ndarray:
    if exact:
        return np.array([int(x) for x in data.split(b",") if x], object).reshape(n, dims)
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dims else "<f8").astype(float).reshape(n, dims)


def _scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact inner products. Floats hold every partial sum when the norms' product is small enough."""
    d = min(q.shape[1], s.shape[1])
    q, s = q[:, :d], s[:, :d]
    if q.dtype != object and s.dtype != object:
        norm = lambda m: math.sqrt(max(1.0, float((m * m).sum(axis=1).max(initial=0)))) * 1.001
        bound = norm(q) * norm(s)
        if bound < 2**24:
            return (q.astype("f4") @ s.astype("f4").T).astype("i8")
        if bound < 2**53:
            return (q @ s.T).astype("i8")
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in s], object).reshape(s.shape).T
    return np.clip(exact, _LOW, _HIGH).astype("i8") if d else np.zeros((len(q), len(s)), "i8")


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best among the allowed; of equal scores the first columns."""
    n, m = scores.shape
    least = np.where(allowed, scores, _LOW)
    bar = np.partition(least, m - k, axis=1)[:, m - k][:, None] if m > k else np.full((n, 1), _LOW)
    more, tied = (least > bar) & allowed, (least == bar) & allowed
    room = k - more.sum(axis=1)
    crowded = np.flatnonzero(tied.sum(axis=1) > room)
    tied[crowded] &= np.cumsum(tied[crowded], axis=1) <= room[crowded, None]
    return np.nonzero(more | tied)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row for each tile and cell: its queries' best among the cell's shards."""
    kept: dict[tuple[int, int, int], tuple] = {}
    for b in batches:
        for r in b.to_pylist():
            at = (r["tile_part"], r["tile_seq"], r["cell"])
            q, s = _matrix(r["qn"], r["qdims"], r["qexact"], r["qnumbers"]), _matrix(r["n"], r["dims"], r["exact"], r["numbers"])
            ids, others = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            scores = _scores(q, s)
            row, column = _best(scores, ids[:, None] != others[None, :], k)
            found = (row, others[column], scores[row, column])
            had = kept.get(at)
            kept[at] = (ids, *_merged([found] if had is None else [had[1:], found], k))
            if len(kept) > 64:
                yield _listed(kept)
                kept = {}
    if kept:
        yield _listed(kept)


def _merged(lists: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vec_id, score) of each row's k best of all lists."""
    row, ids, scores = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == _LOW else -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    start = np.searchsorted(row, row)
    good = np.arange(len(row)) - start < k
    return row[good], ids[good], scores[good]


def _listed(kept: dict[tuple[int, int, int], tuple]) -> pa.RecordBatch:
    rows = [(*at, len(ids), ids.astype("<i8").tobytes(), row.astype("<i4").tobytes(), scores.astype("<i8").tobytes(), found.astype("<i8").tobytes()) for at, (ids, row, found, scores) in kept.items()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _LISTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and cell; the lists of each are merged two by two as they stream by."""
    held: tuple | None = None
    for b in batches:
        for r in b.to_pylist():
            at = (r["tile_part"], r["tile_seq"], r["cell"])
            found = (np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["scores"], "<i8"))
            if held and held[0] == at:
                held = (at, held[1], _merged([held[2], found], k))
            else:
                if held:
                    yield _listed({held[0]: (held[1], *held[2])})
                held = (at, np.frombuffer(r["ids"], "<i8"), found)
    if held:
        yield _listed({held[0]: (held[1], *held[2])})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            row, ids, scores = np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["scores"], "<i8")
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], "<i8")[row]), pa.array(rank.astype("i4")), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` best of ``vectors`` (vec_id, embedding) for each row of ``queries`` (same columns):
    (query_id long, rank int from 1, vec_id long, score long), fewer ranks where there are fewer vectors.

    Components become floor(``scale`` * x); the score is the integer inner product, exact, held to the
    range of a long. Ties go to the smaller vec_id. Rows of the query's own id are no candidates.
    Vectors of unequal lengths are compared as if the shorter went on in zeros; an empty vector scores
    0. Rows whose id or vector is null, or that hold a null, infinite or undefined component, take no
    part. Each row of a repeated id is a query and a candidate of its own. Other columns are ignored; an
    empty table gives no rows.

    Every query meets every vector, which is the question; a query tile and a shard of the vectors are
    rows of at most about 2 MB. A shard travels once for each band of 64 tiles, a tile once for each
    cell of shards. No list is cut but a query's own k.
    """
    spark = vectors.sparkSession
    good = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    pack = lambda df, numbers, most: written(df.mapInArrow(lambda it: _pack(it, scale, numbers, most), _PACKED), "packed")
    shards = pack(good(vectors), SHARD_NUMBERS, SHARD)
    asked = written(good(queries), "queries")
    n = asked.count()
    tiles = pack(asked.repartition(max(1, math.ceil(n / (4 * TILE))), "vec_id"), TILE_NUMBERS, TILE)
    bands, cells = max(1, math.ceil(tiles.count() / 64)), max(1, math.ceil(shards.count() / CELL))
    place = F.xxhash64("part", "seq")
    left = tiles.select(F.pmod(place, F.lit(bands)).alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.col("part").alias("tile_part"), F.col("seq").alias("tile_seq"), F.col("n").alias("qn"), F.col("dims").alias("qdims"), F.col("exact").alias("qexact"), F.col("ids").alias("qids"), F.col("numbers").alias("qnumbers"))
    right = shards.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))).alias("band"), F.pmod(F.col("part") + F.col("seq"), F.lit(cells)).cast("long").alias("cell"), "n", "dims", "exact", "ids", "numbers")
    lists = left.join(right, ["band", "cell"]).drop("band").mapInArrow(lambda it: _search(it, k), _LISTS)
    while True:
        cells = math.ceil(cells / FAN)
        lists = lists.withColumn("cell", F.floor(F.col("cell") / FAN))
        lists = lists.repartition("tile_part", "tile_seq", "cell").sortWithinPartitions("tile_part", "tile_seq", "cell").mapInArrow(lambda it: _merge(it, k), _LISTS)
        if cells == 1:
            break
    return lists.mapInArrow(_rows, "query_id long, rank int, vec_id long, score long")

"""Prefix trie of conversations: what a cache of shared beginnings would save, rolled up to every node.

A node is a distinct sequence of first turns. Places and prefix keys come from sorted scans that split
a conversation of any length over tasks. Sums over subtrees come from a centroid decomposition of the
parent edges (``centroid``). For that the trie is cut into connected pieces that a task can hold: by
layers (``members`` ** k conversations or more) and by bands of ``levels`` levels. A piece's total is
one row for what lies above it. Bands are contracted until one is left, then layers follow each other
upwards, so a chain of n levels takes log n rounds of Spark jobs and a node with any number of children
is summed by partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.centroid import subtree_sums
from mixtura.llm.common import written
from mixtura.llm.ordered import numbered

#: Rows that a task gathers before it decomposes their pieces together, and ids in a chunk of text.
BATCH, IDS = 50_000, 4096
_SUMS = ("n_leaves", "saved_tokens")
_KEPT = ("conv_id", "depth", "parent_conv_id", "parent_depth", "n_convs", "n_children")
_ROLLED = ", ".join(f"{x} long" for x in (*_KEPT, *_SUMS))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n_bytes): the turns of every conversation from place 0, in the order of
    turn (null first), role and text hash. ``a`` and ``b`` are 64-bit hashes of (role, text), where null
    counts as empty. Rows without conv_id take no part."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("n_bytes"))
    return numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), "role", "a", "b"]).select("conv_id", F.col("_place").alias("place"), "a", "b", "n_bytes")


def rebuilt(turns: DataFrame, ids: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, depth from 1, a, b, n_bytes): each conversation c with the first h turns of
    c - c % ``share`` (all if fewer, none if absent) instead of its own first h; h = crc32(c) % ``most``."""
    heads_of = ids.withColumns({"of": F.col("conv_id") - F.col("conv_id") % share, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    held = turns.filter(F.col("place") < most - 1).groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n"))
    convs = written(heads_of.join(held, "of", "left").withColumn("m", F.least("h", F.coalesce("n", F.lit(0)))).select("conv_id", "of", "h", "m"), "rebuilt")
    heads = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv_id", "of").join(convs, "of").filter("place < m").select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "n_bytes")
    tails = turns.join(convs, "conv_id").filter("place >= h").select("conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"), "a", "b", "n_bytes")
    return heads.union(tails)


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece; whole pieces are decomposed together, about BATCH rows at once."""

    def done(t: pa.Table) -> list[pa.RecordBatch]:
        c = {x: t.column(x).to_numpy() for x in (*_KEPT[:4], "top_conv_id", "top_depth", *_SUMS)}
        is_top = (c["conv_id"] == c["top_conv_id"]) & (c["depth"] == c["top_depth"])
        ids, span = np.unique(c["conv_id"]), int(c["depth"].max()) + 1
        key = np.searchsorted(ids, c["conv_id"]) * span + c["depth"]
        order = np.argsort(key)
        wanted = np.searchsorted(ids, c["parent_conv_id"]) * span + c["parent_depth"]
        found = order[np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)]
        sums = subtree_sums(np.where(is_top, -1, found), c["depth"], np.stack([c[x] for x in _SUMS], axis=1))
        out = t.select(_KEPT)
        for i, x in enumerate(_SUMS):
            out = out.append_column(x, pa.array(sums[:, i]))
        return out.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH:
            t = pa.Table.from_batches(held).combine_chunks()
            top, deep = t.column("top_conv_id").to_numpy(), t.column("top_depth").to_numpy()
            cut = int(np.flatnonzero((top != top[-1]) | (deep != deep[-1])).max(initial=-1)) + 1
            if cut:
                yield from done(t.slice(0, cut))
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _within(nodes: DataFrame, level: int) -> DataFrame:
    """Every node's sums within its piece of ``level``."""
    cut = nodes.select(*_KEPT, *_SUMS, F.col(f"top{level}.conv_id").alias("top_conv_id"), F.col(f"top{level}.depth").alias("top_depth"))
    return written(cut.repartition("top_conv_id", "top_depth").sortWithinPartitions("top_conv_id", "top_depth").mapInArrow(_roll, _ROLLED), "rolled")


def _plus(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """``nodes`` with the totals of ``below`` added to the nodes that it hangs from."""
    hung = below.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(*(F.sum(x).alias(f"_{x}") for x in _SUMS))
    return nodes.join(hung, ["conv_id", "depth"], "left").withColumns({x: F.col(x) + F.coalesce(f"_{x}", F.lit(0)) for x in _SUMS}).drop(*(f"_{x}" for x in _SUMS))


def _layer(nodes: DataFrame, level: int, last: int) -> DataFrame:
    """The sums within one layer: its pieces are contracted to a node each, until no band is left."""
    if level == last:
        return _within(nodes, level)
    top = F.col(f"top{level}")
    totals = nodes.groupBy(top.conv_id.alias("conv_id"), top.depth.alias("depth")).agg(*(F.sum(x).alias(x) for x in _SUMS))
    tops = nodes.filter((F.col("conv_id") == top.conv_id) & (F.col("depth") == top.depth)).drop(*_SUMS).join(totals, ["conv_id", "depth"])
    owner = nodes.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"), top.alias("owner"))
    tops = written(tops.join(owner, ["parent_conv_id", "parent_depth"], "left"), "contracted")
    upper = tops.withColumns({"parent_conv_id": F.coalesce("owner.conv_id", "parent_conv_id"), "parent_depth": F.coalesce("owner.depth", "parent_depth")}).drop("owner")
    whole = _layer(upper, level + 1, last).select("conv_id", "depth", *_SUMS)
    return _within(_plus(nodes, tops.select("conv_id", "depth", "parent_conv_id", "parent_depth").join(whole, ["conv_id", "depth"])), level)


def _nodes(paths: DataFrame, ids: DataFrame, members: int, levels: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The trie's nodes without sums, every (conv_id, depth) with its node, and how many layers and bands."""
    keyed = numbered(paths.withColumns({"k1": F.xxhash64(F.lit(3), "depth", "a", "b"), "k2": F.xxhash64(F.lit(4), "depth", "a", "b")}).drop("a", "b"), "conv_id", ["depth"], ["k1", "k2"]).drop("_place")
    keyed = written(keyed, "paths")
    by = written(keyed.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")), "prefixes")
    marked = written(keyed.join(by, ["depth", "k1", "k2"]).select("conv_id", "depth", "node", "n_convs", "n_bytes"), "marked")
    root = ids.agg(F.min("conv_id").alias("id"), F.count("*").alias("n")).first()
    deepest = marked.agg(F.max("depth")).first()[0] or 0
    last = 1
    while levels**last <= deepest:
        last += 1
    count = 0
    while members ** (count + 1) <= root.n:
        count += 1
    layer = reduce(lambda s, k: s + (F.col("n_convs") >= members**k).cast("int"), range(1, count + 1), F.lit(0))
    marked = marked.withColumn("layer", layer)
    nodes = marked.filter("conv_id = node").drop("node")
    for k in range(1, last + 1):
        band = F.floor(F.col("depth") / levels**k).alias("band")
        tops = marked.groupBy("conv_id", "layer", band).agg(F.min(F.struct("depth", "node")).alias("t"))
        top = F.when((F.col("layer") == count) & (F.col("band") == 0), F.struct(F.lit(root.id).alias("conv_id"), F.lit(0).cast("long").alias("depth"))).otherwise(F.struct(F.col("t.node").alias("conv_id"), F.col("t.depth").alias("depth")))
        nodes = nodes.withColumn("band", band).join(tops, ["conv_id", "layer", "band"]).withColumn(f"top{k}", top).drop("band", "t")
    above = marked.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = nodes.join(above, ["conv_id", "depth"], "left").withColumns({"parent_conv_id": F.coalesce("parent_conv_id", F.lit(root.id)), "parent_depth": F.col("depth") - 1})
    me = F.struct(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("depth"))
    first = ids.agg(F.min("conv_id").alias("id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("n_bytes"), F.lit(count).alias("layer"), F.col("id").alias("parent_conv_id"), F.lit(-1).cast("long").alias("parent_depth"), *(me.alias(f"top{k}") for k in range(1, last + 1)))
    return nodes.unionByName(first), marked, count, last


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node and id, as comma-joined texts of IDS ids at most."""
    held, n = None, 0
    parts: list[str] = []
    rows: list[tuple] = []
    names = ["conv_id", "depth", "first", "text"]
    for b in batches:
        for node, depth, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if held is None or held[:2] != (node, depth) or n >= IDS:
                if held:
                    rows.append((*held, ",".join(parts)))
                held, parts, n = (node, depth, c), [], 0
            parts.append(str(c))
            n += 1
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))
            rows = []
    if held:
        rows.append((*held, ",".join(parts)))
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id, each node's joined text hashed as it streams by."""
    held, state = None, None
    for b in batches:
        rows: list[tuple] = []
        for node, depth, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "text")), strict=True):
            if held == (node, depth):
                state.update(b",")
            else:
                if held:
                    rows.append((*held, state.hexdigest()))
                held, state = (node, depth), hashlib.sha256()
            state.update(text.encode())
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "depth", "sha"), zip(*rows, strict=True), strict=True)))
    if held:
        yield pa.RecordBatch.from_pydict({"conv_id": [held[0]], "depth": [held[1]], "sha": [state.hexdigest()]})


def _ends(marked: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, sha) of every node where conversations end."""
    ended = ids.join(marked.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")), "conv_id", "left").crossJoin(F.broadcast(ids.agg(F.min("conv_id").alias("root"))))  # one row
    ended = ended.select(F.coalesce("end.node", "root").alias("node"), F.coalesce("end.depth", F.lit(0)).cast("long").alias("depth"), "conv_id")
    n = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = ended.repartitionByRange(n, "node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_chunks, "conv_id long, depth long, first long, text string")
    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digests, "conv_id long, depth long, sha string")


def prefix_trie(paths: DataFrame, ids: DataFrame, members: int = 256, levels: int = 1024) -> DataFrame:
    """One row for each node of the trie of ``paths`` (conv_id, depth from 1 without gaps, a, b: hashes
    of the turn, n_bytes: UTF-8 bytes of its text); ``ids`` (conv_id) are all conversations once.

    (conv_id: smallest member; depth; parent_conv_id, null at the root; n_convs; n_children; n_leaves:
    childless nodes in its subtree, itself included; saved_tokens: over its subtree, the sum of
    (n_convs - 1) * bytes of a node's last text; ends_sha256: SHA-256 of the ids of members that end
    here, ascending, comma-joined). Conversations without turns belong to the root alone. No
    conversations give no rows. Turns are told apart by 128 bits of hash.

    ``members`` and ``levels`` bound what a task holds, a piece of so many conversations over so many
    levels; they change no result. Only the list of ids that end at one node is hashed in one task, as
    SHA-256 asks for: it streams by in chunks of text.
    """
    ids = written(ids.select("conv_id"), "ids")
    nodes, marked, layers, last = _nodes(paths, ids, members, levels)
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.when(F.col("n_children") > 0, 0).otherwise(1).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = written(nodes, "nodes")
    done: list[DataFrame] = []
    for k in range(layers + 1):
        layer = nodes.filter(F.col("layer") == k)
        if done:  # whatever hangs from this layer has the sums of all below it by now
            layer = _plus(layer, reduce(DataFrame.union, done))
        done.append(_layer(layer, 1, last))
    rolled = reduce(DataFrame.union, done).join(_ends(marked, ids), ["conv_id", "depth"], "left")
    root = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return rolled.select("conv_id", "depth", root, "n_convs", "n_children", *_SUMS, F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, members: int = 256, levels: int = 1024) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations (see ``rebuilt``) of (conv_id, turn, role, text).
    Null role or text counts as empty, other columns are ignored, an empty table gives no rows."""
    turns = turn_rows(conversations.select("conv_id", "turn", "role", "text"))
    ids = written(turns.select("conv_id").distinct(), "ids")
    return prefix_trie(rebuilt(turns, ids), ids, members, levels)

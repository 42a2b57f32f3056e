"""Repair of conversations: faults, the cheapest audit of edits, and the repaired text's digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtura.llm import edit_lattice
from mixtura.llm.common import written
from mixtura.llm.ordered import numbered

_SPACES = "\\x20\\x09-\\x0D"
_TRIMMED = " \t\n\x0b\x0c\r"
_PART = "conv_id long, chunk long, n int, rows string, ways array<struct<p:int,q:int,cost:long,audit:string>>"
_NAMES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its
    text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. Null role, text, and turn
    in the hashed key count as one space; rows without conv_id take no part."""
    one = F.lit(" ")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    rows = rows.withColumn("_how", F.crc32(key.cast("binary")) % 20).filter("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64(F.lit(1), "text"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, initial, fault, code) of (conv_id, turn, role, text); fault is blank,
    duplicate, truncated or null, whichever comes first, and code is that of ``edit_lattice``."""
    blank = F.rtrim("text", F.lit(_TRIMMED)) == ""
    cut = ~F.substring(F.rtrim("text", F.lit(_TRIMMED)), -1, 1).isin(".", "!", "?")
    facts = _hashed(rows).select("conv_id", "turn", "role", "hash", F.xxhash64(F.lit(2), "role", "text").alias("twin"), blank.alias("blank"), cut.alias("cut"))
    placed = written(numbered(facts, "conv_id", _order()).withColumnRenamed("_place", "place"), "facts")
    twins = written(placed.groupBy("conv_id", "hash", "twin").agg(F.min("place").alias("seen"), F.count("*").alias("times")).filter("times > 1").drop("times"), "twins")
    known = placed.join(twins, ["conv_id", "hash", "twin"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    known = known.select("conv_id", "place", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return known.withColumn("code", code)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a conversation with all ways through them; a whole one with its best way alone."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["alone"]:
                cost, audit = edit_lattice.solve(r["rows"])
                ways = [(0, 3, cost, audit)]
            else:
                ways = edit_lattice.transfers(r["rows"])
            rows.append({"conv_id": r["conv_id"], "chunk": r["chunk"], "n": 1, "rows": r["rows"], "ways": [dict(zip("p q cost audit".split(), w, strict=True)) for w in ways]})
        yield _parts(rows)


def _parts(rows: list[dict]) -> pa.RecordBatch:
    way = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("rows", pa.string()), ("ways", way)]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring stretches, sorted by conversation and place, as one."""
    held: dict | None = None
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if held and (held["conv_id"], held["into"]) == (r["conv_id"], r["into"]):
                ways = edit_lattice.join([tuple(w.values()) for w in held["ways"]], [tuple(w.values()) for w in r["ways"]])
                held |= {"rows": held["rows"] + r["rows"], "n": held["n"] + r["n"], "ways": [dict(zip("p q cost audit".split(), w, strict=True)) for w in ways]}
            else:
                if held:
                    rows.append(held)
                held = r
        if rows:
            yield _parts([{**r, "chunk": r["into"]} for r in rows])
    if held:
        yield _parts([{**held, "chunk": held["into"]}])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, cost, audit, steps) of whole conversations."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            ways = [(w["cost"], w["audit"]) for w in r["ways"] if w["p"] == 0 and w["q"] in edit_lattice.ENDS]
            cost, audit = min(ways)
            rows.append({"conv_id": r["conv_id"], "cost": cost, "audit": audit, "steps": edit_lattice.steps(r["rows"], audit)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("steps", pa.list_(pa.string()))]))


def audits(rows: DataFrame, chunk: int = 1024, fan: int = 16) -> DataFrame:
    """(conv_id, cost, audit, steps) of every conversation of (conv_id, place, code).

    A conversation of more than ``chunk`` rows is cut; each stretch gives its cheapest way between any
    two states, and ``fan`` neighbours are joined at a time. Both are plan only.
    """
    cut = rows.select("conv_id", "place", "code", F.floor(F.col("place") / chunk).alias("chunk"))
    texts = cut.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c")).withColumn("rows", F.array_join("c.code", ""))
    sizes = rows.groupBy("conv_id").agg(F.max("place").alias("last"))
    long = written(sizes.filter(F.col("last") >= chunk), "long")
    texts = texts.join(long, "conv_id", "left").select("conv_id", "chunk", "rows", F.col("last").isNull().alias("alone"))
    parts = written(texts.mapInArrow(_solved, _PART), "stretches")
    whole, split = parts, None
    most = long.agg(F.max("last")).first()[0]
    if most is not None:
        split = parts.join(long.select("conv_id"), "conv_id", "left_semi")
        whole = parts.join(long.select("conv_id"), "conv_id", "left_anti")
        most = most // chunk
        while most > 0:
            most //= fan
            split = split.withColumn("into", F.floor(F.col("chunk") / fan)).repartition("conv_id", "into").sortWithinPartitions("conv_id", "into", "chunk").mapInArrow(_joined, _PART)
        whole = whole.unionByName(split)
    return whole.mapInArrow(_finished, "conv_id long, cost long, audit string, steps array<string>")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's steps, then its rows in order: SHA-256 of the repaired lines as they stream by."""
    conv, steps, state, n = None, None, None, 0

    def add(line: str) -> None:
        nonlocal n
        state.update(b"\n" * (n > 0) + line.encode())
        n += 1

    def close() -> tuple[int, str]:
        for x in next(steps):
            add(f"{_NAMES[x]}:")
        return conv, state.hexdigest()

    for b in batches:
        done = []
        for c, s, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "steps", "role", "text")), strict=True):
            if s is not None:
                if conv is not None:
                    done.append(close())
                conv, steps, state, n = c, iter(s), hashlib.sha256(), 0
                continue
            *before, edit = next(steps)
            for x in before:
                add(f"{_NAMES[x]}:")
            if edit != "D":
                add(f"{role if edit == 'K' else _NAMES[edit.lower()]}:{text}")
        if done:
            yield pa.RecordBatch.from_pydict({"conv_id": [x[0] for x in done], "sha": [x[1] for x in done]})
    if conv is not None:
        conv_id, sha = close()
        yield pa.RecordBatch.from_pydict({"conv_id": [conv_id], "sha": [sha]})


def repaired_digest(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of the repaired ``role:text`` lines of (conv_id, turn, role, text). One
    conversation is hashed in one task, as SHA-256 asks for; its rows stream by."""
    none = F.lit(None)
    texts = _hashed(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "hash", "text", none.cast("array<string>").alias("steps"))
    first = audited.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("long").alias("hash"), none.cast("string").alias("text"), "steps")
    both = texts.withColumn("turn", F.col("turn").cast("long")).unionByName(first)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).mapInArrow(_lines, "conv_id long, sha string")


def repair(conversations: DataFrame, damage: bool = False, chunk: int = 1024) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text), with its faults and cheapest repair.

    (conv_id; gaps: turns missing between the least and largest; blank, duplicate, truncated: rows by
    first fault; illegal: neighbours whose role initials are not su, ua or au; cost; audit: edits'
    initials Keep, Rerole, Delete, Insert; repaired_sha256 of the repaired lines). ``damage`` applies
    ``damaged`` first; a conversation without rows after it gets zeros, an empty audit and the hash of
    the empty string. Rows of one turn stand by role and 64-bit text hash, equal rows in any order. A role
    that does not begin with s, u or a can be reroled or deleted only. Null role or text counts as one
    space; rows without conv_id take no part; other columns are ignored; an empty table gives no rows.
    """
    held = conversations.select("conv_id", "turn", "role", "text")
    space = F.lit(" ")
    rows = damaged(held) if damage else held.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    facts = written(coded(rows), "coded")
    count = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
    faults = facts.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    turns = facts.filter("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("turns"))
    after = facts.select("conv_id", (F.col("place") - 1).alias("place"), F.col("initial").alias("then"))
    illegal = facts.select("conv_id", "place", "initial").join(after, ["conv_id", "place"]).filter(~F.concat("initial", "then").isin("su", "ua", "au")).groupBy("conv_id").agg(F.count("*").alias("illegal"))
    audited = written(audits(facts, chunk), "audits")
    ids = held.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = ids
    for part in (faults, turns, illegal, audited.select("conv_id", "cost", "audit"), repaired_digest(rows, audited)):
        whole = whole.join(part, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return whole.select("conv_id", zero(F.col("span") - F.col("turns")).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

"""Main text of web pages by wrapper inference for each host.

The pages of a host come from one template. Its wrapper, a union-free expression over elements, is
inferred by aligning page after page: neighbours of one label become a repeated group, elements
that only some pages have become optional, and texts that differ become slots. Wrappers merge with
wrappers as pages do, so each task folds its own pages of a host and only small wrappers meet, in
two steps, however many pages a host has. The wrapper then tells which part is the article, for
all pages of the host alike; each page's text is read there, without what nearly all pages of the host
(three or more) share before the first or after the last text that differs - but in an ``article``
element - and without what plain tags and names mark as menus, adverts, forms, comments and the like. A page that then has no text keeps the
template's; one without that part is taken as its own template.

Cases: a null or empty page has the empty text. A page without a usable url belongs to the host "".
Repeated rows give repeated results, null ids are passed on, other columns are not read, an empty
table gives an empty result. Unclosed tags and cut pages are tolerated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm import html_tree as tree
from mixtura.llm.common import written

#: Paths of all hosts up to so many bytes are broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 32 << 20
#: Hosts that a task folds at once.
HELD_HOSTS = 2000


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of the task."""
    part = TaskContext.get().partitionId()
    held: dict[str, dict] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"host": pa.array(list(held), pa.string()), "part": pa.array([part] * len(held), pa.int64()), "wrapper": pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())})
        held.clear()
        return batch

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for host, page in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                if page:
                    one = tree.wrapper_of(tree.parse(page))
                    held[host] = tree.merged(held[host], one) if host in held else one
                    if len(held) > HELD_HOSTS:
                        yield out()
    yield out()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers sorted by their group, merged within it."""
    group, wrapper = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array([group[0]], pa.string()), "part": pa.array([group[1]], pa.int64()), "wrapper": pa.array([json.dumps(wrapper, separators=(",", ":"))], pa.string())})

    for batch in batches:
        for host, part, one in zip(*(c.to_pylist() for c in batch.columns)):
            if group == (host, part):
                wrapper = tree.merged(wrapper, json.loads(one))
            else:
                if group:
                    yield row()
                group, wrapper = (host, part), json.loads(one)
    if group:
        yield row()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers = map(json.loads, batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps([path := tree.main_path(w), tree.template_texts(w, path)]) for w in wrappers], pa.string())], names=["host", "path"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html)."""
    rows = pages.select("host", "html").mapInArrow(_folded, "host string, part long, wrapper string")
    # First within 64 groups of tasks, then for the whole host, so no task merges more than its share.
    for part in (F.pmod("part", F.lit(64)), F.lit(0).cast("long")):
        rows = rows.withColumn("part", part).repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_met, "host string, part long, wrapper string")
    return rows.select("host", "wrapper")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    paths = written(infer_wrappers(named).select("host", "wrapper").mapInArrow(_paths, "host string, path string"), "page-paths")
    size = paths.agg(F.sum(F.length("path") + F.length("host") + 64)).first()[0] or 0
    joined = named.join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, "host", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[str], frozenset[int]]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for page, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if not page:
                        out.append("")
                        continue
                    if path not in known:
                        if len(known) > 10_000:
                            known.clear()
                        labels, template = json.loads(path)
                        known[path] = labels, frozenset(template)
                    root = tree.parse(page)
                    text = tree.text_at(root, *known[path]) or tree.text_at(root, known[path][0])
                    if not text:
                        text = tree.text_at(root, tree.main_path(tree.wrapper_of(root)))
                    out.append(text or "")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(named.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "path").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")

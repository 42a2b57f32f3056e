"""The corpus pipeline: quality classifier, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to
the shared folder and reads again as the next stage's documents. All but the last return the
columns of ``documents``.

Stages that filter judge rows, not ids: each row has a key for the stage, so a null ``doc_id`` loses
no row and one that several rows share is no licence for all of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtura.llm.common import table, written
from mixtura.llm.exact_dedup import exact_dedup
from mixtura.llm.jaccard_join import jaccard_components
from mixtura.llm.packing import pack
from mixtura.llm.pii import mask_pii
from mixtura.llm.quality_pu import quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Files whose numbers are broadcast; where there are more, rows get their keys as they are written.
FILES = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``row_key``, which any run of a task reads again: the number of the row's file, and
    its place in it. What does not come straight from files is written first."""
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return _keyed(written(docs.select(*COLUMNS), "pipeline-rows"))
    files = rows.select("file").distinct()
    if files.count() > FILES:
        return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "pipeline-keys")
    files = files.withColumn("n", F.row_number().over(Window.orderBy("file")).cast("long"))  # FILES rows at most
    return rows.join(F.broadcast(files), "file").select(*COLUMNS, (F.col("n") * (1 << 40) + F.col("row")).alias("row_key"))


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, "row_key", "left_semi").select(*COLUMNS)


def _first(rows: DataFrame, groups: DataFrame, order: list) -> DataFrame:
    """The key of each group's first row by ``order``; ``groups`` has row_key and its group."""
    ids = rows.select("row_key", F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(groups, "row_key").groupBy("group").agg(F.min_by("row_key", F.struct(*order, "row_key")).alias("row_key")).select("row_key")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null id has no label and is judged like any other
    row; of rows that share an id, each is judged by its own text."""
    rows = _keyed(docs)
    scored = quality_classifier(rows, table(spark, sf_dir, "labels"), key_col="row_key")
    return _only(rows, scored.filter("predicted = 1").select("row_key"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; one without an id only where none has one. Of
    rows that share text and id, one stays; an id of two texts stays once for each where it is the largest."""
    rows = _keyed(docs)
    groups = exact_dedup(rows, id_col="row_key").select(F.col("doc_id").alias("row_key"), F.col("keep_id").alias("group"))
    return _only(rows, _first(rows, groups, [F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.col("doc_id").cast("long")).alias("id")]))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other over similar texts, the one with the smallest id; one without
    an id only where none has one. Rows that share an id are near copies only if their texts are."""
    rows = _keyed(docs)
    groups = jaccard_components(rows, id_col="row_key").select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group"))
    return _only(rows, _first(rows, groups, [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")]))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; rows with a null or repeated id too."""
    return mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null id is passed on, rows that share an id are packed each."""
    return pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("pii", without_pii),
    ("packing", packed),
]

#: The classifier, the masks and the tokens are beyond SQL; the stages' results are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

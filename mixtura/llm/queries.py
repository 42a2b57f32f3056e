"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtura.llm.common import table
from mixtura.llm.exact_dedup import exact_dedup
from mixtura.llm.html_extract import extract_text
from mixtura.llm.jaccard_join import jaccard_components
from mixtura.llm.packing import pack
from mixtura.llm.pii import pii_digest
from mixtura.llm.prefix_trie import rebuilt_trie
from mixtura.llm.quality_pu import quality_classifier
from mixtura.llm.quality_rules import STEPS, quality_rules
from mixtura.llm.repair import repair
from mixtura.llm.secrets import secrets_digest
from mixtura.llm.sentencepiece_scan import sentencepiece_digest
from mixtura.llm.sql import REPAIR_SQL, TOP_K_SQL, TRIE_SQL
from mixtura.llm.topk import top_k
from mixtura.llm.toxicity import toxicity


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_top_k": op12_top_k,
    "op13_structure_repair": op13_structure_repair,
}

_LADDER = ", ".join(f"('{rule}', {s}, CAST({c} AS DOUBLE))" for s, (rule, c) in enumerate(STEPS, 1))
#: As in the defaults of ``quality_rules``.
_RISK = "CAST(0.05 AS DOUBLE)"
_RULES_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), rep AS (
  SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, i - lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM dup) GROUP BY 1
), c AS (
  SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (
  SELECT * EXCLUDE (lines), len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), r AS (
  SELECT doc_id, stratum, base_failed, 'symbol_rate' AS rule, n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) AS v FROM b
  UNION ALL SELECT doc_id, stratum, base_failed, 'dup_line_rate', n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) FROM b
  UNION ALL SELECT doc_id, stratum, base_failed, 'repeat_rate', n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) FROM b
  UNION ALL SELECT doc_id, stratum, base_failed, 'long_word', word_chars / CAST(greatest(n_words, 1) AS DOUBLE) FROM b
  UNION ALL SELECT doc_id, stratum, base_failed, 'short_word', -word_chars / CAST(greatest(n_words, 1) AS DOUBLE) FROM b
), ladder(rule, step, cutoff) AS (VALUES {_LADDER}
), f AS (
  SELECT doc_id, stratum, CAST(CASE WHEN base_failed THEN 0 ELSE coalesce(min(step) FILTER (v > cutoff), {len(STEPS) + 1}) END AS INTEGER) AS first_step FROM r JOIN ladder USING (rule) GROUP BY doc_id, stratum, base_failed
), good AS (
  SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1
), k AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (first_step <= step) AS k FROM f JOIN good USING (doc_id) CROSS JOIN (SELECT unnest(range(1, {len(STEPS) + 1})) AS step) GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k >= n * {_RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) END AS p FROM k
), far AS (
  SELECT stratum, min(step) - 1 AS far FROM (SELECT stratum, step FROM p WHERE p > CAST(0.05 AS DOUBLE) / (SELECT count(DISTINCT stratum) FROM b) UNION ALL SELECT DISTINCT stratum, {len(STEPS) + 1} FROM p) GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, first_step, first_step > coalesce(far, 0) AS kept FROM b JOIN f USING (doc_id) LEFT JOIN far ON far.stratum = f.stratum
"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": TRIE_SQL,
    "op12_top_k": TOP_K_SQL,
    "op13_structure_repair": REPAIR_SQL,
    "op10_quality_rules": _RULES_SQL,
    "op1_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN sets s USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT b, r FROM reach JOIN both_ways ON v = a
)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach ON v = sizes.doc_id GROUP BY ALL
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}

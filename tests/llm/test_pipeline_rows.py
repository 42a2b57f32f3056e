"""Rows with null and repeated ids in each stage of the pipeline."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest

WORDS = [f"{a}{b}" for a in ("ra", "te", "mo", "li") for b in ("n", "s", "nd", "le")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [" ".join(rng.choices(WORDS, k=80)) + "." for _ in range(120)]


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], COLUMNS).repartition(3)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_good_quality_judges_rows(spark, texts, tmp_path):
    junk = [" ".join(f"{w}###" for w in t.split()[:60]) for t in texts[:20]]
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 120, 2), *range(300, 310)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = [*enumerate(texts), (None, texts[5] + " more"), (None, texts[6] + " more"), (7, texts[7])]
    bad = [*((300 + i, t) for i, t in enumerate(junk)), (None, junk[3] + " q###"), (9, junk[4] + " q###")]
    assert left(cp.good_quality(spark, rows_of(spark, good + bad), str(tmp_path))) == Counter(good)


def test_without_copies_judges_rows(spark, texts):
    a, b, c, d, e = texts[:5]
    docs = rows_of(spark, [(1, a), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, d), (3, d), (4, e), (4, b)])
    assert left(cp.without_copies(spark, docs, "")) == Counter([(2, a), (4, b), (None, c), (3, d), (4, e)])


def test_without_near_copies_judges_rows(spark, texts):
    near = lambda t: t.replace(t.split()[40], "edited", 1)
    a, b, c, d, e = texts[:5]
    docs = rows_of(spark, [(1, a), (None, near(a)), (None, b), (None, near(b)), (5, c), (5, d), (7, near(d)), (8, e), (8, near(e))])
    got = left(cp.without_near_copies(spark, docs, ""))
    assert sum(got.values()) == 5 and got[1, a] == got[5, c] == got[5, d] == 1
    assert got[None, b] + got[None, near(b)] == 1 and got[8, e] + got[8, near(e)] == 1


def test_later_stages_pass_all_rows(spark, texts):
    docs = rows_of(spark, [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2])])
    assert left(cp.without_pii(spark, docs, "")) == left(docs)
    assert sum(p.length for p in cp.packed(spark, docs, "").collect() if p.doc_id is None) > 0


def test_stages_bear_empty_tables_and_other_columns(spark, texts, tmp_path):
    """Null, empty and long texts, columns whose names the operators use themselves, no rows at all."""
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    hard = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 20_000, "en", None, 100_000), (3, texts[0], None, "t", 1), (None, None, "de", "s", 0)]
    docs = spark.createDataFrame([(*r, 9, "k", 0.5, 1, [1]) for r in hard], COLUMNS + ", row_key int, key string, score double, file int, names array<int>").repartition(2)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.filter("1 = 0"), str(tmp_path))
        assert none.columns == got.columns and none.count() == 0
        if name == "packing":
            assert got.count() >= 5
        else:
            assert got.columns == cp.COLUMNS and got.count() <= 5
        if name in ("exact_dedup", "jaccard_join"):
            assert {r.doc_id for r in got.collect()} >= {2, 3}


def test_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i % 7, f"text {i}", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    few = cp._keyed(docs)
    monkeypatch.setattr(cp, "FILES", 2)
    many = cp._keyed(docs)
    for rows in (few, many):
        assert rows.count() == rows.select("row_key").distinct().count() == 20
        assert sorted(r.text for r in rows.collect()) == sorted(r.text for r in docs.collect())

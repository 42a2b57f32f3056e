"""The pipeline's stages, each on what the one before kept."""

import os
import random

import pytest

import corpus_pipeline as cp

WORDS = [f"{a}{b}" for a in ("ra", "te", "mo", "li") for b in ("n", "s", "nd", "le")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    text = lambda: " ".join(rng.choices(WORDS, k=80)) + "."
    good = {i: text() for i in range(120)}
    good[200], good[201] = good[3], good[4].replace(good[4].split()[40], "edited", 1)
    good[202] = text() + " mail a.b@example.com now"
    junk = {300 + i: " ".join(f"{w}###" for w in rng.choices(WORDS, k=60)) for i in range(20)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in (good | junk).items()]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 120, 2), *range(300, 310)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, tables), name)
        assert docs.columns == cp.COLUMNS
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_classifier":
            assert not any(i >= 300 for i in ids) and len(ids) == 123
        if name == "exact_dedup":
            assert 3 not in ids and 200 in ids and len(ids) == 122
        if name == "jaccard_join":
            assert 4 in ids and 201 not in ids and len(ids) == 121
    assert docs.filter("text LIKE '%@%'").count() == 0 and docs.filter("text LIKE '%<email>%'").count() == 1
    pieces = cp.STAGES[-1][1](spark, docs, tables)
    assert pieces.select("doc_id").distinct().count() == 121


def test_run(spark, tables):
    assert cp.run(spark, tables).select("doc_id").distinct().count() == 121


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_jaccard_join", "op5_exact_dedup"])
def test_oracles(spark, name):
    import duckdb

    from mixtura.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, d).toPandas()
    columns = sorted(got.columns)
    show = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert show(got).equals(show(want))

"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from mixtura.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

#: A part of the queries, one of each kind; the driver compares all.
CHOSEN = ["effects_kw", "effects_anova", "effects_chi2_cramer", "bh_adjust", "brown_forsythe", "roc_points", "auc_strict", "accuracy_majority", "softmax", "nist_gauss1", "thinplate", "hist_density", "relabel_prior", "cumulative_probability", "shared_rank", "ensemble_logdens", "kmeans_fixed_centers", "eset_to_labeled", "assignment_check", "superclusters", "dendrogram_leaves", "silhouette_exact", "davgquant", "knn_impute_rounds", "outer_effects"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.sql(catalog.ORACLE_SQL[name]).df(), catalog.QUERIES[name](spark, DIR).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert show(got).equals(show(want))


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_imports_without_the_llm_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "mixtura", tmp_path / "mixtura", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; from mixtura.plans import catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE_SQL)"
    subprocess.run([sys.executable, "-c", told], cwd=tmp_path, check=True, timeout=120)


def test_a_broken_toolkit_is_no_missing_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "mixtura", tmp_path / "mixtura", ignore=shutil.ignore_patterns("llm", "ranking.py", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, timeout=120)
    assert done.returncode and b"mixtura.operators.ranking" in done.stderr

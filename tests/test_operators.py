import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtura.operators import classify, clusters, ensemble, evaluation, expression, importance, linear, prep, ranking, stats, vbgmm
from mixtura.sources import io


def test_kruskal_known_value(spark):
    rows = [("f", "a", float(v)) for v in (1, 3, 5, 7, 9)] + [("f", "b", float(v)) for v in (2, 4, 6, 8, 10)]
    r = stats.kruskal(spark.createDataFrame(rows, "feature string, grp string, value double")).first()
    assert r.h == pytest.approx(0.2727272727)
    assert r.effect == pytest.approx(r.h / 9)


def test_small_groups_are_left_out(spark):
    rows = [("f", "a", 1.0), ("f", "a", 2.0), ("f", "b", 3.0)]
    assert stats.kruskal(spark.createDataFrame(rows, "feature string, grp string, value double")).count() == 0


def test_running_counts_with_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double")
    got = {r.v: (r.n, r.n_before, r.n_all) for r in ranking.running(df, [], "v", {"n": F.lit(1)}, 2).collect()}
    assert got == {1.0: (1, 0, 5), 2.0: (1, 1, 5), 3.0: (3, 2, 5)}


def test_order_of_values_by_index(spark):
    told = lambda rows: prep.is_ordered(spark.createDataFrame(rows, "i int, v double"), "i", "v").first().ordered
    rows = [(i, i / 2) for i in range(100)]
    assert told(rows) and told(rows[::-1]) and told([]) and told([*rows, (None, 99.0)])
    assert not told([*rows, (100, 1.0)]) and not told([*rows, (None, -1.0)]) and not told([(-1, 9.0), *rows])


def test_running_counts_of_values_that_change_when_read_again(spark):
    """Buckets and what lies before them are of one reading, though the values are not the same twice."""
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()  # noqa: S311
    df = spark.range(20_000, numPartitions=8).select(draw("id").alias("v"))
    got = [(r.n_before, r.n_all) for r in ranking.running(df, [], "v", {"n": F.lit(1)}, 16).orderBy("v").collect()]
    assert got == [(i, 20_000) for i in range(20_000)]


def test_yates_and_bh(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10, "r string, c string")
    assert stats.chi2(df, "r", "c").first().chi2 == pytest.approx(5.4)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "feature string, p_value double")
    got = {r.feature: (round(r.p_adj, 4), round(r.p_adj_bh, 4)) for r in stats.bh(p).collect()}
    assert got == {"a": (0.03, 0.03), "c": (0.045, 0.04), "b": (0.04, 0.04)}


def test_strict_auc_and_information(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, y int")
    assert evaluation.auc_strict(df).first().auc == pytest.approx(0.75)
    zero, negated = (evaluation.information(df, wrong=w).first().shannon for w in ("zero", "negate"))
    assert negated <= zero
    points = {round(r.p, 2): (r.fpr, r.tpr) for r in evaluation.roc_points(df).collect()}
    assert points[0.5] == (0.5, 1.0)
    assert evaluation.evaluate(df, "m").count() == 1


def test_relabel(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    got = [r.label for r in prep.relabel_by_prior(df, "v", [0.2, 0.3, 0.5]).orderBy("v").collect()]
    assert got == [2, 2, 2, 1, 1, 1, 0, 0, 0, 0]


def test_imputation_and_missing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [10.0, 10.0]), (4, [0.4, None])], "id long, x array<double>")
    got = {r.id: r.x for r in prep.knn_impute(df, "id", "x", k=2).collect()}
    assert got[4][1] == pytest.approx((0 / 0.4 + 1 / 0.6) / (1 / 0.4 + 1 / 0.6))
    assert got[1] == [0.0, 0.0]
    wide = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 1.0)], "a double, b double")
    assert prep.condense(wide, ["a", "b"]).columns == ["a"]
    assert prep.drop_missing_rows(wide, ["a", "b"]).count() == 1


def test_divergence_matrix_matches_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), [float(v) for v in rng.dirichlet([1, 1, 1])]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, cluster int, q array<double>")
    closed = {(r.a, r.b): r.dist for r in clusters.divergence_matrix(df).collect()}
    pairs = {(r.a, r.b): r.dist for r in clusters.quantile_mean(clusters.pair_metrics(df, "id"), 1.0).filter("a < b").collect()}
    assert closed == pytest.approx(pairs, rel=1e-9)


def test_upgma_is_monotone_and_cut():
    d = {(0, 1): 1.0, (0, 2): 4.0, (0, 3): 5.0, (1, 2): 4.0, (1, 3): 5.0, (2, 3): 2.0}
    steps = clusters.upgma([0, 1, 2, 3], d, dict.fromkeys(range(4), 1))
    assert [s[3] for s in steps] == [1.0, 2.0, 4.5]
    assert clusters.cut([0, 1, 2, 3], steps, 2) == {0: 0, 1: 0, 2: 1, 3: 1}


def test_merge_small_keeps_columns_apart():
    n, m = np.array([50.0, 3.0, 2.0]), np.array([[0.9, 0.05, 0.05], [0.1, 0.6, 0.3], [0.4, 0.1, 0.5]])
    assert clusters.merge_map(n, m, 10) == {0: 0, 1: 0, 2: 0}


def test_pca_and_responsibilities(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.diag([3, 2, 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    p = linear.Pca(df)
    assert p.variance == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1])
    means, cov = np.array([[0.0, 0, 0], [3, 0, 0]]), np.array([np.eye(3), 2 * np.eye(3)])
    full = [r.q for r in linear.responsibilities(df, np.array([0.5, 0.5]), means, cov, "full").orderBy("id").collect()]
    ball = [r.q for r in linear.responsibilities(df, np.array([0.5, 0.5]), means, np.array([1.0, 2.0]), "spherical").orderBy("id").collect()]
    assert np.array(full) == pytest.approx(np.array(ball), abs=1e-9)
    with pytest.raises(ValueError):
        linear.responsibilities(df, np.array([1.0]), means[:1], cov[:1], "odd")


def three_gaussians():
    rng = np.random.default_rng(3)
    means = np.array([[-1.75, -1.75], [0, 0], [1.75, 1.75]])
    z = rng.choice(3, 200, p=[0.2, 0.3, 0.5])
    return np.array([rng.multivariate_normal(means[i], [[1, -0.5], [-0.5, 1]]) for i in z])


@pytest.mark.parametrize("covtyp,covmode", [("full", "individual"), ("full", "shared"), ("diag", "individual"), ("diag", "shared")])
def test_variational_mixture_recovers_components(covtyp, covmode):
    x = three_gaussians()
    best = {}
    for k in range(1, 5):
        fits = [vbgmm.fit_local(x, vbgmm.Params(k=k, covtyp=covtyp, covmode=covmode, seed=s, dirichlet=5)) for s in range(3)]
        for f in fits:
            assert (np.diff(f.history) >= -1e-7).all()
        best[k] = max(f.history[-1] for f in fits)
    chosen = max(best, key=best.get)
    assert chosen == 3 if covtyp == "full" else chosen >= 2


def test_distributed_fit_equals_local(spark):
    x = three_gaussians()
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    p = vbgmm.Params(k=2, seed=1, max_iter=4)
    far, near = vbgmm.fit(df, p), vbgmm.fit_local(x, p)
    assert far.bound(0) != 0 and far.history[-1] == pytest.approx(near.history[-1], rel=0.02)
    assert vbgmm.predict(df, far).select(F.min("component"), F.max("component")).first()[0] >= 1
    with pytest.raises(ValueError):
        vbgmm.Params(covtyp="odd")


def test_grid_and_weights(spark):
    df = spark.createDataFrame([([float(v) for v in r],) for r in three_gaussians()], "x array<double>")
    t = ensemble.score_table(ensemble.fit_grid(df, {"k": [1, 2], "max_iter": [20], "inits": [1]}, 1)).collect()
    assert len(t) == 2 and sum(r.ensweights for r in t) == pytest.approx(1)


def test_grid_order(spark):
    g = ensemble.expand(spark, {"b": [1, 2], "a": ["x", "y"]}).orderBy("paramid").collect()
    assert [(r.a, r.b) for r in g] == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_importance(spark):
    long = spark.createDataFrame([("a", "m1", 3.0), ("b", "m1", 1.0), ("a", "m2", 1.0), ("b", "m2", 3.0)], "feature string, metric string, v double")
    assert {r.share for r in importance.shared_rank(long).collect()} == {0.5}
    assert {(r.feature, r.pos1, r.pos2) for r in importance.rank_positions(long, 2).collect()} == {("a", 1, 1), ("b", 1, 1)}


def test_expression_set(spark, tmp_path):
    e = spark.createDataFrame([("f1", "s1", 1.0), ("f2", "s1", 2.0), ("f1", "s2", 3.0)], "feature_id string, sample_id string, v double")
    s = expression.ExpressionSet(e, e.select("feature_id").distinct(), spark.createDataFrame([("s1", 0), ("s2", 1)], "sample_id string, label int")).checked()
    assert s.subset(features=spark.createDataFrame([("f1",)], "feature_id string")).exprs.count() == 2
    s.save(str(tmp_path / "set"))
    assert expression.load(spark, str(tmp_path / "set")).exprs.agg(F.sum("v")).first()[0] == pytest.approx(6)
    with pytest.raises(expression.ExpressionError):
        expression.ExpressionSet(e, s.fdata, s.pdata.limit(0)).checked()


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ExpID,a,b,y\nx1,1.5,2,1\nx2,NaN,3,0\n")
    (tmp_path / "cols.txt").write_text("a, b ,c\n")
    base = io.Base(spark, str(tmp_path))
    df = io.nan_to_null(base.csv("t.csv", "ExpID string, a double, b double, y int"))
    assert df.filter("a IS NULL").count() == 1
    assert base.column_list("cols.txt") == ["a", "b", "c"]
    assert io.extract(df, "ExpID", ["a"], drop=True, y="y").orderBy("id").first().x == [2.0]
    alloc = df.select(F.col("ExpID").alias("id"), F.col("y").alias("label"), F.array("b").alias("q"))
    io.write_allocations(alloc, str(tmp_path / "alloc"))
    assert io.read_allocations(spark, str(tmp_path / "alloc")).count() == 2


def test_stream_scoring(spark, tmp_path):
    from mixtura.streaming import scoring

    spark.createDataFrame([([0.0, 0.0],), ([3.0, 3.0],)], "x array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x array<double>").parquet(str(tmp_path / "in"))
    q = scoring.start(scoring.scored(stream, np.array([0.5, 0.5]), np.array([[0.0, 0], [3, 3]]), np.array([1.0, 1.0]), "spherical"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.cluster for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0, 1}


def test_mixed_table_as_numbers(spark):
    rows = [(i, str(float(i)) if i != 3 else "?", "ab"[i % 2], "xyz"[i % 3], None, "m" if i else None) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, num string, two string, three string, thin string, gone string")
    kinds = {"num": "continuous", "two": "binary", "three": "categorical", "thin": "continuous", "gone": "categorical"}
    out = prep.recode_table(df, "id", kinds, {"gone"}, k=3).orderBy("id").collect()
    assert out[0].asDict().keys() == {"id", "num", "two", "three_0", "three_1", "three_2"}
    assert [r.two for r in out[:2]] == [0.5, -0.5] and [r.three_1 for r in out[:3]] == [0, 1, 0] and out[3].num is not None
    with pytest.raises(ValueError):
        prep.treat_missing(df, "id", ["num"], "odd")


def test_component_statistics(spark):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(three_gaussians())], "id long, x array<double>")
    post = vbgmm.fit_local(three_gaussians(), vbgmm.Params(k=2, max_iter=20))
    stats_ = vbgmm.model_stats(df, post).collect()
    assert sum(r.n for r in stats_) == 200 and sum(r.weight for r in stats_) == pytest.approx(1) and {r.rank for r in stats_} == {2}
    pred = vbgmm.predict(df, post).withColumn("true", F.col("component") + 5)
    assert {(r.true, r.component) for r in vbgmm.majority_map(pred).collect()} <= {(6, 1), (7, 2)}
    assert clusters.label_pairs(pred, "component").count() <= 1

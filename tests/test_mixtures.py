"""Mixture choice, agglomeration, assumption tests and small helpers against plain readings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtura.functions import special
from mixtura.operators import clusters, ensemble, evaluation, expression, importance, linear, mixture, stats, vbgmm
from mixtura.sources import io


@pytest.fixture(scope="module")
def blobs(spark):
    """Three well-parted groups of rows, dealt to four folds."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 0.4, (60, 2)) for m in ((0, 0), (4, 0), (0, 5))])
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, x array<double>, fold int").repartition(3).cache()
    return df, x


def test_held_out_likelihood_finds_the_groups(blobs):
    df, x = blobs
    scores = mixture.cross_validate(df, [1, 2, 3], 4, max_iter=30)
    table = {r.k: r for r in mixture.chosen(scores).collect()}
    assert [k for k, r in table.items() if r.best] == [3] and table[3].sumscore == pytest.approx(4 * table[3].meanscore)


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_likelihood_rises_and_folds_are_left_out(blobs, kind):
    df, x = blobs
    state, history = mixture.fit_folds(df, [2], 4, kind=kind, max_iter=12, tolerance=-1)
    for h in history.values():
        assert len(h) == 12 and (np.diff(h) > -1e-9).all()
    # One round by hand, from the state before the last.
    before, _ = mixture.fit_folds(df, [2], 4, kind=kind, max_iter=11, tolerance=-1)
    m, rows = before[2, 1, 0], x[np.arange(len(x)) % 4 != 1]
    j = m.log_joint(rows)
    q = np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])
    after = state[2, 1, 0]
    assert np.allclose(after.weights, q.mean(0)) and np.allclose(after.means, (q.T @ rows) / q.sum(0)[:, None])
    if kind == "full":
        for k in range(2):
            gap = rows - after.means[k]
            assert np.allclose(after.covariances[k], (q[:, k, None] * gap).T @ gap / q[:, k].sum() + 1e-6 * np.eye(2))


def test_grid_fits_together_and_the_best_predicts(spark, blobs):
    df, x = blobs
    scores = ensemble.fit_grid(df, {"k": [1, 3], "max_iter": [60], "inits": [2]}, 2)
    assert scores.count() == 4
    (best,) = ensemble.best_model(scores).collect()
    assert best.k == 3
    again = ensemble.load_model(best.model)
    local = vbgmm.fit_local(x, again.params)
    assert local.history[-1] == pytest.approx(again.history[-1], rel=1e-6)
    assert np.allclose(again.predict_log_density(x), local.predict_log_density(x), atol=1e-3)
    got = ensemble.predict_best(df, scores).toPandas()
    assert got.groupby("component").size().max() >= 55 and len(got) == len(x)
    assert vbgmm.report(again)["settings"].startswith("3 components")
    turned = vbgmm.remapped(again, [2, 0, 1])
    assert np.allclose(turned.predict_proba(x), again.predict_proba(x)[:, [2, 0, 1]])


def test_diagonal_prior_is_halved():
    low, high = np.zeros(3), np.ones(3)
    full, diag = (vbgmm.start(vbgmm.Params(covtyp=c), low, high) for c in ("full", "diag"))
    assert np.allclose(diag.h0, full.h0 / 2) and diag.g0 == full.g0
    own = vbgmm.start(vbgmm.Params(h=np.eye(3)), low, high)
    assert np.allclose(own.h0, np.eye(3)) and own.g0 == vbgmm.Params().g / 2


def truncated(d, quantile):
    d = np.sort(d)
    return d[: max(1, int(len(d) * quantile))].mean()


def plain_agglomeration(runs, quantile):
    to, steps = {x: x for r in runs for a, b, _ in r for x in (a, b)}, []
    first = max(to) + 1
    while len(set(to.values())) > 1:
        dist = {}
        for r in runs:
            pools = {}
            for a, b, v in r:
                if to[a] != to[b]:
                    pools.setdefault(tuple(sorted((to[a], to[b]))), []).append(v)
            for pair, v in pools.items():
                dist.setdefault(pair, []).append(truncated(v, quantile))
        height, a, b = min((np.mean(v), *pair) for pair, v in dist.items())
        new = first + len(steps)
        to = {k: new if v in (a, b) else v for k, v in to.items()}
        steps.append((len(steps), a, b, pytest.approx(height), sum(v == new for v in to.values())))
    return steps


def test_agglomeration_pools_anew(spark):
    rng = np.random.default_rng(5)
    runs = [[(int(a), int(b), float(round(v, 1))) for a, b, v in zip(rng.integers(0, 5, 300), rng.integers(0, 5, 300), rng.gamma(2, 2, 300)) if a != b] for _ in range(2)]
    frames = [spark.createDataFrame(r, "label_a int, label_b int, dist double").repartition(3) for r in runs]
    assert [tuple(r) for r in clusters.agglomerate(frames, 0.25).orderBy("step").collect()] == plain_agglomeration(runs, 0.25)
    means = {(r.a, r.b): (r.n, r.dist) for r in clusters.quantile_mean(frames[0], 0.4, lower=False).collect()}
    for (a, b), (n, dist) in means.items():
        d = np.sort([v for x, y, v in runs[0] if {x, y} == {a, b}])
        assert n == len(d) and dist == pytest.approx(d[int(len(d) * 0.4) :].mean())


def test_folds_are_even_within_classes(spark):
    df = spark.createDataFrame([(i // 2, int(i % 5 == 0)) for i in range(203)], "id long, y int").repartition(5)
    got = evaluation.folds(df, "id", "y", 4)
    assert got.count() == 203
    for y in (0, 1):
        sizes = [r["count"] for r in got.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_shapiro_over_all_rows(spark):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(0, 1, 6000), "skewed": rng.exponential(1, 300), "tied": np.round(rng.normal(0, 1, 400), 1), "few": rng.normal(0, 1, 5), "flat": np.ones(50)}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "feature string, value double").repartition(6)
    got = {r.feature: r for r in stats.shapiro(df).collect()}
    for k in ("normal", "skewed", "tied"):
        w, p = special.shapiro_wilk(values[k])
        assert got[k].w == pytest.approx(w, rel=1e-9) and got[k].p_value == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert got["normal"].p_value > 0.01 > got["skewed"].p_value and 0 < got["few"].w <= 1 and got["flat"].w is None


def test_assumptions(spark):
    rng = np.random.default_rng(2)
    rows = [("even", g, float(v)) for g in "abc" for v in rng.normal(0, 1, 80)] + [("uneven", g, float(v)) for g, s in (("a", 1), ("b", 1), ("c", 9)) for v in rng.normal(0, s, 80)]
    got = {r.feature: r for r in stats.assumptions(spark.createDataFrame(rows, "feature string, grp string, value double")).collect()}
    assert got["even"].normal and got["even"].equal_variance and not got["uneven"].equal_variance


def test_sweep_has_both_cluster_criteria(blobs):
    df, _ = blobs
    got = {r.k: r for r in linear.kmeans_sweep(df.select("x"), [2, 3], 2).collect()}
    assert got[2].silhouette < got[3].silhouette > 0.8 and got[3].ch > 500


def test_importance_helpers(spark):
    pos = spark.createDataFrame([("f", 2, 0), ("g", 0, 1)], "feature string, pos1 long, pos2 long")
    assert {tuple(r) for r in importance.rank_pies(pos).collect()} == {(1, "f", 2), (2, "g", 1)}
    tree = importance.tree_importance(spark.createDataFrame([("f", 0.5), ("g", 0.25)], "feature string, v double"))
    assert {r.feature: round(r.v, 6) for r in tree.collect()} == {"f": round(np.log(2), 6), "g": 0.0}
    one = spark.createDataFrame([("f", 0.3, True)], "feature string, effect double, sig boolean")
    two = spark.createDataFrame([("f", 0.1, False), ("g", 0.2, True)], "feature string, effect double, sig boolean")
    got = {r.feature: (r.a, r.a_sig, r.b, r.b_sig) for r in importance.outer_effects({"a": one, "b": two}).collect()}
    assert got == {"f": (0.3, True, 0.1, False), "g": (None, False, 0.2, True)}
    shares = spark.createDataFrame([("f", 0.5), ("g", 0.5), ("h", 0.9)], "feature string, share double")
    assert [r.feature for r in importance.top(shares, 2).collect()] == ["h", "f"]


def test_source_helpers(spark, tmp_path):
    df = spark.createDataFrame([("a nice Cluster", 1)], "text string, Old2 int")
    assert io.renamed_either(df, {"new": ["Old1", "Old2"]}).columns == ["text", "new"]
    assert df.select(io.mentions("text", ["CLUSTER", "x"]).alias("m"), io.mentions("text", []).alias("n")).first() == (True, False)
    q = spark.createDataFrame([(1, 0, [0.5, 0.5]), (2, 1, [0.2, 0.2]), (3, 1, None)], "id long, label int, q array<double>")
    with pytest.raises(ValueError, match="1 of 3"):
        io.write_allocations(q, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="5 rows"):
        io.write_allocations(q.filter("id < 3"), str(tmp_path / "q"), rows=5)
    assert clusters.check_assignments(q).first() == (3, 1, 1)
    io.append_metrics(spark.createDataFrame([("m", 0.5)], "mthd string, auc double"), str(tmp_path / "m"))
    io.append_metrics(spark.createDataFrame([("n", 0.6)], "mthd string, auc double"), str(tmp_path / "m"))
    assert io.read_metrics(spark, str(tmp_path / "m"), ["n"]).collect() == [("n", 0.6)]
    assert np.allclose(special.pinv(np.array([[np.nan, 2.0], [2.0, 0.0]])), [[0, 0.5], [0.5, 0]])


def test_expression_sets_as_text(spark, tmp_path):
    base = str(tmp_path / "set")
    (tmp_path / "set_AMP_data.csv").write_text("s1\ts2\nf1\t2\t4\nf2\t8\t\n")
    (tmp_path / "set_features.csv").write_text("gene\nf1\tG1\nf2\tG2\n")
    (tmp_path / "set_pheno.csv").write_text("sample\ty\ns1\t0\ns2\t1\n")
    e = expression.load_text(spark, base)
    assert {(r.feature_id, r.sample_id, r.v) for r in e.exprs.collect()} == {("f1", "s1", 1.0), ("f1", "s2", 2.0), ("f2", "s1", 3.0), ("f2", "s2", None)}
    assert {tuple(r) for r in e.pdata.collect()} == {("s1", "0"), ("s2", "1")} and e.fdata.columns == ["feature_id", "gene"]
    expression.save_text(e, str(tmp_path / "out"), ["s1", "s2"])
    again = expression.load_text(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.exprs.collect()} == {tuple(r) for r in e.exprs.collect()}


def test_dense_codes_in_buckets(spark):
    from mixtura.operators import prep

    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, n)) for n in rng.integers(0, 12, 300)]
    df = spark.createDataFrame([(w, float(v)) for w, v in zip(words, rng.integers(-9, 9, 300))] + [(None, None)], "w string, v double").repartition(4)
    for c in ("w", "v"):
        got = prep.dense_codes(df, c, "code").select(c, "code").collect()
        order = {x: i for i, x in enumerate(sorted({r[c] for r in got if r[c] is not None}))}
        assert len(got) == 301 and all(r.code == (None if r[c] is None else order[r[c]]) for r in got)

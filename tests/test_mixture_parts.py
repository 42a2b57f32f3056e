"""Draws, starts and statistics of mixtures; dendrograms, described recoding, small Shapiro-Wilk samples."""

import numpy as np
import pytest

from mixtura.functions import nist, special
from mixtura.operators import clusters, prep, stats, vbgmm


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    return np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 0.5, (40, 2))])


@pytest.mark.parametrize("kind", ["full", "diag"])
def test_moments_of_draws_match_the_posterior(spark, rows, kind):
    post = vbgmm.fit_local(rows, vbgmm.Params(k=2, covtyp=kind, max_iter=50))
    got = vbgmm.draws(spark, post, 1_000_000, seed=3).toPandas()
    x, z = np.stack(got.x), got.component.to_numpy() - 1
    assert got.id.is_unique and np.abs(np.bincount(z) / len(z) - post.delta / post.delta.sum()).max() < 3e-3
    for i in range(2):
        a, b = post.a[post.at(i)], post.b[post.at(i)]
        cov = b / (a - 1.5) if kind == "full" else np.diag(np.diag(b) / (a - 1))
        assert np.abs(x[z == i].mean(0) - post.mean[i]).max() < 6e-3
        assert np.abs(np.cov(x[z == i].T) - cov - post.mean_cov[i]).max() < 0.02 * np.trace(cov)
    plain = vbgmm.draws(spark, post, 200_000, expected=True).toPandas()
    x, z = np.stack(plain.x), plain.component.to_numpy() - 1
    assert all(np.abs(np.cov(x[z == i].T) - np.linalg.inv(post.precision(i))).max() < 0.02 for i in range(2))


def test_draws_repeat_and_have_the_asked_number(spark, rows):
    post = vbgmm.fit_local(rows, vbgmm.Params(k=2, max_iter=5))
    one, two = (sorted(map(str, vbgmm.draws(spark, post, 1001, seed=5, block=100).repartition(p).collect())) for p in (2, 5))
    assert one == two and len(one) == 1001 and vbgmm.draws(spark, post, 0).count() == 0


@pytest.mark.parametrize("init", ["kmeans", "random"])
def test_starts_rise_to_a_fit(rows, init):
    post = vbgmm.fit_local(rows, vbgmm.Params(k=3, init=init, perturb=5.0, max_iter=60))
    assert (np.diff(post.history) > -1e-6).all()
    thin = vbgmm.fit_local(np.vstack([rows, [[90.0, 90.0]]]), vbgmm.Params(k=3, max_iter=20))
    assert np.isfinite(thin.history).all()
    with pytest.raises(ValueError):
        vbgmm.Params(init="odd")


def test_component_statistics(spark, rows):
    post = vbgmm.fit_local(rows, vbgmm.Params(k=2, max_iter=50))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").repartition(3)
    got = {r.component: r for r in vbgmm.model_stats(df, post).collect()}
    at = post.log_joint(rows).argmax(1)
    for i in range(2):
        cov = np.cov(rows[at == i].T)
        assert got[i + 1].n == (at == i).sum() and got[i + 1].sample_rank == 2
        assert got[i + 1].sample_log_det == pytest.approx(np.linalg.slogdet(cov)[1]) and got[i + 1].sample_cond == pytest.approx(np.linalg.cond(cov))
        assert got[i + 1].kl_mean > 0 and got[i + 1].kl_precision > 0
    kl = {(r.a, r.b): r.kl for r in vbgmm.kernel_divergences(spark, post).collect()}
    assert kl[1, 1] == pytest.approx(0, abs=1e-9) and kl[1, 2] > 1
    cov, p, gap = np.linalg.inv(post.precision(0)), post.precision(1), post.mean[1] - post.mean[0]
    assert kl[1, 2] == pytest.approx(0.5 * (np.trace(p @ cov) + gap @ p @ gap - 2 - np.log(np.linalg.det(cov) * np.linalg.det(p))))


def test_convergence_by_leading_digits():
    c = vbgmm.Convergence(1e-3, 2)
    assert [c(v) for v in (-1000.0, -900.0, -900.05, -900.06, -900.05)] == [False, False, False, True, False]
    assert not c.fell
    c(-2000.0)
    assert c.fell
    c.reset()
    assert c.last is None and not c(5.0)
    assert not vbgmm.Convergence(1e-3, 1, rising=False)(1.0)


def test_singular_matrices_have_a_repaired_inverse():
    m = np.array([[1.0, 1.0], [1.0, 1.0]])
    assert np.allclose(vbgmm.inverse(m), np.linalg.pinv(m)) and np.isfinite(vbgmm.inverse(np.array([[np.nan, 0.0], [0.0, 1.0]]))).all()


def test_dendrogram_tables(spark):
    matrix = spark.createDataFrame([(0, 1, 1, 1, 4.0), (0, 2, 1, 1, 1.0), (1, 2, 1, 1, 6.0)], "a int, b int, n_a int, n_b int, dist double")
    leaves, merges, far = clusters.dendrogram(spark, clusters.linkage(spark, matrix), [0, 1, 2])
    assert [r.label for r in leaves.orderBy("position").collect()] == [1, 0, 2]
    assert [(r.left, r.right, r.height, r.x) for r in merges.orderBy("step").collect()] == [(15.0, 25.0, 1.0, 20.0), (5.0, 20.0, 5.0, 12.5)]
    assert {(r.a, r.b): r.dist for r in far.collect()} == {(0, 2): 1.0, (0, 1): 5.0, (1, 2): 5.0}
    empty = spark.createDataFrame([], "step int, a int, b int, dist double")
    assert clusters.dendrogram(spark, empty, [7])[0].count() == 1


def test_posterior_divergence(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "p array<double>, q array<double>")
    r = clusters.posterior_divergence(df, "p", "q").first()
    want = 0.5 * np.log2(2) + 0.5 * np.log2(0.5 / 0.75)
    assert r.n == 2 and r.mean_kl == pytest.approx(want / 2) and r.max_kl == pytest.approx(want)


def test_described_recoding(spark):
    df = spark.createDataFrame([(i, str(i) if i % 4 else "?", [float(i), float(-i)], "ab"[i % 2], "xyz"[i % 3], "q", i % 2) for i in range(12)], "id long, age string, two array<double>, sex string, town string, gone string, y int")
    about = spark.createDataFrame([("id", "ID", "Integer", "no"), ("age", "Feature", "Integer", "yes"), ("two", "Feature", "Continuous", "no"), ("sex", "Feature", "Binary", "no"), ("town", "Feature", "Categorical", "no"), ("gone", "Feature", "Categorical", "yes"), ("y", "Target", "Integer", "no")], "name string, role string, type string, missing_values string")
    features, targets = prep.recode_described(df, "id", about, k=2)
    assert set(features.columns) == {"id", "age", "two_0", "two_1", "sex", "town_0", "town_1", "town_2"} and targets.columns == ["id", "y"]
    rows = {r.id: r for r in features.collect()}
    assert rows[1].age == 1.0 and rows[4].age is not None and rows[0].sex == 0.5 and rows[1].sex == -0.5 and rows[5].town_2 == 1.0 and rows[3].two_1 == -3.0
    plain, _ = prep.recode_described(df, "id", about, recoded=False, k=2)
    assert set(plain.columns) == {"id", "age", "two_0", "two_1", "sex", "town"} and {r.town for r in plain.collect()} == {"x", "y", "z"}
    never = lambda c: prep.F.lit(False)
    kept, _ = prep.recode_described(df, "id", about, detect=never, treat=lambda d, i, cols: d)
    assert kept.filter("age is null").count() == 3
    with pytest.raises(ValueError):
        prep.recode_described(df, "id", spark.createDataFrame([("age", "Feature", "Date", "no")], about.schema))


def test_shapiro_of_few_values(spark):
    known = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]  # a published example
    w, p = special.shapiro_wilk(np.array(known))
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=2e-4)
    long = spark.createDataFrame([("known", v) for v in known] + [("three", v) for v in (1.0, 2.0, 10.0)] + [("even", v) for v in (1.0, 2.0, 3.0)] + [("five", float(v)) for v in (1, 2, 4, 8, 9)] + [("two", 1.0), ("two", 2.0)], "feature string, value double")
    got = {r.feature: (r.w, r.p_value) for r in stats.shapiro(long).collect()}
    assert got["known"] == pytest.approx((w, p)) and got["even"] == pytest.approx((1.0, 1.0), abs=1e-6) and got["two"] == (None, None)
    x = np.array([1.0, 2.0, 10.0])
    w3 = 0.5 * 81 / ((x - x.mean()) ** 2).sum()
    assert got["three"] == pytest.approx((w3, 6 / np.pi * (np.arcsin(np.sqrt(w3)) - np.arcsin(np.sqrt(0.75)))))
    assert 0 < got["five"][1] <= 1


def test_overlay_has_data_and_grid(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 5.0)], "y double, x double")
    rows = nist.overlay(df, "misra1a", 7).collect()
    assert sum(r.kind == "data" for r in rows) == 2 and sum(r.kind == "grid" and r.y is None for r in rows) == 7


def test_codes_of_texts_with_one_beginning(spark):
    df = spark.createDataFrame([(f"https://site/{i * 7919 % 500:05d}",) for i in range(500)] + [(None,)], "s string").repartition(3)
    got = {r.s: r.c for r in prep.dense_codes(df, "s", "c").collect()}
    assert all(got[s] == i for i, s in enumerate(sorted(x for x in got if x))) and got[None] is None


def test_text_sets_keep_lines_that_read_like_the_header(spark, tmp_path):
    from mixtura.operators import expression

    base = str(tmp_path / "set")
    (tmp_path / "set_AMP_data.csv").write_text("s1\ts2\ns1\t2\t4\nf2\t8\t\nfeature_id\t1\t\"1\n")
    (tmp_path / "set_features.csv").write_text("feature_id\tnote\ns1\tfirst\nfeature_id\tnote\nf2\tlast\n")
    (tmp_path / "set_pheno.csv").write_text("sample_id\tlabel\ns1\t0\ns2\t1\n")
    e = expression.load_text(spark, base)
    got = {(r.feature_id, r.sample_id): r.v for r in e.exprs.collect()}
    assert got[("s1", "s1")] == 1.0 and got[("s1", "s2")] == 2.0 and got[("f2", "s1")] == 3.0 and got[("f2", "s2")] is None and got[("feature_id", "s1")] == 0.0
    assert {r.feature_id: r.note for r in e.fdata.collect()} == {"s1": "first", "feature_id": "note", "f2": "last"}

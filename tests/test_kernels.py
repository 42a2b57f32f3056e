"""Landmark kernel machines, perceptrons and forests against their dense forms and by optimality."""

import numpy as np
import pytest

from mixtura.operators import classify, evaluation, landmark
from mixtura.operators.sums import lbfgs, summed


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3))
    y = ((x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=90)) > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "id long, x array<double>, y int").repartition(3)
    return x, y, df


def test_ridge_with_all_landmarks_is_the_full_kernel(spark, rows):
    x, y, df = rows
    bad = spark.createDataFrame([(900, None, 1), (901, [0.0, float("nan"), 1.0], 0), (902, [0.0] * 3, None)], df.schema)
    got = landmark.kernel_ridge(df.union(bad), [0.3], [1.0], 4).toPandas()
    assert len(got) == 90 and not landmark.kernel_ridge(df.limit(0), [0.3], [1.0]).count()
    for f in range(4):
        own, rest = got[got.fold == f], got[got.fold != f].id.to_numpy()
        want = classify.KernelRidge(0.3).fit(x[rest], y[rest]).predict_proba(x[own.id.to_numpy()])[:, 1]
        assert np.abs(want - own.p.to_numpy()).max() < 1e-9


def test_ridge_with_few_landmarks_and_a_grid(rows):
    got = landmark.kernel_ridge(rows[2], [0.1, 0.3, 1.0], [0.3, 3.0], 3, m=30).toPandas()
    assert ((got.p > 0.5) == got.y).mean() > 0.75


def test_svm_closes_its_duality_gap(rows):
    s = landmark.Svm(rows[2], [0.1, 0.5], [0.5, 2.0], 3, rounds=60)
    data = s.data.toPandas()
    x, y, fold = np.stack(data.x), np.where(data.y == 1, 1.0, -1.0), data.fold.to_numpy()
    for i, gamma in enumerate(s.gammas):
        kernel = landmark.rbf(x, x, gamma)
        for pair in s.out[:3]:
            for j, cost in enumerate(s.costs):
                train, w = ~np.isin(fold, pair), s.w[i, s.out.index(pair), j]
                lack = np.maximum(0, 1 - y[train] * (s.feats(x[train], i) @ w))
                primal = 0.5 * w[:-1] @ w[:-1] + cost * (lack**2).sum()
                a = 2 * cost * lack
                dual = a.sum() - 0.5 * (a * y[train]) @ kernel[np.ix_(train, train)] @ (a * y[train]) - (a**2).sum() / (4 * cost)
                assert primal - dual < 5e-3 * primal and abs((a * y[train]).sum()) < 5e-3 * a.sum()
    got = s.out_of_fold().toPandas()
    assert len(got) == 90 and ((got.p > 0.5) == got.y).mean() > 0.7
    assert np.isfinite(evaluation.loglik(s.out_of_fold()).first()[0])


def test_evidence_with_all_values_is_the_dense_one(rows):
    x, y, df = rows
    got = {r.feature: r.log_odds for r in landmark.feature_evidence(df.filter("id < 12"), scales=[1.0], m=12).collect()}
    one = np.ones((12, 1))
    base = classify.GaussianProcess().fit(one, y[:12]).log_marginal
    for j in range(3):
        assert got[j] == pytest.approx(classify.GaussianProcess().fit(np.hstack([one, x[:12, [j]]]), y[:12]).log_marginal - base, abs=1e-6)


def test_evidence_tells_features_apart(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([([float(rng.normal() + 2 * (i % 2)), float(rng.normal())], i % 2) for i in range(200)], "x array<double>, y int")
    got = {r.feature: r.log_odds for r in landmark.feature_evidence(df).collect()}
    assert got[0] > got[1] + 5


def test_kernel_pca_is_the_dense_one(rows):
    x, _, df = rows
    k = landmark.KernelPca(df, 0.3, 5)
    centred = np.eye(90) - 1 / 90
    values, vectors = np.linalg.eigh(centred @ landmark.rbf(x, x, 0.3) @ centred)
    assert np.allclose(values[::-1][:5], k.values)
    got = np.stack(k.transform(df).orderBy("id").toPandas().x)
    assert np.allclose(np.abs(got), np.abs(vectors[:, ::-1][:, :5] * np.sqrt(values[::-1][:5])), atol=1e-8)


def test_perceptron_gradient_by_differences():
    rng = np.random.default_rng(2)
    v = classify._Layout(3, (4, 2))
    w, x, y, weight = rng.normal(size=(2, v.p)), rng.normal(size=(7, 3)), rng.integers(0, 2, 7), rng.random((2, 7))
    _, g = v.losses(w, x, y, weight)
    for j in range(v.p):
        step = np.zeros_like(w)
        step[:, j] = 1e-6
        diff = (v.losses(w + step, x, y, weight)[0] - v.losses(w - step, x, y, weight)[0]) / 2e-6
        assert np.allclose(diff, g[:, j], atol=1e-6)


def test_perceptrons_and_forests_on_held_out_folds(spark, rows):
    got = classify.perceptrons(rows[2], [(6,), (4, 4)], [1e-2, 1.0], 3, rounds=30).toPandas()
    assert len(got) == 90 and ((got.p > 0.5) == got.y).mean() > 0.65
    flat = rows[2].selectExpr("id", "y", "x[0] * x[1] as a", "x[2] as b")
    some = classify.forests(flat, ["a", "b"], [5], ["gini", "entropy"], [3], 3)
    store = {r.mthd: r for r in evaluation.evaluate_all(some.selectExpr("'RFC' as mthd", "p", "y").union(some.selectExpr("'const'", "0.5D", "y"))).collect()}
    assert store["RFC"].auc > 0.8 and store["const"].auc == 0
    one = evaluation.evaluate(some, "RFC").first()
    assert all(store["RFC"][c] == pytest.approx(one[c]) for c in ("auc", "acc", "pval", "shannon"))


def test_choices_need_three_folds(rows):
    with pytest.raises(ValueError):
        landmark.Svm(rows[2], [0.1], [1.0], 2)
    with pytest.raises(ValueError):
        classify.perceptrons(rows[2], [(3,)], [1.0], 2)


def test_lbfgs_and_sums(spark):
    a = np.stack([np.diag([1.0, 9.0, 0.5]), np.eye(3)])
    b = np.array([[1.0, -2.0, 3.0], [0.0, 1.0, 0.0]])
    w = lbfgs(lambda w: (0.5 * np.einsum("mi,mij,mj->m", w, a, w) - (b * w).sum(1), np.einsum("mij,mj->mi", a, w) - b), np.zeros((2, 3)))
    assert np.allclose(w, np.linalg.solve(a, b[:, :, None])[:, :, 0], atol=1e-4)
    df = spark.range(1000).repartition(7)
    assert summed(df, lambda r: np.full(70_000, r.column(0).to_numpy().sum()), (70_000,))[-1] == 499500


def test_folds_keep_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, y int")
    dealt = evaluation.folds(df, "id", "y", 5)
    assert dealt.count() == 100 and {r["count"] for r in dealt.filter("y is null").groupBy("fold").count().collect()} == {4}


def test_chances_are_of_few_rows_at_once(spark):
    data = spark.range(3000, numPartitions=1).selectExpr("array(double(id)) as x", "1.0D as y", "0 as fold", "id")
    got = landmark.chances_of(data, lambda xs, fold: np.full(len(xs), float(len(xs))), "id").toPandas()
    assert sorted(got.id) == list(range(3000)) and got.p.max() <= 1024

"""Rounds of mixtures over blocks of rows against plain sums over the rows."""

import numpy as np
import pytest

from mixtura.operators import mixture


@pytest.fixture(scope="module")
def rows(spark):
    """5200 rows of three values; folds 0 to 2, some without a fold, some of folds that nothing leaves out."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(m, 1.0, (2600, 3)) for m in (-2.0, 2.0)])
    fold = [None if i % 11 == 0 else 7 if i % 13 == 0 else i % 3 for i in range(len(x))]
    df = spark.createDataFrame([(v.tolist(), f) for v, f in zip(x, fold)], "x array<double>, fold int").repartition(3).cache()
    df.count()
    return df, x, np.array([-2 if f in (None, 7) else f for f in fold])


def _mixtures(rng, sizes, d, far=0.0):
    out = []
    for k in sizes:
        roots = np.tril(rng.normal(size=(k, d, d))) + 3 * np.eye(d)
        out.append(mixture.Mixture(rng.dirichlet(np.ones(k)), far + rng.normal(size=(k, d)), roots @ roots.transpose(0, 2, 1)))
    return out


def test_a_round_reads_few_blocks_of_one_fold(spark, rows):
    df, x, fold = rows
    blocks, n, d = mixture.blocked(df, 3)
    got = [(r.fold, np.frombuffer(r.rows).reshape(-1, d)) for r in blocks.collect()]
    assert (n, d) == x.shape and max(b.size for _, b in got) <= mixture.BLOCK and len(got) <= 4 * spark.sparkContext.defaultParallelism + n * d // mixture.BLOCK
    for f in (-2, 0, 1, 2):
        mine = np.vstack([b for g, b in got if g == f])
        assert np.array_equal(mine[np.lexsort(mine.T)], x[fold == f][np.lexsort(x[fold == f].T)])
    whole = mixture.blocked(df, 0)[0]
    assert {r.fold for r in whole.collect()} == {mixture.NEVER}


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_mixtures_side_by_side_equal_each_alone(far):
    rng = np.random.default_rng(1)
    models, x = _mixtures(rng, (1, 1, 2, 4, 4), 5, far), far + rng.normal(size=(40, 5)) * 3
    grid = mixture.Grid.of(models)
    for which in (np.ones(5, bool), np.array([False, True, False, True, True])):
        q, density = grid.only(which).posterior(x)
        some = [m for m, w in zip(models, which) if w]
        joint = [m.log_joint(x) for m in some]
        assert np.allclose(density, [m.log_density(x) for m in some], atol=1e-8)
        assert np.allclose(q, np.concatenate([np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None]).T for j in joint]), atol=1e-8)


def test_sums_of_products_unfold():
    x = np.random.default_rng(2).normal(size=(30, 4))
    q = np.random.default_rng(3).random((2, 30))
    v = mixture._unfolded(q @ mixture._products(x).T, 4)
    assert np.allclose(v, np.concatenate([q.sum(1), (q @ x).ravel(), *(((x * w[:, None]).T @ x).ravel() for w in q)]))


def test_seed_fixes_the_start_and_rounds_equal_plain_sums(rows):
    df, x, fold = rows
    one, first = mixture.fit_folds(df, [1, 3], 3, max_iter=2, tolerance=-1, sample=500, seed=4)
    two, again = mixture.fit_folds(df, [1, 3], 3, max_iter=3, tolerance=-1, sample=500, seed=4)
    for key, m in one.items():
        used = x[fold != key[1]]  # rows without a fold among them
        assert np.allclose(first[key], again[key][:2], rtol=1e-12) and again[key][2] == pytest.approx(m.log_density(used).mean(), rel=1e-10)
        j = m.log_joint(used)
        q = np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])
        assert np.allclose(two[key].weights, q.mean(0)) and np.allclose(two[key].means, (q.T @ used) / q.sum(0)[:, None])


def test_scores_are_of_the_held_out_rows(rows):
    df, x, fold = rows
    state, _ = mixture.fit_folds(df, [2], 3, max_iter=4, sample=500)
    got = {(r.k, r.fold): r.score for r in mixture.cross_validate(df, [2], 3, max_iter=4, sample=500).collect()}
    assert got == {(2, f): pytest.approx(state[2, f, 0].log_density(x[fold == f]).mean(), rel=1e-9) for f in range(3)}

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixtura.functions import nist, special, vec


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_softmax_of_large_scores(spark):
    got = one(spark, vec.softmax(vec.literal([-28000, -28010])))
    assert got == pytest.approx([0.9999546021, 0.0000453979], abs=1e-9)
    finite = vec.finite_or(F.array(vec.dbl(1), F.lit(None).cast("double"), vec.dbl("inf")), vec.dbl(-3))
    assert one(spark, finite) == [1.0, -3.0, -3.0]


def test_divergences(spark):
    p, q = vec.literal([0.5, 0.5, 0.0]), vec.literal([0.25, 0.25, 0.5])
    assert one(spark, vec.kl_raw(p, q)) == pytest.approx(1.0)
    assert one(spark, vec.kl_raw(q, p)) == math.inf
    assert one(spark, vec.jeffreys(p, q)) == pytest.approx(one(spark, vec.kl_clamped(p, q)) + one(spark, vec.kl_clamped(q, p)), rel=1e-9)
    assert one(spark, vec.coloc(p, q)) == pytest.approx(-math.log(0.25))


def test_scalars(spark):
    assert one(spark, vec.safe_exp(vec.dbl(1000))) == np.finfo(float).max
    assert one(spark, vec.safe_exp(vec.dbl(-1000))) == 0
    assert one(spark, vec.safe_logit(vec.dbl(0))) == pytest.approx(math.log(1e-6))
    assert one(spark, vec.fisher_z(vec.dbl(0.5))) == pytest.approx(math.atanh(0.5))
    assert [one(spark, vec.stars(vec.dbl(p))) for p in (0.0001, 0.005, 0.03, 0.07, 0.5)] == ["***", "**", "*", ".", "not sig."]
    assert one(spark, vec.argmax(vec.literal([1, 3, 3]))) == 1


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert special.f_sf(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert [special.mcnemar_midp(*x) for x in ((3, 9), (0, 0), (5, 5))] == pytest.approx([0.0922851563, 1.0, 1.0], abs=1e-9)
    w, p = special.shapiro_wilk(np.random.default_rng(0).normal(size=200))
    assert w > 0.98 and p > 0.01
    assert special.shapiro_wilk(np.random.default_rng(0).exponential(size=200))[1] < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.floats(0.01, 50), st.integers(1, 30))
def test_chi2_even_degrees_have_a_closed_form(x, half):
    closed = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(half))
    assert special.chi2_sf(x, 2 * half) == pytest.approx(closed, rel=1e-9, abs=1e-14)


def test_nist(spark):
    df = spark.createDataFrame([(10.07, 77.6), (81.78, 760.0)], "y double, x double")
    got = [r.p for r in df.select(nist.problem("Misra1a").predictor(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([10.07, 81.78], abs=0.2)
    assert nist.grid(df, "misra1a", 5).count() == 5
    with pytest.raises(nist.NistError):
        nist.problem("none")

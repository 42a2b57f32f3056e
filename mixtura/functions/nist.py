"""Closed-form predictors of certified non-linear regression problems, as Column builders."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtura.functions.vec import dbl


class NistError(ValueError):
    """An unknown problem."""


# Certified coefficients (fixed values).
COEFFICIENTS = {
    "misra1a": (2.3894212918e02, 5.5015643181e-04),
    "danwood": (7.6886226176e-01, 3.8604055871e00),
    "hahn1": (1.0776351733e00, -1.2269296921e-01, 4.0863750610e-03, -1.4262662514e-06, -5.7609940901e-03, 2.4053735503e-04, -1.2314450199e-07),
    "roszman1": (2.0196866396e-01, -6.1953516256e-06, 1.2044556708e03, -1.8134269537e02),
    "nelson": (2.5906836021e00, 5.6177717026e-09, -5.7701013174e-02),
    "gauss1": (9.8778210871e01, 1.0497276517e-02, 1.0048990633e02, 6.7481111276e01, 2.3129773360e01, 7.1994503004e01, 1.7899805021e02, 1.8389389025e01),
}


def _misra1a(b, x: Column) -> Column:
    return b[0] * (1 - F.exp(-b[1] * x))


def _danwood(b, x: Column) -> Column:
    return b[0] * F.exp(b[1] * F.log(x))


def _hahn1(b, x: Column) -> Column:
    return (b[0] + b[1] * x + b[2] * x * x + b[3] * x * x * x) / (1 + b[4] * x + b[5] * x * x + b[6] * x * x * x)


def _roszman1(b, x: Column) -> Column:
    return b[0] - b[1] * x - F.atan(b[2] / (x - b[3])) / dbl(3.141592653589793)


def _nelson(b, x1: Column, x2: Column) -> Column:
    return F.exp(b[0] - b[1] * x1 * F.exp(-b[2] * x2))


def _gauss1(b, x: Column) -> Column:
    bell = lambda h, m, s: h * F.exp(-((x - m) * (x - m)) / (s * s))
    return b[0] * F.exp(-b[1] * x) + bell(b[2], b[3], b[4]) + bell(b[5], b[6], b[7])


@dataclass(frozen=True)
class Problem:
    name: str
    legend: str
    regressors: tuple[str, ...]
    formula: Callable[..., Column]

    def predictor(self, *x: Column, coefficients: tuple[float, ...] | None = None) -> Column:
        return self.formula([dbl(v) for v in coefficients or COEFFICIENTS[self.name]], *x)


PROBLEMS = {
    p.name: p
    for p in (
        Problem("misra1a", "b1 (1 - exp(-b2 x))", ("x",), _misra1a),
        Problem("danwood", "b1 x^b2", ("x",), _danwood),
        Problem("hahn1", "cubic over cubic", ("x",), _hahn1),
        Problem("roszman1", "b1 - b2 x - atan(b3 / (x - b4)) / pi", ("x",), _roszman1),
        Problem("nelson", "exp(b1 - b2 x1 exp(-b3 x2))", ("x1", "x2"), _nelson),
        Problem("gauss1", "decay and two bells", ("x",), _gauss1),
    )
}


def problem(name: str) -> Problem:
    if name.lower() not in PROBLEMS:
        raise NistError(f"unknown problem {name!r}; known: {', '.join(PROBLEMS)}")
    return PROBLEMS[name.lower()]


def load(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """The data of a problem: y and the regressors in declared order."""
    p = problem(name)
    schema = ", ".join(f"{c} double" for c in ("y", *p.regressors))
    return spark.read.csv(path, sep=sep, header=True, schema=schema).select("y", *p.regressors)


def grid(data: DataFrame, name: str, points: int = 100) -> DataFrame:
    """The predictor on an even grid between the least and largest regressors."""
    p = problem(name)
    bounds = data.agg(*(f(c).alias(f"{n}_{c}") for c in p.regressors for n, f in (("low", F.min), ("high", F.max))))
    even = lambda low, high: F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * (high - low) / (points - 1)))
    for c in p.regressors:
        bounds = bounds.withColumn(c, even(F.col(f"low_{c}"), F.col(f"high_{c}")))
    return bounds.select(*p.regressors, p.predictor(*(F.col(c) for c in p.regressors)).alias("predicted"))


def overlay(data: DataFrame, name: str, points: int = 100) -> DataFrame:
    """(kind, regressors, y, predicted): the observations with their predictions, and the predictor on an
    even grid between them (``y`` null), as one table to plot."""
    p = problem(name)
    own = data.select(F.lit("data").alias("kind"), *p.regressors, "y", p.predictor(*(F.col(c) for c in p.regressors)).alias("predicted"))
    return own.unionByName(grid(data, name, points).select(F.lit("grid").alias("kind"), *p.regressors, F.lit(None).cast("double").alias("y"), "predicted"))

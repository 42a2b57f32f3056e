"""Column builders on array<double>: all stay within Spark's expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: float) -> Column:
    """A literal as double; bare literals would be decimals in SQL."""
    return F.lit(float(x)).cast("double")


def r6(x: Col) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(_c(x), 6) + dbl(0)


def as_double(x: Col) -> Column:
    return F.transform(_c(x), lambda v: v.cast("double"))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(dbl(v) for v in values))


def let(value: Col, body) -> Column:
    """``body(value)`` with the value worked out once, where higher-order functions would repeat it
    for each element."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def total(x: Col) -> Column:
    return F.aggregate(_c(x), dbl(0), lambda a, v: a + v)


def dot(x: Col, y: Col) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def sqdist(x: Col, y: Col) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def argmax(x: Col) -> Column:
    """0-based place of the largest element, the first of equals."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def normalise(x: Col) -> Column:
    return let(x, lambda a: let(total(a), lambda t: F.transform(a, lambda v: v / t)))


def finite_or(x: Col, least: Col) -> Column:
    """Missing and infinite entries replaced, as scores of failed fits are by the finite minimum."""
    return F.transform(_c(x), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == dbl("inf")), _c(least)).otherwise(v))


def softmax(x: Col) -> Column:
    """Shifted by the maximum; sums to 1 for any finite scores."""
    return normalise(let(x, lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda v: F.exp(v - m)))))


def logsumexp(x: Col) -> Column:
    return let(x, lambda a: let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda v: F.exp(v - m))))))


def safe_exp(x: Col) -> Column:
    """Overflow gives the largest double, underflow 0."""
    x = _c(x)
    return F.when(x > 709.78, dbl(1.7976931348623157e308)).when(x < -745.1, dbl(0)).otherwise(F.exp(x))


def safe_log(x: Col, least: float = 1e-101) -> Column:
    return F.log(F.greatest(_c(x), dbl(least)))


def safe_logit(p: Col, tol: float = 1e-6) -> Column:
    p = _c(p)
    return F.log(F.greatest(F.least(p, dbl(1)), dbl(tol))) - F.log(F.greatest(F.least(1 - p, dbl(1)), dbl(tol)))


def logit(p: Col, eps: float = 1e-100) -> Column:
    """Clamped from below only."""
    p = _c(p)
    return F.log(F.greatest(p, dbl(eps))) - F.log(F.greatest(1 - p, dbl(eps)))


def fisher_z(v: Col) -> Column:
    return F.atanh(_c(v))


def kl_raw(p: Col, q: Col) -> Column:
    """Sum of p (log2 p - log2 q); terms with p = 0 count 0, with q = 0 infinity."""
    term = lambda a, b: F.when(a <= 0, dbl(0)).when(b <= 0, dbl("inf")).otherwise(a * (F.log2(a) - F.log2(b)))
    return total(F.zip_with(_c(p), _c(q), term))


def clamped(p: Col, tol: float = 1e-300) -> Column:
    """Clamped from below and normalised again."""
    return normalise(F.transform(_c(p), lambda v: F.greatest(v, dbl(tol))))


def kl_clamped(p: Col, q: Col, tol: float = 1e-300) -> Column:
    return total(F.zip_with(clamped(p, tol), clamped(q, tol), lambda a, b: a * (F.log2(a) - F.log2(b))))


def jeffreys(p: Col, q: Col, tol: float = 1e-300) -> Column:
    """KL both ways, as one sum."""
    return total(F.zip_with(clamped(p, tol), clamped(q, tol), lambda a, b: (a - b) * (F.log2(a) - F.log2(b))))


def coloc(p: Col, q: Col, tiny: float = 1e-300) -> Column:
    """-log of the chance that both are in one cluster."""
    return -F.log(F.greatest(dot(p, q), dbl(tiny)))


def one_of_c(y: Col, low: int, high: int) -> Column:
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: (_c(y) == k).cast("int"))


def thinplate(x: Col, centers: Sequence[Sequence[float]], eps: float = 1e-12) -> Column:
    """[1, x, r2 log r2 for each centre]."""
    r2 = [sqdist(x, literal(c)) + dbl(eps) for c in centers]
    return F.concat(literal([1]), _c(x), F.array(*(r * F.log(r) for r in r2)))


def gauss_basis(x: Col, centers: Sequence[Sequence[float]], scale: float) -> Column:
    """[1, x, exp(-((x - k) scale)^2 / 2) for each centre]."""
    return F.concat(literal([1]), _c(x), F.array(*(F.exp(dbl(-0.5 * scale * scale) * sqdist(x, literal(c))) for c in centers)))


def linmap(v: Col, low: Col, high: Col, to_low: float, to_high: float) -> Column:
    return dbl(to_low) + (_c(v) - _c(low)) / (_c(high) - _c(low)) * dbl(to_high - to_low)


def stars(p: Col) -> Column:
    p = _c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("not sig.")

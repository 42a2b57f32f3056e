"""Scalar and vector functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtura.functions import nist, vec
from mixtura.functions.vec import r6
from mixtura.operators import blocks, clusters
from mixtura.plans.fixtures import TAU, emb, qin, scores_to_centroids, table, with_
from mixtura.plans.registry import Registry

REGISTRY = query = Registry()

#: Fixed centres and scale of the basis expansions.
CENTERS = ((5.0, 0.02), (25.0, 0.05), (45.0, 0.08))
SCALE = 0.1


@query(with_("lng", "cent", "d2", "qin") + "SELECT vec_id, CAST(k AS INT) AS k, round(p, 6) + 0.0::DOUBLE AS p FROM qin")
def softmax(spark, d):
    return qin(spark, d).select("vec_id", F.posexplode("q").alias("k", "p")).select("vec_id", "k", r6("p").alias("p"))


@query(with_("lng", "cent", "d2") + f"SELECT vec_id, round(max(s) + ln(sum(exp(s - m))), 6) AS lse FROM (SELECT vec_id, CAST(-{TAU} AS DOUBLE) * d AS s, max(CAST(-{TAU} AS DOUBLE) * d) OVER (PARTITION BY vec_id) AS m FROM d2) GROUP BY vec_id")
def logsumexp(spark, d):
    return scores_to_centroids(spark, d).select("vec_id", r6(vec.logsumexp("s")).alias("lse"))


@query(with_("lng", "cent", "d2", "qin") + "SELECT vec_id, CAST(min(k) AS INT) AS cluster FROM (SELECT vec_id, k, p = max(p) OVER (PARTITION BY vec_id) AS top FROM qin) WHERE top GROUP BY vec_id")
def qin_argmax(spark, d):
    return qin(spark, d).select("vec_id", vec.argmax("q").alias("cluster"))


_RATES = "SELECT l_discount, l_tax, count(*) AS n, "


def _rates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount", "l_tax").agg(F.count("*").alias("n"))


def _zero(c):
    """DuckDB's footer statistics may hold a negative zero."""
    return (F.col(c) + F.lit(0.0)).alias(c)


@query("SELECT l_discount + 0.0 AS l_discount, count(*) AS n, round(ln(greatest(least(l_discount, 1), 1e-6)) - ln(greatest(least(1 - l_discount, 1), 1e-6)), 6) + 0.0::DOUBLE AS v FROM lineitem GROUP BY l_discount")
def safe_logit(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).select(_zero("l_discount"), "n", r6(vec.safe_logit("l_discount")).alias("v"))


@query("SELECT l_discount + 0.0 AS l_discount, count(*) AS n, round(ln(greatest(l_discount, 1e-100)) - ln(greatest(1 - l_discount, 1e-100)), 6) + 0.0::DOUBLE AS v FROM lineitem GROUP BY l_discount")
def logit(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).select(_zero("l_discount"), "n", r6(vec.logit("l_discount")).alias("v"))


@query("SELECT l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, count(*) AS n, round(atanh(l_discount - l_tax), 6) + 0.0::DOUBLE AS z FROM lineitem GROUP BY l_discount, l_tax")
def fisher_z(spark, d):
    return _rates(spark, d).select(_zero("l_discount"), _zero("l_tax"), "n", r6(vec.fisher_z(F.col("l_discount") - F.col("l_tax"))).alias("z"))


@query("SELECT l_tax + 0.0 AS l_tax, count(*) AS n, round(ln(greatest(l_tax, 1e-101)), 6) + 0.0::DOUBLE AS v FROM lineitem GROUP BY l_tax")
def safe_log(spark, d):
    return table(spark, d, "lineitem").groupBy("l_tax").agg(F.count("*").alias("n")).select(_zero("l_tax"), "n", r6(vec.safe_log("l_tax")).alias("v"))


@query("SELECT l_quantity, count(*) AS n, CASE WHEN 20 * l_quantity > 709.78 THEN 1.7976931348623157e308 ELSE NULL END IS NOT NULL AS capped, round(CASE WHEN -20 * l_quantity < -745.1 THEN 0 ELSE exp(-20 * l_quantity) END * 1e9, 6) + 0.0::DOUBLE AS small FROM lineitem GROUP BY l_quantity")
def safe_exp(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return q.select("l_quantity", "n", (vec.safe_exp(20 * F.col("l_quantity")) == vec.dbl(1.7976931348623157e308)).alias("capped"), r6(vec.safe_exp(-20 * F.col("l_quantity")) * 1e9).alias("small"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 2 - 1, 6) + 0.0::DOUBLE AS v FROM part")
def linmap(spark, d):
    p = table(spark, d, "part")
    bounds = F.broadcast(p.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")))  # one row
    return p.crossJoin(bounds).select("p_partkey", r6(vec.linmap("p_retailprice", "low", "high", -1.0, 1.0)).alias("v"))


def _basis(f: str) -> str:
    terms = ", ".join(f"round({f.format(r2=f'((l_quantity - {a}) * (l_quantity - {a}) + (l_discount - {b}) * (l_discount - {b}))')}, 6) + 0.0::DOUBLE AS b{i}" for i, (a, b) in enumerate(CENTERS))
    return f"SELECT l_quantity, l_discount + 0.0 AS l_discount, count(*) AS n, {terms} FROM lineitem GROUP BY l_quantity, l_discount"


def _expanded(spark, d, make):
    q = table(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"))
    x = make(F.array("l_quantity", "l_discount"))
    return q.select("l_quantity", _zero("l_discount"), "n", *(r6(F.get(x, F.lit(3 + i))).alias(f"b{i}") for i in range(len(CENTERS))))


@query(_basis("({r2} + 1e-12) * ln({r2} + 1e-12)"))
def thinplate(spark, d):
    return _expanded(spark, d, lambda x: vec.thinplate(x, CENTERS))


@query(_basis(f"exp(-0.5 * {SCALE * SCALE!r}::DOUBLE * {{r2}})"))
def gauss_basis(spark, d):
    return _expanded(spark, d, lambda x: vec.gauss_basis(x, CENTERS, SCALE))


_NIST_SQL = {
    "misra1a": "{0} * (1 - exp(-({1}) * l_quantity))",
    "danwood": "{0} * exp({1} * ln(l_quantity))",
    "hahn1": "({0} + ({1}) * l_quantity + {2} * l_quantity * l_quantity + ({3}) * l_quantity * l_quantity * l_quantity) / (1 + ({4}) * l_quantity + {5} * l_quantity * l_quantity + ({6}) * l_quantity * l_quantity * l_quantity)",
    "roszman1": "{0} - ({1}) * l_quantity - atan({2} / (l_quantity - ({3}))) / pi()",
    "nelson": "exp({0} - ({1}) * l_quantity * exp(-({2}) * (100 * l_discount)))",
    "gauss1": "{0} * exp(-({1}) * l_quantity) + {2} * exp(-((l_quantity - {3}) * (l_quantity - {3})) / ({4} * {4})) + {5} * exp(-((l_quantity - {6}) * (l_quantity - {6})) / ({7} * {7}))",
}


def _nist(name: str):
    b = [f"CAST({v!r} AS DOUBLE)" for v in nist.COEFFICIENTS[name]]
    two = name == "nelson"
    keys = "l_quantity, l_discount" if two else "l_quantity"
    sql = f"SELECT l_quantity, {'l_discount + 0.0 AS l_discount, ' if two else ''}count(*) AS n, round({_NIST_SQL[name].format(*b)}, 6) + 0.0::DOUBLE AS predicted FROM lineitem GROUP BY {keys}"

    def run(spark, d):
        x = table(spark, d, "lineitem").groupBy(*keys.split(", ")).agg(F.count("*").alias("n"))
        inputs = [F.col("l_quantity"), 100 * F.col("l_discount")] if two else [F.col("l_quantity")]
        return x.select("l_quantity", *([_zero("l_discount")] if two else []), "n", r6(nist.problem(name).predictor(*inputs)).alias("predicted"))

    query(sql, f"nist_{name}")(run)


for _name in nist.PROBLEMS:
    _nist(_name)

_PAIRS = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, min(x.label) AS label_a, min(y.label) AS label_b, {f} AS dist FROM qin x JOIN qin y ON x.k = y.k AND x.vec_id < y.vec_id GROUP BY x.vec_id, y.vec_id)"
_JEFF = _PAIRS.format(f="sum((greatest(x.p, 1e-300) - greatest(y.p, 1e-300)) * (log2(greatest(x.p, 1e-300)) - log2(greatest(y.p, 1e-300))))")


@query(with_("lng", "cent", "d2", "qin", more=_JEFF) + "SELECT a, b, round(dist, 5) + 0.0::DOUBLE AS dist FROM pairs")
def jeffreys_pairs(spark, d):
    return clusters.pair_metrics(qin(spark, d), "vec_id", "jeffreys", None, decimals=5)


@query(with_("lng", "cent", "d2", "qin", more=_PAIRS.format(f="-ln(greatest(sum(x.p * y.p), 1e-300))")) + "SELECT a, b, round(dist, 5) + 0.0::DOUBLE AS dist FROM pairs")
def coloc_pairs(spark, d):
    return clusters.pair_metrics(qin(spark, d), "vec_id", "coloc", None, decimals=5)


@query(with_("lng", "cent", "d2", "qin", more=_JEFF) + ", r AS (SELECT least(label_a, label_b) AS a, greatest(label_a, label_b) AS b, dist, row_number() OVER (PARTITION BY least(label_a, label_b), greatest(label_a, label_b) ORDER BY dist) AS i, count(*) OVER (PARTITION BY least(label_a, label_b), greatest(label_a, label_b)) AS n FROM pairs) SELECT a, b, max(n) AS n, round(avg(dist), 5) + 0.0::DOUBLE AS dist FROM r WHERE i <= greatest(1, floor(n * 0.25)) GROUP BY a, b")
def davgquant(spark, d):
    q = blocks.truncated_means(qin(spark, d), "jeffreys", 0.25, id_col="vec_id", label="label")
    return q.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n", (F.round("dist", 5) + vec.dbl(0)).alias("dist"))


_MEANS = "pm AS (SELECT label, k, avg(p) AS p FROM qin GROUP BY ALL), tot AS (SELECT k, avg(p) AS u FROM qin GROUP BY ALL)"


def _mean_q(spark, d):
    """(label, q, u): mean assignment of each label, and overall."""
    long = qin(spark, d).select("label", F.posexplode("q").alias("k", "p"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c])
    per = long.groupBy("label", "k").agg(F.avg("p").alias("p")).groupBy("label").agg(ordered("p").alias("q"))
    all_ = long.groupBy("k").agg(F.avg("p").alias("p")).agg(ordered("p").alias("u"))
    return per.crossJoin(F.broadcast(all_))  # one row of K numbers


@query(with_("lng", "cent", "d2", "qin", more=_MEANS) + "SELECT label, round(sum(CASE WHEN p <= 0 THEN 0 ELSE p * (log2(p) - log2(u)) END), 6) + 0.0::DOUBLE AS kl FROM pm JOIN tot USING (k) GROUP BY label")
def kl_raw(spark, d):
    return _mean_q(spark, d).select("label", r6(vec.kl_raw("q", "u")).alias("kl"))


@query(with_("lng", "cent", "d2", "qin", more=_MEANS) + ", c AS (SELECT label, k, greatest(p, 1e-300) / sum(greatest(p, 1e-300)) OVER (PARTITION BY label) AS p, greatest(u, 1e-300) / sum(greatest(u, 1e-300)) OVER (PARTITION BY label) AS u FROM pm JOIN tot USING (k)) SELECT label, round(sum(p * (log2(p) - log2(u))), 6) + 0.0::DOUBLE AS kl FROM c GROUP BY label")
def kl_clamped(spark, d):
    return _mean_q(spark, d).select("label", r6(vec.kl_clamped("q", "u")).alias("kl"))


@query("SELECT vec_id, CAST(unnest(range(0, 10)) AS INT) AS k, CAST(label = unnest(range(0, 10)) AS INT) AS hit FROM embeddings")
def one_of_c(spark, d):
    e = emb(spark, d)
    low, high = 0, 9
    return e.select("vec_id", F.posexplode(vec.one_of_c("label", low, high)).alias("k", "hit"))

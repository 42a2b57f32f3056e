"""Projection, joins, coding, cleaning, importance tables and expression sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mixtura.functions.vec import r6
from mixtura.operators import ensemble, expression, importance, prep, stats
from mixtura.operators.ranking import running
from mixtura.plans.fixtures import emb_long, emb_missing, metrics, table, with_
from mixtura.plans.registry import Registry
from mixtura.sources import io

REGISTRY = query = Registry()


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, round(o_totalprice, 6) AS x0, o_orderstatus AS y FROM orders")
def extract_keep(spark, d):
    e = io.extract(table(spark, d, "orders"), "o_orderkey", ["o_totalprice"], y="o_orderstatus")
    return e.select(F.col("id").cast("long").alias("id"), r6(F.get("x", F.lit(0))).alias("x0"), "y")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, 1 AS width, round(c_acctbal, 6) AS x0 FROM customer")
def extract_drop(spark, d):
    e = io.extract(table(spark, d, "customer"), "c_custkey", ["c_nationkey"], drop=True)
    return e.select(F.col("id").cast("long").alias("id"), F.size("x").alias("width"), r6(F.get("x", F.lit(0))).alias("x0"))


@query("SELECT p_partkey, coalesce(n_name, p_brand) AS short FROM part LEFT JOIN (SELECT n_name, 'Brand#' || (n_nationkey + 10) AS feature FROM nation) ON feature = p_brand")
def abbr_left_join(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("feature"), F.col("n_name").alias("short"))
    return importance.renamed(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("feature")), names).select("p_partkey", "short")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def dedup_left_join(spark, d):
    """The right side once for each key: its first row by key, found by an aggregate instead of a sort."""
    once = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return table(spark, d, "customer").select("c_custkey").join(once, "c_custkey", "left")


@query("SELECT o_orderpriority, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY 1")
def value_counts_pct(spark, d):
    return prep.value_counts_pct(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def crosstab(spark, d):
    return stats.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("WITH b AS (SELECT c_mktsegment AS label, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS total FROM customer GROUP BY 1) SELECT label, CAST(least(floor((c_acctbal - low) / ((high - low) / 30)), 29) AS INT) AS bin, count(*) AS n, round(count(*) / (total * ((high - low) / 30)), 9) AS density FROM customer JOIN b ON label = c_mktsegment GROUP BY label, bin, total, low, high")
def hist_density(spark, d):
    h = prep.histogram(table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), "c_acctbal"), "label", "c_acctbal")
    return h.select("label", "bin", "n", F.round("density", 9).alias("density"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INT) AS code FROM customer")
def dense_relabel(spark, d):
    return prep.dense_codes(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "code").select("c_custkey", "code")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events")
def label_encode(spark, d):
    return prep.dense_codes(table(spark, d, "events").select("event_id", "event_type"), "event_type", "code").select("event_id", "code")


@query("WITH s AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), b AS (SELECT max(CASE WHEN i = floor(n * 0.2::DOUBLE + 0.5) THEN v END) AS b0, max(CASE WHEN i = floor(n * 0.5::DOUBLE + 0.5) THEN v END) AS b1 FROM s) SELECT p_partkey, CAST(v <= b0 AS INT) + CAST(v <= b1 AS INT) AS label FROM s, b")
def relabel_prior(spark, d):
    return prep.relabel_by_prior(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", [0.2, 0.3, 0.5]).select("p_partkey", "label")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0::DOUBLE AS v FROM customer")
def standardise(spark, d):
    return prep.standardise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r6("c_acctbal").alias("v"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS s0, CAST(o_orderstatus = 'O' AS DOUBLE) AS s1, CAST(o_orderstatus = 'P' AS DOUBLE) AS s2 FROM orders")
def one_hot(spark, d):
    o = prep.recode(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), "s", ["F", "O", "P"])
    return o.select("o_orderkey", *(F.col(f"s_{i}").alias(f"s{i}") for i in range(3)))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS code FROM lineitem")
def recode_binary(spark, d):
    return prep.recode(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("code")), "code", ["F", "O"])


_MISS = "miss AS (SELECT vec_id, feature, CASE WHEN vec_id % 7 = 0 AND feature = vec_id % 64 THEN NULL ELSE value END AS value FROM lng)"


def _wide_missing(spark, d):
    """The vectors with missing cells as columns, and their names."""
    m = emb_missing(spark, d)
    names = [str(i) for i in range(m.select(F.size("x")).first()[0])]
    return m.select("vec_id", *(F.get("x", F.lit(int(i))).alias(i) for i in names)), names


@query(with_("lng", more=_MISS) + "SELECT CAST(feature AS INT) AS feature, round(avg(CAST(value IS NOT NULL AS DOUBLE)), 6) AS available, round(avg(CAST(value IS NOT NULL AS DOUBLE)), 6) >= 0.99 AS kept FROM miss GROUP BY feature")
def condense(spark, d):
    wide, names = _wide_missing(spark, d)
    kept = set(prep.condense(wide, names, 0.99).columns)
    return prep.availability(wide, names).select(F.col("feature").cast("int").alias("feature"), r6("available").alias("available"), F.col("feature").isin(kept).alias("kept"))


@query(with_("lng", more=_MISS) + "SELECT vec_id FROM miss GROUP BY vec_id HAVING count(value) = count(*)")
def drop_missing_rows(spark, d):
    return prep.drop_missing_rows(*_wide_missing(spark, d)).select("vec_id")


@query(with_("lng", more=_MISS) + """, comp AS (SELECT vec_id FROM miss GROUP BY vec_id HAVING count(value) = count(*)), hole AS (SELECT vec_id, feature FROM miss WHERE value IS NULL),
dist AS (SELECT h.vec_id AS q, m2.vec_id AS n, sqrt(sum((m1.value - m2.value) * (m1.value - m2.value))) AS d FROM hole h JOIN miss m1 ON m1.vec_id = h.vec_id AND m1.value IS NOT NULL JOIN miss m2 ON m2.feature = m1.feature JOIN comp c ON c.vec_id = m2.vec_id GROUP BY ALL),
near AS (SELECT q, n, d FROM dist QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, n) <= 5), w AS (SELECT q, n, 1 / (d + avg(d) OVER (PARTITION BY q) / 1e10) AS w FROM near)
SELECT w.q AS vec_id, round(sum(w.w * m.value) / sum(w.w), 5) + 0.0::DOUBLE AS v FROM w JOIN hole h ON h.vec_id = w.q JOIN miss m ON m.vec_id = w.n AND m.feature = h.feature GROUP BY w.q""")
def knn_impute_k(spark, d):
    filled = prep.knn_impute(emb_missing(spark, d).select("vec_id", "x"), "vec_id", "x", k=5)
    return filled.filter(F.col("vec_id") % 7 == 0).select("vec_id", (F.round(F.get("x", (F.col("vec_id") % 64).cast("int")), 5) + F.lit(0.0)).alias("v"))


def _impute_round(t: int) -> str:
    """One round over the state s{t} (vec_id, feature, value) of the rows with a hole."""
    return f"""dist{t} AS (SELECT s.vec_id AS q, m.vec_id AS n, sqrt(sum((s.value - m.value) * (s.value - m.value))) AS d FROM s{t} s JOIN miss m ON m.feature = s.feature JOIN comp c ON c.vec_id = m.vec_id GROUP BY ALL),
near{t} AS (SELECT q, n, d FROM dist{t} QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, n) <= 5), w{t} AS (SELECT q, n, 1 / (d + avg(d) OVER (PARTITION BY q) / 1e10) AS w FROM near{t}),
v{t} AS (SELECT w.q, sum(w.w * m.value) / sum(w.w) AS v FROM w{t} w JOIN hole h ON h.vec_id = w.q JOIN miss m ON m.vec_id = w.n AND m.feature = h.feature GROUP BY w.q),
s{t + 1} AS (SELECT s.vec_id, s.feature, CASE WHEN h.vec_id IS NULL THEN s.value ELSE v END AS value FROM s{t} s LEFT JOIN hole h ON h.vec_id = s.vec_id AND h.feature = s.feature JOIN v{t} ON q = s.vec_id)"""


@query(with_("lng", more=_MISS) + f""", comp AS (SELECT vec_id FROM miss GROUP BY vec_id HAVING count(value) = count(*)), hole AS (SELECT vec_id, feature FROM miss WHERE value IS NULL), mean AS (SELECT feature, avg(value) AS m FROM miss JOIN comp USING (vec_id) GROUP BY feature),
s0 AS (SELECT miss.vec_id, feature, coalesce(value, m) AS value FROM miss JOIN (SELECT DISTINCT vec_id FROM hole) h ON h.vec_id = miss.vec_id JOIN mean USING (feature)), {_impute_round(0)}, {_impute_round(1)}
SELECT h.vec_id, round(value, 5) + 0.0::DOUBLE AS v FROM hole h JOIN s2 ON s2.vec_id = h.vec_id AND s2.feature = h.feature""")
def knn_impute_rounds(spark, d):
    """Two rounds, in which filled cells take part in the distances."""
    filled = prep.knn_impute(emb_missing(spark, d).select("vec_id", "x"), "vec_id", "x", k=5, max_iter=2)
    return filled.filter(F.col("vec_id") % 7 == 0).select("vec_id", (F.round(F.get("x", (F.col("vec_id") % 64).cast("int")), 5) + F.lit(0.0)).alias("v"))


@query(with_("lng", more=_MISS) + "SELECT vec_id, count(*) - count(value) AS missing FROM miss GROUP BY vec_id")
def missing_view(spark, d):
    wide, names = _wide_missing(spark, d)
    return prep.missing_view(wide, "vec_id", names).groupBy("vec_id").agg(F.count_if("is_missing").alias("missing"))


@query("SELECT l_shipdate, n, CAST(sum(n) OVER (ORDER BY l_shipdate) AS BIGINT) AS cumulative, round(CAST(sum(n) OVER (ORDER BY l_shipdate) AS DOUBLE) / sum(n) OVER (), 6) AS probability FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)")
def cumulative_probability(spark, d):
    r = running(table(spark, d, "lineitem").select("l_shipdate", F.unix_timestamp("l_shipdate").alias("t")), [], "t", {"n": F.lit(1)})
    total = F.col("n_before") + F.col("n")
    return r.select(F.timestamp_seconds("t").alias("l_shipdate"), F.col("n").cast("long").alias("n"), total.cast("long").alias("cumulative"), r6(total / F.col("n_all")).alias("probability"))


@query("SELECT coalesce(bool_and(nxt IS NULL OR nxt >= o_totalprice), true) AS ordered FROM (SELECT o_totalprice, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS nxt FROM orders)")
def is_ordered(spark, d):
    return prep.is_ordered(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT s.o_orderstatus, p.o_orderpriority, dense_rank() OVER (ORDER BY s.o_orderstatus, p.o_orderpriority) - 1 AS paramid FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p")
def grid_expand(spark, d):
    """The grid over the levels of two columns, numbered with the last running fastest."""
    levels = lambda c: sorted(r[0] for r in table(spark, d, "orders").select(c).distinct().collect())  # of a category
    grid = ensemble.expand(spark, {"1": levels("o_orderstatus"), "2": levels("o_orderpriority")})
    return grid.select(F.col("1").alias("o_orderstatus"), F.col("2").alias("o_orderpriority"), F.col("paramid").cast("long").alias("paramid"))


@query("SELECT o_custkey AS paramid, o_orderkey AS restart, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_param(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("paramid"), F.col("o_orderkey").alias("restart"), F.col("o_totalprice").alias("score"))
    return ensemble.best_per_param(o)


_WEIGHTS = "sc AS (SELECT l_linenumber AS paramid, avg(l_extendedprice) / 1000 AS score FROM lineitem GROUP BY 1), w AS (SELECT paramid, score, exp(score - max(score) OVER ()) AS e FROM sc), ws AS (SELECT paramid, score, e / sum(e) OVER () AS weight FROM w)"


def _weights(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("paramid")).agg((F.avg("l_extendedprice") / 1000).alias("score"))
    return ensemble.weights(s)


@query(f"WITH {_WEIGHTS} SELECT paramid, round(score, 6) AS score, round(weight, 6) AS weight FROM ws")
def ensemble_weights(spark, d):
    return _weights(spark, d).select("paramid", r6("score").alias("score"), r6("weight").alias("weight"))


@query(f"WITH {_WEIGHTS}, l AS (SELECT l_orderkey, l_linenumber AS paramid, -avg(l_quantity) AS ld FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, round(ln(sum(weight * exp(ld))), 6) + 0.0::DOUBLE AS log_density FROM l JOIN ws USING (paramid) GROUP BY 1")
def ensemble_logdens(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("paramid")).agg((-F.avg("l_quantity")).alias("log_density"))  # noqa: E741
    return ensemble.log_density(l, _weights(spark, d), "l_orderkey").select("l_orderkey", r6("log_density").alias("log_density"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS meanscore, round(sum(l_discount), 4) AS sumscore FROM lineitem GROUP BY ALL")
def cv_summary(spark, d):
    s = ensemble.cv_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount")
    return s.select("l_returnflag", "l_linestatus", r6("meanscore").alias("meanscore"), F.round("sumscore", 4).alias("sumscore"))


_MAPPED = "mp AS (SELECT feature, metric, CASE WHEN metric = 'bayes_logodds' THEN v - min(v) OVER (PARTITION BY metric) WHEN metric = 'SVC_McNemar' THEN -ln(greatest(v, 1e-101)) ELSE v END AS v FROM metrics)"


def _mapped(spark, d):
    return metrics(spark, d).withColumn("v", importance.mapped_value(F.col("metric"), F.col("v")))


@query(with_("lng", "metrics", more=_MAPPED) + "SELECT feature, round(avg(s), 6) + 0.0::DOUBLE AS share FROM (SELECT feature, v / sum(v) OVER (PARTITION BY metric) AS s FROM mp) GROUP BY 1")
def shared_rank(spark, d):
    return importance.shared_rank(_mapped(spark, d)).select("feature", r6("share").alias("share"))


@query(with_("lng", "metrics", more=_MAPPED) + "SELECT feature, " + ", ".join(f"count(*) FILTER (pos = {i}) AS pos{i}" for i in range(1, 6)) + " FROM (SELECT feature, row_number() OVER (PARTITION BY metric ORDER BY v DESC, feature) AS pos FROM mp) WHERE pos <= 5 GROUP BY 1")
def rank_positions(spark, d):
    return importance.rank_positions(_mapped(spark, d))


_POSITIONS = with_("lng", "metrics", more=_MAPPED) + ", r AS (SELECT feature, row_number() OVER (PARTITION BY metric ORDER BY v DESC, feature) AS pos FROM mp)"


@query(_POSITIONS + " SELECT CAST(pos AS INT) AS position, feature, count(*) AS n FROM r WHERE pos <= 5 GROUP BY ALL")
def rank_pies(spark, d):
    return importance.rank_pies(importance.rank_positions(_mapped(spark, d)))


@query(with_("lng", "metrics", more=_MAPPED) + "SELECT feature, round(share, 6) + 0.0::DOUBLE AS share FROM (SELECT feature, avg(s) AS share FROM (SELECT feature, v / sum(v) OVER (PARTITION BY metric) AS s FROM mp) GROUP BY 1) ORDER BY share DESC, feature LIMIT 20")
def top_features(spark, d):
    return importance.top(importance.shared_rank(_mapped(spark, d)), 20).select("feature", r6("share").alias("share"))


@query(with_("lng", "metrics") + "SELECT feature, round(l - min(l) OVER (), 6) + 0.0::DOUBLE AS v FROM (SELECT feature, ln(v) AS l FROM metrics WHERE metric = 'gini')")
def tree_importance(spark, d):
    return importance.tree_importance(metrics(spark, d).filter("metric = 'gini'")).select("feature", r6("v").alias("v"))


_HALF = "SELECT 'f' || feature AS feature, round(avg(value), 6) + 0.0::DOUBLE AS effect, avg(value) > 0 AS sig FROM lng WHERE"


@query(with_("lng") + f"SELECT feature, a.effect AS low, coalesce(a.sig, false) AS low_sig, b.effect AS high, coalesce(b.sig, false) AS high_sig FROM ({_HALF} grp < 5 AND feature < 40 GROUP BY feature) a FULL JOIN ({_HALF} grp >= 5 AND feature >= 20 GROUP BY feature) b USING (feature)")
def outer_effects(spark, d):
    """Two models that have tested different features, side by side."""
    name = F.concat(F.lit("f"), F.col("feature").cast("string")).alias("feature")
    part = lambda rows: emb_long(spark, d).filter(rows).groupBy("feature").agg(r6(F.avg("value")).alias("effect"), (F.avg("value") > 0).alias("sig")).select(name, "effect", "sig")
    return importance.outer_effects({"low": part("grp < 5 AND feature < 40"), "high": part("grp >= 5 AND feature >= 20")})


@query("SELECT o_orderkey, contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'low') AS found FROM orders")
def mentions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", io.mentions("o_orderpriority", ["URGENT", "low"]).alias("found"))


@query("SELECT s_suppkey AS key, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def renamed_either(spark, d):
    """Two tables that name the same things otherwise, as one."""
    names = {"key": ["c_custkey", "s_suppkey"], "balance": ["c_acctbal", "s_acctbal"]}
    parts = [io.renamed_either(table(spark, d, t), names).select("key", "balance") for t in ("supplier", "customer")]
    return parts[0].unionByName(parts[1])


@query(with_("lng", "metrics", more=_MAPPED) + ", r AS (SELECT feature, metric, row_number() OVER (PARTITION BY metric ORDER BY v DESC, feature) AS pos FROM mp) SELECT feature, metric, pos FROM r WHERE pos <= 7 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY metric, pos) = 1")
def top_k_union(spark, d):
    return importance.top_union(_mapped(spark, d), 7)


@query(with_("lng", "metrics", more=_MAPPED) + "SELECT feature, round(max(v) FILTER (metric = 'gini'), 6) AS gini, round(max(v) FILTER (metric = 'entropy'), 6) AS entropy, round(avg(v), 6) AS mean FROM mp GROUP BY 1 ORDER BY avg(v) DESC, feature LIMIT 64")
def effect_pivot_heatmap(spark, d):
    h = importance.heat_map(_mapped(spark, d), ["gini", "entropy"], 64)
    return h.select("feature", *(r6(c).alias(c) for c in ("gini", "entropy", "mean")))


@query(with_("lng") + "SELECT CAST(feature AS INT) AS feature, round(coalesce(stddev_samp(m), 0), 6) AS spread FROM (SELECT feature, grp, avg(value) AS m FROM lng GROUP BY ALL) GROUP BY 1 ORDER BY coalesce(stddev_samp(m), 0) DESC, 1 LIMIT 20")
def group_spread_topk(spark, d):
    return importance.group_spread(emb_long(spark, d), 20).select("feature", r6("spread").alias("spread"))


def _eset(spark, d):
    e = emb_long(spark, d).select(F.col("feature").alias("feature_id"), F.col("vec_id").alias("sample_id"), F.col("value").alias("v"))
    return expression.ExpressionSet(e, e.select("feature_id").distinct(), table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")).checked()


@query(with_("lng") + "SELECT CAST(feature AS INT) AS feature_id, count(*) AS n, round(sum(value), 5) + 0.0::DOUBLE AS total FROM lng WHERE feature < 8 AND grp < 3 GROUP BY 1")
def eset_subset(spark, d):
    s = _eset(spark, d)
    part = s.subset(s.fdata.filter("feature_id < 8"), s.pdata.filter("label < 3").select("sample_id"))
    return part.exprs.groupBy("feature_id").agg(F.count("*").alias("n"), (F.round(F.sum("v"), 5) + F.lit(0.0)).alias("total"))


@query("SELECT vec_id AS sample_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0::DOUBLE AS f{i}" for i in range(64)) + ", label FROM embeddings")
def eset_to_labeled(spark, d):
    wide = _eset(spark, d).labelled(list(range(64)), ["label"])
    return wide.select("sample_id", *(r6(f"f{i}").alias(f"f{i}") for i in range(64)), "label")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both_1, count(*) FILTER (quality = 1 AND toxic = 0) AS first_only, count(*) FILTER (quality = 0 AND toxic = 1) AS second_only, count(*) FILTER (quality = 0 AND toxic = 0) AS both_0 FROM labels")
def paired_counts(spark, d):
    is_ = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return table(spark, d, "labels").agg(is_(1, 1).alias("both_1"), is_(1, 0).alias("first_only"), is_(0, 1).alias("second_only"), is_(0, 0).alias("both_0"))

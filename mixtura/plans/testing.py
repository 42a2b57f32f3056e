"""Group tests and evaluation of class scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtura.functions.vec import r6, stars
from mixtura.operators import evaluation, prep, stats
from mixtura.plans.fixtures import class_scores, emb_long, table, with_
from mixtura.plans.registry import Registry

REGISTRY = query = Registry()

#: H, and with it the effect, of features by groups of three rows or more.
_KW = """big AS (SELECT feature, grp, value FROM {src} QUALIFY count(*) OVER (PARTITION BY feature, grp) >= 3),
ranked AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / CAST(2 AS DOUBLE) AS r,
  count(*) OVER (PARTITION BY feature, value) AS t FROM big),
g AS (SELECT feature, grp, count(*) AS n, sum(r) AS s FROM ranked GROUP BY ALL),
tie AS (SELECT feature, sum(CAST(t AS DOUBLE) * t - 1) AS tt FROM ranked GROUP BY ALL),
tot AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, sum(s * s / n) AS q FROM g GROUP BY ALL HAVING count(*) >= 2),
kw AS (SELECT feature, n, groups, (CAST(12 AS DOUBLE) / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - tt / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM tot JOIN tie USING (feature))"""
_ANOVA = """big AS (SELECT feature, grp, value FROM {src} QUALIFY count(*) OVER (PARTITION BY feature, grp) >= 3),
g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM big GROUP BY ALL),
mu AS (SELECT feature, avg(value) AS mu FROM big GROUP BY ALL),
an AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, (sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g JOIN mu USING (feature) GROUP BY ALL HAVING count(*) >= 2)"""
_EVENTS = "src AS (SELECT 'value' AS feature, event_type AS grp, value FROM events)"


def _shown(df, *columns):
    return df.select("feature", "n", "groups", *(r6(c).alias(c) for c in columns))


@query(with_("lng", more=_KW.format(src="lng")) + "SELECT CAST(feature AS INT) AS feature, n, groups, round(h, 6) + 0.0::DOUBLE AS h, round(greatest(0, h / (n - 1)), 6) + 0.0::DOUBLE AS effect FROM kw")
def effects_kw(spark, d):
    return _shown(stats.kruskal(emb_long(spark, d)), "h", "effect")


@query(f"WITH {_EVENTS}, {_KW.format(src='src')} SELECT feature, n, groups, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value FROM kw")
def effects_kw_events(spark, d):
    long = table(spark, d, "events").select(F.lit("value").alias("feature"), F.col("event_type").alias("grp"), "value")
    out = stats.kruskal(long).withColumn("p_value", stats.chi2_sf("h", (F.col("groups") - 1).cast("double")))
    return _shown(out, "h", "p_value")


@query(with_("lng", more=_ANOVA.format(src="lng")) + "SELECT CAST(feature AS INT) AS feature, n, groups, round(f, 6) AS f, round(greatest(0, f / (n - 1)), 6) AS effect FROM an")
def effects_anova(spark, d):
    return _shown(stats.anova(emb_long(spark, d)), "f", "effect")


@query("""WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY ALL),
rr AS (SELECT r, sum(n) AS rn FROM o GROUP BY ALL), cc AS (SELECT c, sum(n) AS cn FROM o GROUP BY ALL), t AS (SELECT sum(n) AS n, count(DISTINCT r) AS r, count(DISTINCT c) AS c FROM o),
x AS (SELECT sum((coalesce(o.n, 0) - CAST(rn AS DOUBLE) * cn / t.n) * (coalesce(o.n, 0) - CAST(rn AS DOUBLE) * cn / t.n) / (CAST(rn AS DOUBLE) * cn / t.n)) AS chi2 FROM rr CROSS JOIN cc CROSS JOIN t LEFT JOIN o ON o.r = rr.r AND o.c = cc.c)
SELECT round(chi2, 6) AS chi2, CAST((t.r - 1) * (t.c - 1) AS BIGINT) AS dof, CAST(t.n AS BIGINT) AS n, round(sqrt(chi2 / (t.n * (least(t.r, t.c) - 1))), 6) AS cramers_v, round(exp(-chi2 / 2), 6) AS p_value FROM x CROSS JOIN t""")
def effects_chi2_cramer(spark, d):
    out = stats.chi2(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(r6("chi2").alias("chi2"), "dof", "n", r6("cramers_v").alias("cramers_v"), r6(stats.chi2_sf("chi2", F.col("dof").cast("double"))).alias("p_value"))


#: p-values with four degrees of freedom, which have a closed form: one test for each user's hour of day group.
_FIVE = "src AS (SELECT 'u' || (user_id % 97) AS feature, event_type AS grp, value FROM events)"


def _tests(spark, d):
    long = table(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 97).cast("string")).alias("feature"), F.col("event_type").alias("grp"), "value")
    return stats.kruskal(long).filter("groups = 5").withColumn("p_value", stats.chi2_sf_even(F.col("h"), F.lit(4)))


_BH = f"WITH {_FIVE}, {_KW.format(src='src')}, p AS (SELECT feature, exp(-h / 2) * (1 + h / 2) AS p_value FROM kw WHERE groups = 5), adj AS (SELECT feature, p_value, least(1, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature)) AS p_adj FROM p) "


@query(_BH + "SELECT feature, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj, round(min(p_adj) OVER (ORDER BY p_value, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_adj_bh FROM adj")
def bh_adjust(spark, d):
    return stats.bh(_tests(spark, d)).select("feature", *(r6(c).alias(c) for c in ("p_value", "p_adj", "p_adj_bh")))


@query(_BH + "SELECT feature, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' WHEN p_value < 0.1 THEN '.' ELSE 'not sig.' END AS stars FROM p")
def pval_stars(spark, d):
    return _tests(spark, d).select("feature", stars("p_value").alias("stars"))


_CUST = "src0 AS (SELECT 'acctbal' AS feature, c_mktsegment AS grp, c_acctbal AS value FROM customer)"


def _customer(spark, d):
    return table(spark, d, "customer").select(F.lit("acctbal").alias("feature"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("value"))


@query(f"WITH {_CUST}, src AS (SELECT feature, grp, abs(value - median(value) OVER (PARTITION BY feature, grp)) AS value FROM src0), {_ANOVA.format(src='src')} SELECT feature, n, groups, round(f, 6) AS f FROM an")
def brown_forsythe(spark, d):
    return _shown(stats.brown_forsythe(_customer(spark, d)), "f")


@query(f"WITH {_CUST} SELECT grp, round(sum(value - m) , 6) + 0.0::DOUBLE AS total, round(sqrt(avg((value - m) * (value - m))), 6) AS deviation FROM (SELECT grp, value, avg(value) OVER (PARTITION BY grp) AS m FROM src0) GROUP BY ALL")
def group_residuals(spark, d):
    r = stats.residuals(_customer(spark, d))
    return r.groupBy("grp").agg(F.abs(r6(F.sum("residual"))).alias("total"), r6(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("deviation"))


@query()
def shapiro_residuals(spark, d):
    return stats.shapiro(stats.residuals(emb_long(spark, d).withColumn("feature", F.col("feature").cast("string"))), value="residual")


_ALL = """src AS (SELECT 'c_nationkey' AS feature, c_mktsegment AS grp, CAST(c_nationkey AS DOUBLE) AS value FROM customer UNION ALL SELECT 'c_acctbal', c_mktsegment, c_acctbal FROM customer),
cell AS (SELECT c_mktsegment AS grp, sum(CAST(c_acctbal > 5000 AS INT)) AS k, count(*) AS gn FROM customer GROUP BY 1),
two AS (SELECT sum((k - gn * h / t) * (k - gn * h / t) * (1 / (gn * h / t) + 1 / (gn - gn * h / t))) AS x, max(t) AS t FROM cell, (SELECT CAST(sum(k) AS DOUBLE) AS h, CAST(sum(gn) AS DOUBLE) AS t FROM cell))"""


@query(f"WITH {_ALL}, {_KW.format(src='src')}, " + """p AS (SELECT feature, greatest(0, h / (n - 1)) AS effect, exp(-h / 2) * (1 + h / 2) AS p_value, 'kruskal' AS test FROM kw UNION ALL SELECT 'rich', sqrt(x / t), exp(-x / 2) * (1 + x / 2), 'chi2' FROM two),
adj AS (SELECT *, least(1, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature)) AS p_adj FROM p)
SELECT feature, round(effect, 6) AS effect, round(p_value, 6) AS p_value, test, round(p_adj, 6) AS p_adj, round(min(p_adj) OVER (ORDER BY p_value, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_adj_bh, p_adj < 0.05 AS sig FROM adj""")
def effects_all(spark, d):
    """The full effect table of the customers' numeric columns by segment."""
    c = table(spark, d, "customer").withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    e = stats.effects(c, "c_mktsegment", {"c_custkey"})
    return e.select("feature", r6("effect").alias("effect"), r6("p_value").alias("p_value"), "test", r6("p_adj").alias("p_adj"), r6("p_adj_bh").alias("p_adj_bh"), "sig")


@query()
def assumption_summary(spark, d):
    long = emb_long(spark, d).withColumn("feature", F.col("feature").cast("string"))
    return stats.assumptions(long)


# -- evaluation of scores

@query(with_("scores") + "SELECT DISTINCT round(CAST((SELECT count(*) FROM scores b WHERE b.y = 0 AND b.p >= a.p) AS DOUBLE) / (SELECT count(*) FROM scores WHERE y = 0), 6) AS fpr, round(CAST((SELECT count(*) FROM scores b WHERE b.y = 1 AND b.p >= a.p) AS DOUBLE) / (SELECT count(*) FROM scores WHERE y = 1), 6) AS tpr FROM scores a")
def roc_points(spark, d):
    return evaluation.roc_points(class_scores(spark, d)).select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr")).distinct()


@query(with_("scores") + "SELECT round(avg(CAST(a.p > b.p AS INT)), 6) AS auc FROM scores a, scores b WHERE a.y = 1 AND b.y = 0")
def auc_strict(spark, d):
    return evaluation.auc_strict(class_scores(spark, d)).select(r6("auc").alias("auc"))


@query(with_("scores", more="pr AS (SELECT avg(y) AS m FROM scores)") + "SELECT round(avg((CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE -1 END) * (p * (log2(p) - log2(m)) + (1 - p) * (log2(1 - p) - log2(1 - m)))), 6) AS shannon FROM scores, pr")
def shannon_capacity(spark, d):
    return evaluation.information(class_scores(spark, d)).select(r6("shannon").alias("shannon"))


_MIDP = "least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(CAST(2 AS DOUBLE)))) - max(CASE WHEN k = x THEN exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(CAST(2 AS DOUBLE))) END))"


@query(with_("scores", more="pr AS (SELECT avg(y) AS m FROM scores), g AS (SELECT y, CAST(p > 0.5 AS INT) = y AS own, (CASE WHEN m < 0.5 THEN 0 ELSE 1 END) = y AS def FROM scores, pr), c AS (SELECT avg(CAST(own AS DOUBLE)) * 100 AS accuracy, avg(CAST(def AS DOUBLE)) * 100 AS majority_accuracy, count(*) FILTER (own AND NOT def) AS b, count(*) FILTER (def AND NOT own) AS c FROM g), w AS (SELECT *, CAST(b + c AS DOUBLE) AS n, CAST(least(b, c) AS DOUBLE) AS x FROM c)")
       + f"SELECT round(accuracy, 6) AS accuracy, round(majority_accuracy, 6) AS majority_accuracy, b, c, round(CASE WHEN n = 0 THEN 1 ELSE {_MIDP} END, 6) AS p_value FROM w, (SELECT CAST(unnest(range(0, CAST((SELECT x FROM w) AS BIGINT) + 1)) AS DOUBLE) AS k) GROUP BY accuracy, majority_accuracy, b, c, n")
def accuracy_majority(spark, d):
    return evaluation.accuracy(class_scores(spark, d)).select(r6("accuracy").alias("accuracy"), r6("majority_accuracy").alias("majority_accuracy"), "b", "c", r6("p_value").alias("p_value"))


@query(f"WITH p AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels), w AS (SELECT *, CAST(b + c AS DOUBLE) AS n, CAST(least(b, c) AS DOUBLE) AS x FROM p) SELECT b, c, round(CASE WHEN n = 0 THEN 1 ELSE {_MIDP} END, 6) AS p_value FROM w, (SELECT CAST(unnest(range(0, CAST((SELECT x FROM w) AS BIGINT) + 1)) AS DOUBLE) AS k) GROUP BY b, c, n")
def mcnemar_midp(spark, d):
    one = table(spark, d, "labels").agg(F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")).alias("b"), F.sum(((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("long")).alias("c"))
    return one.select("b", "c", r6(evaluation.midp(F.col("b").cast("double"), F.col("c").cast("double"))).alias("p_value"))


@query(with_("scores") + "SELECT round(sum(ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-101))), 6) AS loglik FROM scores")
def oof_loglik(spark, d):
    return evaluation.loglik(class_scores(spark, d)).select(r6("loglik").alias("loglik"))


@query("SELECT quality AS label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE), 6) AS prior FROM labels GROUP BY quality ORDER BY n DESC, label LIMIT 1")
def majority_classifier(spark, d):
    return evaluation.majority(table(spark, d, "labels"), "quality").select("label", "n", r6("prior").alias("prior"))


@query("SELECT min(n) AS folds FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")
def fold_max(spark, d):
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n")).agg(F.min("n").alias("folds"))


@query("WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(fold AS INT) AS fold, quality, CAST((n - fold + 4) // 5 AS BIGINT) AS n FROM n, (SELECT unnest(range(0, 5)) AS fold) WHERE n > fold")
def stratified_folds(spark, d):
    return evaluation.folds(table(spark, d, "labels"), "doc_id", "quality", 5).groupBy("fold", "quality").agg(F.count("*").alias("n"))


_SCORES = with_("scores", more="pr AS (SELECT avg(y) AS m FROM scores), g AS (SELECT y, CAST(p > 0.5 AS INT) = y AS own, (CASE WHEN m < 0.5 THEN 0 ELSE 1 END) = y AS def FROM scores, pr), c AS (SELECT avg(CAST(own AS DOUBLE)) * 100 AS acc, count(*) FILTER (own AND NOT def) AS b, count(*) FILTER (def AND NOT own) AS c FROM g), w AS (SELECT *, CAST(b + c AS DOUBLE) AS n, CAST(least(b, c) AS DOUBLE) AS x FROM c)") + f"""
, v AS (SELECT acc, CASE WHEN n = 0 THEN 1 ELSE {_MIDP} END AS pval FROM w, (SELECT CAST(unnest(range(0, CAST((SELECT x FROM w) AS BIGINT) + 1)) AS DOUBLE) AS k) GROUP BY acc, n)
, a AS (SELECT avg(CAST(a.p > b.p AS INT)) AS auc FROM scores a, scores b WHERE a.y = 1 AND b.y = 0)
, s AS (SELECT avg((CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE -1 END) * (p * (log2(p) - log2(m)) + (1 - p) * (log2(1 - p) - log2(1 - m)))) AS shannon FROM scores, pr)
SELECT 'length' AS mthd, round(auc, 6) AS auc, round(acc, 6) AS acc, round(pval, 6) AS pval, round(shannon, 6) AS shannon,
  printf('length (AUC %.3f, acc %.2f%% %s)', auc, acc, CASE WHEN pval < 0.001 THEN '***' WHEN pval < 0.01 THEN '**' WHEN pval < 0.05 THEN '*' WHEN pval < 0.1 THEN '.' ELSE 'not sig.' END) AS legend FROM v, a, s"""


@query(_SCORES)
def metric_store(spark, d):
    s = evaluation.evaluate(class_scores(spark, d), "length")
    return s.join(evaluation.store_legend(s), "mthd").select("mthd", *(r6(c).alias(c) for c in ("auc", "acc", "pval", "shannon")), "legend")


@query(with_("lng") + "SELECT CAST(feature AS INT) AS feature, count(*) AS n, round(avg(value), 6) + 0.0::DOUBLE AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) + 0.0::DOUBLE AS min, round(quantile_cont(value, 0.25), 6) + 0.0::DOUBLE AS q25, round(quantile_cont(value, 0.5), 6) + 0.0::DOUBLE AS q50, round(quantile_cont(value, 0.75), 6) + 0.0::DOUBLE AS q75, round(max(value), 6) + 0.0::DOUBLE AS max FROM lng GROUP BY ALL")
def describe_features(spark, d):
    x = prep.describe(emb_long(spark, d))
    return x.select("feature", "n", *(r6(c).alias(c) for c in x.columns[2:]))



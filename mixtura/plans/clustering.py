"""Mixtures, agglomeration and classifiers over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mixtura.functions.vec import dbl, literal, r6, softmax, sqdist
from mixtura.operators import blocks, classify, clusters, ensemble, evaluation, landmark, linear, mixture, vbgmm
from mixtura.plans import fixtures
from mixtura.plans.fixtures import centroids, emb, emb_long, qin, table, with_
from mixtura.plans.registry import Registry

REGISTRY = query = Registry()


@query(with_("lng", "cent", "d2", "qin") + ", t AS (SELECT x.label AS a, y.label AS b, x.vec_id AS va, y.vec_id AS vb, sum((greatest(x.p, 1e-300) - greatest(y.p, 1e-300)) * (log2(greatest(x.p, 1e-300)) - log2(greatest(y.p, 1e-300)))) AS j FROM qin x JOIN qin y ON x.k = y.k AND x.label < y.label GROUP BY ALL) SELECT a, b, count(DISTINCT va) AS n_a, count(DISTINCT vb) AS n_b, round(avg(j), 5) AS dist FROM t GROUP BY a, b")
def cluster_jeffreys_matrix(spark, d):
    m = clusters.divergence_matrix(qin(spark, d), "label")
    return m.select("a", "b", "n_a", "n_b", F.round("dist", 5).alias("dist"))


def _labelled(spark, d):
    return clusters.clean(qin(spark, d)).select("vec_id", "label", "q", "cluster")


#: The assignments by the columns that win a row, and dense labels.
_CLEAN = with_("lng", "cent", "d2", "qin", more="""top AS (SELECT vec_id, arg_max(k, (p, -k)) AS k FROM qin GROUP BY 1), won AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS cluster FROM (SELECT DISTINCT k FROM top)),
lab AS (SELECT vec_id, cluster FROM top JOIN won USING (k)), cq AS (SELECT vec_id, lab.cluster, won.cluster AS col, p FROM qin JOIN won USING (k) JOIN lab USING (vec_id))""").replace("WITH ", "WITH RECURSIVE ", 1)
_UPGMA = _CLEAN + """, term AS (SELECT cluster, col, count(*) AS n, avg(greatest(p, 1e-300)) AS m, avg(log2(greatest(p, 1e-300))) AS l, avg(greatest(p, 1e-300) * log2(greatest(p, 1e-300))) AS h FROM cq GROUP BY ALL),
m0 AS (SELECT x.cluster AS a, y.cluster AS b, sum(x.h + y.h - x.m * y.l - y.m * x.l) AS d, max(x.n) AS wa, max(y.n) AS wb FROM term x JOIN term y ON x.col = y.col AND x.cluster < y.cluster GROUP BY ALL),
r AS (SELECT 0 AS step, false AS merged, a, b, d, wa, wb, 1 AS la, 1 AS lb FROM m0 UNION ALL SELECT * FROM (
  WITH p AS (SELECT * FROM r WHERE NOT merged), m AS (SELECT a AS ma, b AS mb, d AS h, wa AS mwa, wb AS mwb, la + lb AS leaves, step AS s FROM p ORDER BY d, a, b LIMIT 1),
  side AS (SELECT CASE WHEN a IN (ma, mb) THEN b ELSE a END AS c, CASE WHEN a IN (ma, mb) THEN a ELSE b END AS x, CASE WHEN a IN (ma, mb) THEN wb ELSE wa END AS wc, CASE WHEN a IN (ma, mb) THEN lb ELSE la END AS lc, d, ma, mwa, mwb, leaves, s FROM p, m WHERE (a IN (ma, mb)) <> (b IN (ma, mb)))
  SELECT s + 1 AS step, true AS merged, ma AS a, mb AS b, h AS d, mwa AS wa, mwb AS wb, leaves AS la, 0 AS lb FROM m
  UNION ALL SELECT s + 1, false, a, b, d, wa, wb, la, lb FROM p, m WHERE a NOT IN (ma, mb) AND b NOT IN (ma, mb)
  UNION ALL SELECT max(s) + 1, false, c, (SELECT count(*) FROM won) + max(s), sum(d * CASE WHEN x = ma THEN mwa ELSE mwb END) / max(mwa + mwb), max(wc), max(mwa + mwb), max(lc), max(leaves) FROM side GROUP BY c))
SELECT CAST(step - 1 AS INT) AS step, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(d, 9) AS dist, CAST(la AS INT) AS leaves FROM r WHERE merged"""


@query(_UPGMA)
def upgma_linkage(spark, d):
    return clusters.linkage(spark, clusters.divergence_matrix(_labelled(spark, d))).withColumn("dist", F.round("dist", 9))


#: The same with the mean of -ln sum pq over the pairs of rows.
_COLOC = _CLEAN + _UPGMA[len(_CLEAN):].replace(_UPGMA[_UPGMA.index(", term AS") : _UPGMA.index("r AS (SELECT 0 AS step")], """, pq AS (SELECT x.cluster AS a, y.cluster AS b, x.vec_id AS va, y.vec_id AS vb, -ln(greatest(sum(x.p * y.p), 1e-300)) AS j FROM cq x JOIN cq y ON x.col = y.col AND x.cluster < y.cluster GROUP BY ALL),
m0 AS (SELECT a, b, avg(j) AS d, count(DISTINCT va) AS wa, count(DISTINCT vb) AS wb FROM pq GROUP BY ALL),
""")
_STEPS = "SELECT CAST(step - 1 AS INT) AS step, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(d, 9) AS dist, CAST(la AS INT) AS leaves FROM r WHERE merged"


def _tree_sql(upgma: str, name: str, last: str) -> str:
    """Leaves by place, or pairs by the height at which they meet, from the linkage."""
    return f"""{upgma.removesuffix(_STEPS)}, st AS ({_STEPS}), kid AS (SELECT step, a AS x, 0 AS skip, dist FROM st UNION ALL SELECT s.step, s.b, coalesce(k.leaves, 1), s.dist FROM st s LEFT JOIN st k ON s.a = (SELECT count(*) FROM won) + k.step),
up AS (SELECT cluster AS leaf, cluster AS x, 0 AS place, CAST(NULL AS INT) AS step, CAST(NULL AS DOUBLE) AS dist FROM won UNION ALL SELECT leaf, (SELECT count(*) FROM won) + kid.step, place + skip, kid.step, kid.dist FROM up JOIN kid ON kid.x = up.x)
SELECT '{name}' AS metric, {last}"""


_LEAVES = "CAST(leaf AS INT) AS label, CAST(max(place) AS INT) AS position, CAST(5 + 10 * max(place) AS DOUBLE) AS x FROM up GROUP BY leaf"
_MEET = "CAST(p.leaf AS INT) AS a, CAST(q.leaf AS INT) AS b, round(arg_min(p.dist, p.step), 9) AS dist FROM up p JOIN up q ON p.step = q.step AND p.leaf < q.leaf GROUP BY p.leaf, q.leaf"


def _dendrograms(spark, d):
    """By name: the tables of the dendrogram under the divergence and under co-location."""
    rows = _labelled(spark, d).cache()
    sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}  # K numbers
    far = blocks.truncated_means(rows, "coloc", 1.0, id_col="vec_id").filter("a <> b")
    names = F.create_map(*(F.lit(int(x)) for kv in sizes.items() for x in kv))
    tables = {"jeffreys": clusters.divergence_matrix(rows), "coloc": far.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), names[F.col("a").cast("int")].alias("n_a"), names[F.col("b").cast("int")].alias("n_b"), "dist")}
    out = {name: clusters.dendrogram(spark, clusters.linkage(spark, m), sorted(sizes)) for name, m in tables.items()}
    rows.unpersist()
    return out


@query(f"SELECT * FROM ({_tree_sql(_UPGMA, 'jeffreys', _LEAVES)}) UNION ALL SELECT * FROM ({_tree_sql(_COLOC, 'coloc', _LEAVES)})")
def dendrogram_leaves(spark, d):
    parts = [t[0].select(F.lit(name).alias("metric"), "label", "position", "x") for name, t in _dendrograms(spark, d).items()]
    return parts[0].unionByName(parts[1])


@query(f"SELECT * FROM ({_tree_sql(_UPGMA, 'jeffreys', _MEET)}) UNION ALL SELECT * FROM ({_tree_sql(_COLOC, 'coloc', _MEET)})")
def cophenetic_distances(spark, d):
    parts = [t[2].select(F.lit(name).alias("metric"), "a", "b", F.round("dist", 9).alias("dist")) for name, t in _dendrograms(spark, d).items()]
    return parts[0].unionByName(parts[1])


#: One row of lists: rows of each cluster, sums of assignments (a list for each), where each cluster is now.
_MERGE = _CLEAN + """, sums AS (SELECT c.cluster, list(coalesce(s, 0) ORDER BY k.cluster) AS s, max(n) AS n FROM won c CROSS JOIN won k LEFT JOIN (SELECT cluster, col, sum(p) AS s, count(*) AS n FROM cq GROUP BY ALL) t ON t.cluster = c.cluster AND t.col = k.cluster GROUP BY 1),
r AS (SELECT list(n ORDER BY cluster) AS n, list(s ORDER BY cluster) AS s, list(CAST(cluster + 1 AS BIGINT) ORDER BY cluster) AS t FROM sums UNION ALL SELECT
    list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i = x THEN n[x] + n[c] WHEN i = c THEN 0 ELSE n[i] END),
    list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i = x THEN list_transform(range(1, len(n) + 1), lambda j: s[x][j] + s[c][j]) ELSE s[i] END),
    list_transform(t, lambda v: CASE WHEN v = c THEN x ELSE v END)
  FROM (SELECT n, s, t, c, -list_reverse_sort(list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] > 0 AND i <> c), lambda i: {'v': s[c][i], 'i': -i}))[1].i AS x
    FROM (SELECT n, s, t, -list_reverse_sort(list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] > 0 AND n[i] < 40), lambda i: {'v': n[i], 'i': -i}))[1].i AS c FROM r WHERE len(list_filter(n, lambda v: v > 0)) > 1) WHERE c IS NOT NULL)),
last AS (SELECT n, t FROM r ORDER BY len(list_filter(n, lambda v: v > 0)) LIMIT 1)
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS cluster, CAST(n AS BIGINT) AS n FROM (SELECT unnest(n) AS n, unnest(range(1, len(n) + 1)) AS i FROM last) WHERE n > 0"""


@query(_MERGE)
def merge_small(spark, d):
    return clusters.merge_small(_labelled(spark, d), 40).groupBy("cluster").agg(F.count("*").alias("n"))


#: Merged labels, their linkage, its cut into four and the small groups' absorption.
_SUPER = (
    _MERGE[: _MERGE.rindex("\nSELECT CAST(row_number()")].replace("n[i] < 40", "n[i] < 10").replace("\nr AS (SELECT list(n", "\nmr AS (SELECT list(n").replace("FROM r WHERE len", "FROM mr WHERE len").replace("FROM r ORDER", "FROM mr ORDER")
    + """, mm AS (SELECT i - 1 AS cluster, dense_rank() OVER (ORDER BY c) - 1 AS merged FROM (SELECT unnest(t) AS c, unnest(range(1, len(t) + 1)) AS i FROM last)),
lab2 AS (SELECT vec_id, merged AS cluster FROM lab JOIN mm USING (cluster)), cq2 AS (SELECT cq.vec_id, m.merged AS cluster, col, p FROM cq JOIN mm m ON m.cluster = cq.cluster), size2 AS (SELECT count(DISTINCT cluster) AS k FROM cq2)"""
    + _UPGMA[len(_CLEAN) :].removesuffix(_STEPS).replace("FROM cq GROUP", "FROM cq2 GROUP").replace("(SELECT count(*) FROM won)", "(SELECT k FROM size2)")
    + f""", st AS ({_STEPS}), anc AS (SELECT DISTINCT cluster AS leaf, cluster AS x FROM cq2 UNION ALL SELECT leaf, (SELECT k FROM size2) + st.step FROM anc JOIN st ON x IN (st.a, st.b) WHERE st.step < (SELECT k FROM size2) - 4),
g AS (SELECT leaf, dense_rank() OVER (ORDER BY least_leaf) AS g FROM (SELECT leaf, min(leaf) OVER (PARTITION BY root) AS least_leaf FROM (SELECT leaf, max(x) AS root FROM anc GROUP BY leaf))), sz AS (SELECT g, count(*) AS n FROM lab2 JOIN g ON leaf = cluster GROUP BY g),
ab AS (SELECT list(n ORDER BY g) AS n, list(CAST(g AS BIGINT) ORDER BY g) AS t FROM sz UNION ALL SELECT list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i = l THEN n[l] + n[s] WHEN i = s THEN 0 ELSE n[i] END), list_transform(t, lambda v: CASE WHEN v = s THEN l ELSE v END)
  FROM (SELECT n, t, list_sort(list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] > 0), lambda i: {{'v': n[i], 'i': i}}))[1].i AS s, -list_reverse_sort(list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] > 0), lambda i: {{'v': n[i], 'i': -i}}))[1].i AS l FROM ab WHERE len(list_filter(n, lambda v: v > 0)) > 1) WHERE n[s] < 10),
fin AS (SELECT t FROM ab ORDER BY len(list_filter(n, lambda v: v > 0)) LIMIT 1), sup AS (SELECT i AS g, dense_rank() OVER (ORDER BY c) - 1 AS supercluster FROM (SELECT unnest(t) AS c, unnest(range(1, len(t) + 1)) AS i FROM fin))
SELECT CAST(cluster AS INT) AS cluster, CAST(supercluster AS INT) AS supercluster, count(*) AS n FROM lab2 JOIN g ON leaf = cluster JOIN sup USING (g) GROUP BY ALL"""
)


@query(_SUPER)
def superclusters(spark, d):
    return clusters.superclusters(clusters.merge_small(_labelled(spark, d), 10)).groupBy("cluster", "supercluster").agg(F.count("*").alias("n"))


_POOLED = with_("lng", "cent", "d2", "qin").replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT x.label AS la, y.label AS lb, sum((greatest(x.p, 1e-300) - greatest(y.p, 1e-300)) * (log2(greatest(x.p, 1e-300)) - log2(greatest(y.p, 1e-300)))) AS j FROM qin x JOIN qin y ON x.k = y.k AND x.vec_id < y.vec_id AND x.label <> y.label GROUP BY x.vec_id, y.vec_id, x.label, y.label),
r AS (SELECT 0 AS step, label, label AS cur, NULL::INT AS ma, NULL::INT AS mb, NULL::DOUBLE AS h FROM (SELECT DISTINCT label FROM qin) UNION ALL SELECT * FROM (
  WITH p AS (SELECT least(x.cur, y.cur) AS a, greatest(x.cur, y.cur) AS b, j FROM t JOIN r x ON x.label = la JOIN r y ON y.label = lb WHERE x.cur <> y.cur),
  q AS (SELECT a, b, avg(j) AS d FROM (SELECT a, b, j, row_number() OVER (PARTITION BY a, b ORDER BY j) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM p) WHERE i <= greatest(1, floor(n * 0.25)) GROUP BY ALL),
  m AS (SELECT a, b, d FROM q ORDER BY d, a, b LIMIT 1)
  SELECT step + 1, label, CASE WHEN cur IN (a, b) THEN (SELECT max(label) FROM qin) + 1 + step ELSE cur END, a, b, d FROM r, m))
SELECT CAST(step - 1 AS INT) AS step, ma AS a, mb AS b, round(max(h), 9) + 0.0::DOUBLE AS height, CAST(count(*) FILTER (cur = (SELECT max(label) FROM qin) + step) AS INT) AS leaves FROM r WHERE step > 0 GROUP BY step, ma, mb"""


@query(_POOLED)
def agglomerate_truncated(spark, d):
    """Agglomeration by the mean of the lowest quarter of the pair divergences, pooled anew at each step."""
    out = blocks.agglomerated([qin(spark, d)], "jeffreys", 0.25, id_col="vec_id", label="label")
    return out.withColumn("height", F.round("height", 9) + dbl(0))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL), m AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / n END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM p GROUP BY ALL) SELECT vec_id, CAST(label AS BIGINT) AS label, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) + 0.0::DOUBLE AS silhouette FROM m")
def silhouette_exact(spark, d):
    s = blocks.silhouettes(emb(spark, d), "vec_id", "label")
    return s.select("vec_id", "label", (F.round("silhouette", 5) + dbl(0)).alias("silhouette"))


@query()
def pca_variance(spark, d):
    return linear.Pca(emb(spark, d)).spectrum(spark).select("component", r6("variance").alias("variance"), r6("ratio").alias("ratio"), r6("cumulative").alias("cumulative"))


@query(with_("lng") + "SELECT round(sum(v), 5) AS variance FROM (SELECT feature, var_samp(value) AS v FROM lng GROUP BY 1)")
def pca_total_variance(spark, d):
    return linear.Pca(emb(spark, d)).spectrum(spark).agg(F.round(F.sum("variance"), 5).alias("variance"))


@query()
def cum_variance_k(spark, d):
    p = linear.Pca(emb(spark, d))
    return p.spectrum(spark).agg(F.count_if(F.col("cumulative") <= 0.975).alias("components"))


@query(with_("lng", "cent", "d2") + ", b AS (SELECT vec_id, min(d) AS d FROM d2 GROUP BY 1), a AS (SELECT vec_id, min(k) AS k, min(d) AS d FROM d2 JOIN b USING (vec_id, d) GROUP BY vec_id), g AS (SELECT k, count(*) AS n, sum(d) AS s FROM a GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s FROM g), e AS (SELECT -max(t.s) + sum(g.n * ln(g.n / t.n)) AS llh, max(t.s) AS sumdist, max(t.n) AS n FROM g, t), p AS (SELECT CAST(count(*) AS DOUBLE) AS p FROM cent) SELECT round(llh, 4) AS llh, round(llh - p, 4) AS aic, round(llh - 0.5::DOUBLE * p * ln(n), 4) AS bic, round(sumdist, 4) AS sumdist FROM e, p")
def kmeans_fixed_centers(spark, d):
    k = linear.kmeans_criteria(emb(spark, d), centroids(spark, d))
    return k.select(*(F.round(c, 4).alias(c) for c in k.columns))


@query(with_("lng") + ", g AS (SELECT grp, feature, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM lng GROUP BY ALL), mu AS (SELECT feature, avg(value) AS mu FROM lng GROUP BY 1) SELECT round((sum(n * (m - mu) * (m - mu)) / (count(DISTINCT grp) - 1)) / (sum(n * s) / (sum(n) / count(DISTINCT feature) - count(DISTINCT grp))), 5) AS ch FROM g JOIN mu USING (feature)")
def calinski_harabasz(spark, d):
    return linear.calinski_harabasz(emb(spark, d), "label").select(F.round("ch", 5).alias("ch"))


@query(with_("lng", "cent", "d2") + ", s2 AS (SELECT k, avg(d) / (SELECT count(DISTINCT feature) FROM lng) AS s2, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM embeddings) AS w FROM d2 WHERE label = k GROUP BY k), l AS (SELECT vec_id, k, ln(w) - (SELECT count(DISTINCT feature) FROM lng) / 2.0::DOUBLE * ln(2 * pi() * s2) - d / (2 * s2) AS l FROM d2 JOIN s2 USING (k)), e AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, CAST(k AS INT) AS k, round(e / sum(e) OVER (PARTITION BY vec_id), 5) + 0.0::DOUBLE AS p FROM e")
def gmm_responsibilities(spark, d):
    """A spherical mixture with the labels' means, weights and mean squared distances."""
    c = centroids(spark, d)
    e = emb(spark, d)
    to_own = F.element_at(F.array(*(sqdist("x", literal(m)) for m in c)), (F.col("label") + 1).cast("int"))
    rows = e.groupBy("label").agg(F.count("*").alias("n"), F.avg(to_own).alias("d")).orderBy("label").collect()  # K rows
    n = sum(r.n for r in rows)
    q = linear.responsibilities(e, np.array([r.n / n for r in rows]), c, np.array([r.d / c.shape[1] for r in rows]), "spherical")
    return q.select("vec_id", F.posexplode("q").alias("k", "p")).select("vec_id", "k", (F.round("p", 5) + dbl(0)).alias("p"))


@query(with_("lng", "cent") + ", s2 AS (SELECT k, l.feature, c, avg((value - c) * (value - c)) AS s2, count(*) AS n FROM lng l JOIN cent ON k = grp AND cent.feature = l.feature GROUP BY ALL), l AS (SELECT vec_id, k, ln(CAST(max(n) AS DOUBLE) / (SELECT count(*) FROM embeddings)) - 0.5::DOUBLE * sum(ln(2 * pi() * s2) + (value - c) * (value - c) / s2) AS l FROM lng JOIN s2 USING (feature) GROUP BY ALL), e AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, CAST(k AS INT) AS k, round(e / sum(e) OVER (PARTITION BY vec_id), 5) + 0.0::DOUBLE AS p FROM e")
def gmm_responsibilities_diag(spark, d):
    """A mixture with the labels' means, weights and variances of each component."""
    per = emb_long(spark, d).groupBy("grp", "feature").agg(F.var_pop("value").alias("v"), F.count("*").alias("n")).orderBy("grp", "feature").collect()  # K x D numbers
    means = centroids(spark, d)
    n = np.array([r.n for r in per], float).reshape(means.shape)[:, 0]
    q = linear.responsibilities(emb(spark, d), n / n.sum(), means, np.array([r.v for r in per]).reshape(means.shape), "diag")
    return q.select("vec_id", F.posexplode("q").alias("k", "p")).select("vec_id", "k", (F.round("p", 5) + dbl(0)).alias("p"))


def _reduced(spark, d, k: int):
    """The first principal components, whitened."""
    e = emb(spark, d)
    return linear.Pca(e).transform(e, k, whiten=True)


@query()
def kmeans_sweep(spark, d):
    s = linear.kmeans_sweep(_reduced(spark, d, 8), [2, 4, 8], 1)
    return s


@query()
def vbgmm_fit(spark, d):
    """Distributed over rows: a few rounds on eight components of the embeddings."""
    x = _reduced(spark, d, 8).select("vec_id", "x").cache()
    post = vbgmm.fit(x, vbgmm.Params(k=5, max_iter=12, seed=1))
    out = vbgmm.predict(x, post).groupBy("component").agg(F.count("*").alias("n"), F.avg("log_density").alias("log_density"))
    return out


@query()
def gmm_cv(spark, d):
    """Sizes of a Gaussian mixture by their held-out likelihood over five folds."""
    x = evaluation.folds(_reduced(spark, d, 8).select("vec_id", "label", "x"), "vec_id", "label", 5).select("x", "fold").cache()
    out = mixture.chosen(mixture.cross_validate(x, [1, 2, 4, 8], 5, max_iter=25))
    x.unpersist()
    return out


@query(with_("lng", "cent", "d2", "qin") + ", b AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN p * 1.1 WHEN vec_id % 17 = 0 AND k = 0 THEN -p WHEN vec_id % 19 = 0 AND k = 1 THEN NULL ELSE p END AS p FROM qin), r AS (SELECT vec_id, bool_or(p IS NULL OR p < 0 OR p > 1) AS bad, abs(sum(p) - 1) > 1e-6 AS off FROM b GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (bad) AS out_of_range, count(*) FILTER (NOT bad AND off) AS not_one FROM r")
def assignment_check(spark, d):
    """Some rows are spoiled: sums that are not one, negative shares, shares that are missing."""
    q, v = qin(spark, d), F.col("vec_id")
    spoiled = F.transform("q", lambda p, k: F.when(v % 13 == 0, p * dbl(1.1)).when((v % 17 == 0) & (k == 0), -p).when((v % 19 == 0) & (k == 1), F.lit(None)).otherwise(p))
    return clusters.check_assignments(q.withColumn("q", spoiled))


@query(with_("lng", "cent", "d2", "qin") + ", o AS (SELECT vec_id, k, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS o FROM d2), kl AS (SELECT vec_id, sum(greatest(p, 1e-300) * (log2(greatest(p, 1e-300)) - log2(greatest(o, 1e-300)))) AS kl FROM qin JOIN o USING (vec_id, k) GROUP BY 1) SELECT count(*) AS n, round(avg(kl), 6) AS mean_kl, round(max(kl), 6) AS max_kl FROM kl")
def posterior_divergence(spark, d):
    """The assignments against those of a sharper mixture over the same centres."""
    sharp = fixtures.scores_to_centroids(spark, d).select("vec_id", softmax(F.transform("s", lambda v: v / dbl(fixtures.TAU))).alias("sharp"))
    k = clusters.posterior_divergence(qin(spark, d).join(sharp, "vec_id"), "q", "sharp")
    return k.select("n", r6("mean_kl").alias("mean_kl"), r6("max_kl").alias("max_kl"))


@query()
def vbgmm_grid(spark, d):
    """All points of the grid and restarts fitted together, with ensemble weights."""
    x = _reduced(spark, d, 4)
    return ensemble.score_table(ensemble.fit_grid(x, {"k": [4, 2, 1], "covtyp": ["full", "diag"], "max_iter": [40], "inits": [1]}, 2))


def _binary(spark, d, k: int = 8):
    return _reduced(spark, d, k).select(F.col("vec_id").alias("id"), "x", (F.col("label") < 5).cast("int").alias("y"))


@query()
def krc_out_of_fold(spark, d):
    return landmark.kernel_ridge(_binary(spark, d), [0.01, 0.05, 0.2], [0.3, 1.0, 3.0], 5)


@query()
def svm_out_of_fold(spark, d):
    """Held-out chances of RBF support vector machines, width and cost chosen inside each fold."""
    return landmark.Svm(_binary(spark, d), [0.02, 0.1], [0.1, 1.0], 3, rounds=30).out_of_fold()


@query()
def mlp_out_of_fold(spark, d):
    return classify.perceptrons(_binary(spark, d), [(12,), (10, 10)], [1e-2, 1.0], 3, rounds=25)


@query()
def classifier_store(spark, d):
    """Several classifiers' held-out chances in one metric store."""
    wide = _binary(spark, d)
    ridge = landmark.kernel_ridge(wide, [0.05], [1.0], 5).withColumn("mthd", F.lit("KRC"))
    flat = wide.select("id", "y", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(8)))
    forest = classify.forests(flat, [f"x{i}" for i in range(8)], [10], ["gini"], [5], 3).withColumn("mthd", F.lit("RFC"))
    return evaluation.evaluate_all(ridge.unionByName(forest))


@query()
def gp_feature_evidence(spark, d):
    """All 64 components of all vectors."""
    return landmark.feature_evidence(emb(spark, d).select("x", (F.col("label") < 5).cast("int").alias("y")))


@query()
def kernel_pca(spark, d):
    """Ten kernel components of the standardised vectors, then two principal ones."""
    e = _reduced(spark, d, 16).withColumnRenamed("vec_id", "id")
    k = landmark.KernelPca(e, 1 / 16).transform(e)
    return linear.Pca(k).transform(k, 2).select("id", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(1))).alias("x1"))


@query()
def rf_importance(spark, d):
    l = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"))  # noqa: E741
    return classify.forest_importance(l, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], trees=5, depth=4)

"""Grids of hyper-parameters and restarts, fitted together; ensemble weights, densities, best models."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtura.operators.vbgmm import Params, Posterior, fit_many, predict


def expand(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """paramid and one column for each key: keys sorted, the last runs fastest."""
    keys = sorted(grid)
    values = [grid[k] if isinstance(grid[k], (list, tuple, range)) else [grid[k]] for k in keys]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(product(*values))], ["paramid", *keys])


def held_out_score(rows: DataFrame, x: str = "x") -> Callable[[Posterior], float]:
    """A score of models for ``fit_grid``: the mean log density of other rows."""
    return lambda post: float(predict(rows.select(x), post, x).agg(F.avg("log_density")).first()[0])


def fit_grid(df: DataFrame, grid: dict[str, list], restarts: int, x: str = "x", seed: int = 0, scored: Callable[[Posterior], float] | None = None) -> DataFrame:
    """(paramid, restart, score, model) for each point of the grid and restart. All are fitted together
    by ``fit_many``, which is distributed over the rows; a fit that failed has no model and score NaN.
    ``scored`` gives a model's score, where larger is better; by default its bound."""
    value = scored or (lambda p: float(p.history[-1]))
    spark = df.sparkSession
    points = expand(spark, grid)
    jobs = [(r.asDict(), i) for r in points.collect() for i in range(restarts)]  # the grid
    params = [Params(**{k: v for k, v in r.items() if k != "paramid"}, seed=seed + 1000 * i) for r, i in jobs]
    rows = [(r["paramid"], i, value(p) if p else float("nan"), dumped_model(p) if p else None) for (r, i), p in zip(jobs, fit_many(df, params, x))]
    return spark.createDataFrame(rows, "paramid long, restart long, score double, model string").join(points, "paramid")


def best_per_param(scores: DataFrame, key: str = "paramid", score: str = "score") -> DataFrame:
    """The best row of each parameter set; scores that are no numbers are passed over."""
    ok = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    first = Window.partitionBy(key).orderBy(F.desc(score), *(["restart"] if "restart" in scores.columns else []))
    return ok.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def weights(best: DataFrame, score: str = "score", top: int | None = None, weigh: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``best`` (one row for each parameter set) with ``weight``: softmax of the scores, of the
    ``top`` highest only where given. ``weigh`` makes another weight of a score and the best score;
    weights are normalised."""
    everything = Window.partitionBy(F.lit(0))
    if top is not None:
        best = best.withColumn("_r", F.row_number().over(everything.orderBy(F.desc(score), "paramid"))).filter(F.col("_r") <= top).drop("_r")
    e = (weigh or (lambda s, most: F.exp(s - most)))(F.col(score), F.max(score).over(everything))
    return best.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(everything)).drop("_e")


def log_density(densities: DataFrame, weighted: DataFrame, id_col: str, key: str = "paramid") -> DataFrame:
    """(id, log_density) from (id, paramid, log_density) and (paramid, weight): log sum of w exp(l),
    shifted by the row's largest."""
    joined = densities.join(F.broadcast(weighted.select(key, "weight")), key)  # a row for each grid point
    lw = F.log("weight") + F.col("log_density")
    top = joined.groupBy(id_col).agg(F.max(F.when(F.col("weight") > 0, lw)).alias("_m"), F.collect_list(lw).alias("_l"))
    return top.select(id_col, (F.col("_m") + F.log(F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_m"))))).alias("log_density"))


def score_table(scores: DataFrame) -> DataFrame:
    """The best fit of each parameter set with its weight, as the stored score tables have it."""
    best = weights(best_per_param(scores))
    return best.drop("model", "restart").withColumnsRenamed({"score": "selscores", "weight": "ensweights"}).withColumn("ensscores", F.col("selscores"))


def dumped_model(post: Posterior) -> str:
    """A fit as JSON: numbers and lists of numbers only."""
    plain = lambda v: v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v
    fields = {k: plain(v) for k, v in post.__dict__.items() if k != "params"}
    return json.dumps({"params": {k: plain(v) for k, v in post.params.__dict__.items()}, **fields})


def load_model(text: str) -> Posterior:
    fields = json.loads(text)
    params = fields.pop("params")
    params["h"] = np.array(params["h"]) if isinstance(params["h"], list) else params["h"]
    return Posterior(Params(**params), **{k: np.array(v) if isinstance(v, list) and k != "history" else v for k, v in fields.items()})


def best_model(scores: DataFrame) -> DataFrame:
    """The one row with the best score, of equals the first parameter set and restart."""
    ok = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    row = F.struct(*(F.col(c) for c in scores.columns))
    return ok.agg(F.max_by(row, F.struct("score", -F.col("paramid"), -F.col("restart"))).alias("m")).select("m.*")


def predict_best(df: DataFrame, scores: DataFrame, x: str = "x") -> DataFrame:
    """``df`` with q, log_density and component under the best model."""
    (best,) = best_model(scores).select("model").collect()
    return predict(df, load_model(best.model), x)


def cv_summary(scores: DataFrame, params: list[str], score: str = "score") -> DataFrame:
    """Mean and sum over folds for each parameter set."""
    return scores.groupBy(*params).agg(F.avg(score).alias("meanscore"), F.sum(score).alias("sumscore"))

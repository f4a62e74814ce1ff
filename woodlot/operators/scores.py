"""Node scores, predictor information and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.uniform import uniform

NODE = ["tree_id", "node_id"]


def mean_scores(assign: DataFrame) -> DataFrame:
    """Mean of y over a node's samples."""
    return assign.groupBy(*NODE).agg((F.sum(F.col("y") * F.col("s_count")) / F.sum("s_count")).alias("score"))


def class_counts(assign: DataFrame) -> DataFrame:
    """Samples of each class in each node."""
    return assign.groupBy(*NODE, "ctg").agg(F.sum("s_count").alias("n"))


def plurality_scores(assign: DataFrame, seed: int = 0) -> DataFrame:
    """The class of most samples, unweighted; ties by hash. The score is the code plus a jitter in [0, 0.5)."""
    best = class_counts(assign).withColumn("u", plurality_hash(seed)).groupBy(*NODE).agg(F.max(F.struct("n", "u", "ctg")).alias("m"))
    return best.select(*NODE, F.col("m.ctg").alias("ctg"), plurality_score("m").alias("score"))


def plurality_hash(seed: int) -> Column:
    return uniform(seed, "plurality", F.col("tree_id"), F.col("node_id"), F.col("ctg"))


def plurality_score(best: str) -> Column:
    """Score of a struct with ctg and u."""
    return F.col(f"{best}.ctg") + F.col(f"{best}.u") / 2


def log_odds_scores(assign: DataFrame) -> DataFrame:
    """Newton step of the logistic loss: sum of residuals over sum of p(1 - p) (A20); y is the residual, pq the weight."""
    return assign.groupBy(*NODE).agg(F.coalesce(F.try_divide(F.sum(F.col("y") * F.col("s_count")), F.sum(F.col("pq") * F.col("s_count"))), F.lit(0.0)).alias("score"))


def class_weights(rows: DataFrame, label: str, n_ctg: int, weight: list[float] | str | None = None) -> list[float]:
    """Weights of the classes, summing to one: unit, given, or 'balance' = inverse frequency."""
    if weight is None:
        w = [1.0] * n_ctg
    elif weight == "balance":
        counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
        w = [1.0 / counts[k] if counts.get(k) else 0.0 for k in range(n_ctg)]
    elif isinstance(weight, str):
        raise ValueError("class weights are numbers or 'balance'")
    else:
        w = [float(x) for x in weight]
        if len(w) != n_ctg or min(w) < 0 or not sum(w):
            raise ValueError("one weight for each class, none below zero, not all zero")
    return [x / sum(w) for x in w]


def predictor_info(nodes: DataFrame, p: int, n_tree: int) -> DataFrame:
    """pred_id, info: summed gain of each predictor's splits over the number of trees; zero without any."""
    every = nodes.sparkSession.range(p).select(F.col("id").cast("int").alias("pred_id"))
    got = nodes.where("left_id IS NOT NULL").groupBy("pred_id").agg((F.sum("info") / n_tree).alias("info"))
    return every.join(F.broadcast(got), "pred_id", "left").select("pred_id", F.coalesce("info", F.lit(0.0)).alias("info"))


def plurality(counts: DataFrame, by: list[str], label: str, n: str, seed: int = 0) -> DataFrame:
    """by, label of greatest n; ties by hash of by and label (K5)."""
    u = uniform(seed, "argmax", *map(F.col, by), F.col(label))
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(n), F.desc("u"), label))
    return counts.withColumn("u", u).withColumn("r", r).where("r = 1").select(*by, label)

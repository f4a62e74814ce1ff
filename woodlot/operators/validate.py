"""Test statistics and permutation importance (V2-V5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import permuted


def test_regression(both: DataFrame) -> DataFrame:
    """n, mse, mae, rsq of (y, y_pred); rsq is 0 for a single row (V2)."""
    e = F.col("y") - F.col("y_pred")
    a = both.where("y IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), F.var_samp("y").alias("v"))
    return a.select("n", "mse", "mae", F.when(F.col("n") > 1, F.lit(1.0) - F.try_divide(F.col("sse"), F.col("v") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("rsq"))


test_regression.__test__ = False


def confusion(both: DataFrame) -> DataFrame:
    """y, ctg, n of (y, ctg) pairs (V3); a test level unseen in training counts as any other row (V4)."""
    return both.groupBy("y", "ctg").agg(F.count(F.lit(1)).alias("n"))


def misprediction(cells: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """y, misprediction: share of wrong predictions in each class; 0 for a class without rows (V3, V4)."""
    rate = cells.groupBy("y").agg((F.sum(F.when(F.col("y") == F.col("ctg"), 0).otherwise(F.col("n"))) / F.sum("n")).alias("misprediction"))
    if levels is None:
        return rate
    return levels.select("y").distinct().join(rate, "y", "full").select("y", F.coalesce("misprediction", F.lit(0.0)).alias("misprediction"))


def error(cells: DataFrame) -> DataFrame:
    """n, error over all rows."""
    return cells.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y") == F.col("ctg"), 0).otherwise(F.col("n"))) / F.sum("n")).alias("error"))


def merged_levels(training: list[str], seen: list[str]) -> list[str]:
    """Training levels, then test levels that training lacks; those are always wrong (V4)."""
    return [*training, *sorted(set(seen) - set(training))]


def permute_predictor(encoded: DataFrame, pred_id: int, seed: int = 0) -> DataFrame:
    """encoded with one predictor's values handed around by a random permutation of rows (V5)."""
    pairs = permuted(encoded, seed + pred_id)
    other = encoded.select(F.col("row_id").alias("from_id"), F.element_at("x", pred_id + 1).alias("v"))
    moved = pairs.join(other, "from_id").select("row_id", "v")
    return encoded.join(moved, "row_id").withColumn("x", F.transform("x", lambda v, i: F.when(i == pred_id, F.col("v")).otherwise(v))).drop("v")

"""Quantiles and weights from the members of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import written

BINS = 4096


def bins(labels: DataFrame, most: int = BINS) -> DataFrame:
    """row_id, bin, bin_mean: ranks of y shifted right until they fit, and the mean y of each bin.

    labels: row_id, y, y_rank (0-based dense rank of y, as of rank_values or rank_values_at_scale).
    """
    top = labels.agg(F.max("y_rank")).first()[0] or 0
    shift = 0
    while (top >> shift) >= most:
        shift += 1
    binned = labels.withColumn("bin", F.shiftright(F.col("y_rank").cast("long"), shift))
    mean = binned.groupBy("bin").agg(F.avg("y").alias("bin_mean"))
    return binned.join(F.broadcast(mean), "bin").select("row_id", "bin", "bin_mean")


def by_leaves(walked: DataFrame, compute) -> DataFrame:
    """compute(walked) for one row of each set of leaves, handed to every row that fell in the same leaves."""
    reached = walked.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("tree_id", "node_id"))).alias("leaves"))
    first = reached.groupBy("leaves").agg(F.min("row_id").alias("first"))
    same = written(reached.join(first, "leaves").select("row_id", "first"), "same-leaves")
    out = compute(walked.join(same.where("row_id = first").select("row_id"), "row_id"))
    return same.join(out.withColumnRenamed("row_id", "first"), "first").drop("first")


def pooled(walked: DataFrame, members: DataFrame, binned: DataFrame) -> DataFrame:
    """row_id, bin, bin_mean, n: members of all the leaves a row fell in, by bin; combined before the window."""
    inside = members.join(binned.withColumnRenamed("row_id", "member"), members.row_id == F.col("member")).groupBy("tree_id", "node_id", "bin", "bin_mean").agg(F.sum("s_count").alias("n"))
    return walked.join(inside, ["tree_id", "node_id"]).groupBy("row_id", "bin", "bin_mean").agg(F.sum("n").alias("n"))


def quantiles(pool: DataFrame, levels: list[float]) -> DataFrame:
    """row_id, q, q_pred: mean of the first bin whose running share reaches q."""
    if any(not 0 <= q <= 1 for q in levels) or any(a >= b for a, b in zip(levels, levels[1:])):
        raise ValueError("quantiles lie in [0, 1] and increase")
    run = F.sum("n").over(W.partitionBy("row_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy("row_id"))
    at = pool.withColumns({"run": run, "total": total}).select("row_id", "bin", "bin_mean", "run", "total", F.explode(F.array(*[F.lit(float(q)) for q in levels])).alias("q"))
    return at.where(F.col("run") >= F.col("q") * F.col("total")).groupBy("row_id", "q").agg(F.min_by("bin_mean", "bin").alias("q_pred"))


def quantile_of_prediction(pool: DataFrame, predictions: DataFrame) -> DataFrame:
    """row_id, q_est: share of the pool in bins whose mean is below the row's prediction."""
    return pool.join(predictions, "row_id").groupBy("row_id").agg((F.sum(F.when(F.col("bin_mean") < F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("q_est"))


#: Rows of a block of `forest_weights`. Generated code holds the pairs of two blocks at once: 262,144 rows of 32 bytes.
BLOCK = 512


def _alike(pairs: DataFrame, what: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(classes, blocks) of pairs (row_id, tree_id, node_id, ...): rows whose structs of `what` are the same are a class.

    classes: cls, tree_id, node_id, ... once for each class. blocks: cls, ids: a class's rows in lists of at most BLOCK.
    """
    reached = pairs.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(*what))).alias("leaves"))
    # a class is known by its least row; rows of a class fall into blocks by their place in a partition
    reached = written(reached, name)
    first = written(reached.groupBy("leaves").agg(F.min("row_id").alias("cls")), name)
    same = reached.join(first, "leaves").select("cls", "row_id").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    same = written(same, name)
    place = F.row_number().over(W.partitionBy("cls", "part").orderBy("at")) - 1
    blocks = same.withColumn("block", F.floor(place / BLOCK)).groupBy("cls", "part", "block").agg(F.collect_list("row_id").alias("ids")).select("cls", "ids")
    return first.select("cls", F.inline("leaves")), blocks


def forest_weights(walked: DataFrame, members: DataFrame, digits: int | None = None) -> DataFrame:
    """row_id, member_id, weight: share of a training row in the leaves that a row fell in, normalised for the row.

    The pairs are as many as the result has rows, so they are neither joined one by one nor sorted or shuffled:
    a weight is found once for two classes of rows that share all their leaves, and blocks of the classes' rows,
    spread evenly over tasks, unfold into pairs as they are read. digits: weights are rounded, once for two classes.
    """
    spark = walked.sparkSession
    rows, row_blocks = _alike(walked, ["tree_id", "node_id"], "weight-rows")
    inside, member_blocks = _alike(members.select("row_id", "tree_id", "node_id", "s_count"), ["tree_id", "node_id", "s_count"], "weight-members")
    sizes = members.groupBy("tree_id", "node_id").agg(F.sum("s_count").alias("size"))
    share = inside.join(sizes, ["tree_id", "node_id"]).select("tree_id", "node_id", F.col("cls").alias("member_cls"), (F.col("s_count") / F.col("size")).alias("share"))
    per = rows.join(share, ["tree_id", "node_id"]).groupBy("cls", "member_cls").agg(F.sum("share").alias("share"))
    total = rows.join(sizes, ["tree_id", "node_id"]).groupBy("cls").agg(F.count(F.lit(1)).alias("trees"))
    value = F.col("share") / F.col("trees")
    weight = per.join(total, "cls").select("cls", "member_cls", (value if digits is None else F.round(value, digits)).alias("weight"))
    pairs = weight.join(row_blocks.withColumnRenamed("ids", "row_ids"), "cls").join(member_blocks.select(F.col("cls").alias("member_cls"), F.col("ids").alias("member_ids")), "member_cls")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    spread = pairs.select("row_ids", "member_ids", "weight").repartition(tasks)
    return spread.select(F.explode("row_ids").alias("row_id"), "member_ids", "weight").select("row_id", F.explode("member_ids").alias("member_id"), "weight")

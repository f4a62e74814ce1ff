"""Trees as arrays, text and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.encode import Signature


def expanded(nodes: DataFrame) -> DataFrame:
    """tree_id, i (place in the tree), pred (-(i + 1) at a leaf), child_l, child_r (places), split, fac_split, score."""
    placed = nodes.withColumn("i", (F.row_number().over(W.partitionBy("tree_id").orderBy("node_id")) - 1).cast("int"))
    at = lambda name: placed.select("tree_id", F.col("node_id").alias(f"{name}_id"), F.col("i").alias(f"child_{name[0]}"))
    out = placed.join(at("left"), ["tree_id", "left_id"], "left").join(at("right"), ["tree_id", "right_id"], "left")
    leaf = F.col("left_id").isNull()
    return out.select("tree_id", "i", F.when(leaf, -(F.col("i") + 1)).otherwise(F.col("pred_id")).alias("pred"), F.coalesce("child_l", F.lit(0)).alias("child_l"), F.coalesce("child_r", F.lit(0)).alias("child_r"), F.col("cut").alias("split"), F.col("true_codes").alias("fac_split"), "score")


def _test(sig: Signature, left: bool):
    """SQL text of the branch condition of a node, as a column."""
    name = F.element_at(F.array(*[F.lit(f"`{n}`") for n in sig.names]), F.col("pred_id") + 1)
    levels = F.element_at(F.array(*[F.array(*[F.lit(v) for v in sig.levels.get(n, [])]).cast("array<string>") for n in sig.names]), F.col("pred_id") + 1)
    named = F.array_join(F.transform("true_codes", lambda c: F.concat(F.lit("'"), F.replace(F.get(levels, c), F.lit("'"), F.lit("''")), F.lit("'"))), ", ")
    inside = F.concat(name, F.lit(" IN ("), F.when(F.size("true_codes") > 0, named).otherwise(F.lit("NULL")), F.lit(")"))
    below = F.concat(name, F.lit(" <= "), F.col("cut").cast("string"))
    if left:
        return F.when(F.col("kind") == "factor", F.concat(F.lit("coalesce("), inside, F.lit(", false)"))).otherwise(F.concat(F.lit("coalesce("), below, F.lit(", "), F.col("na_left").cast("string"), F.lit(")")))
    return F.when(F.col("kind") == "factor", F.concat(F.lit("NOT coalesce("), inside, F.lit(", false)"))).otherwise(F.concat(F.lit("NOT coalesce("), below, F.lit(", "), F.col("na_left").cast("string"), F.lit(")")))


def rules(nodes: DataFrame, sig: Signature) -> DataFrame:
    """tree_id, node_id, rule, score: for each leaf, the WHERE condition of the rows that reach it."""
    splits = nodes.where("left_id IS NOT NULL")
    edge = splits.select("tree_id", F.col("left_id").alias("child"), _test(sig, True).alias("test")).unionByName(splits.select("tree_id", F.col("right_id").alias("child"), _test(sig, False).alias("test")))
    leaf = nodes.where("left_id IS NULL").withColumn("depth0", F.floor(F.log2(F.col("node_id").cast("double"))).cast("int"))
    up = leaf.select("tree_id", "node_id", "score", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth0")), lambda k: F.floor(F.col("node_id") / F.pow(F.lit(2.0), k)).cast("long"))).alias("child"))
    each = up.join(edge, ["tree_id", "child"], "left")
    parts = each.groupBy("tree_id", "node_id", "score").agg(F.sort_array(F.collect_list(F.when(F.col("test").isNotNull(), F.struct("child", "test")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["test"]), " AND ")
    return parts.select("tree_id", "node_id", F.when(F.size("p") > 0, text).otherwise(F.lit("true")).alias("rule"), "score")


def dump(nodes: DataFrame, sig: Signature) -> DataFrame:
    """tree_id, node_id, line: one line of text for each node."""
    pad = F.repeat(F.lit("  "), F.floor(F.log2(F.col("node_id").cast("double"))).cast("int"))
    what = F.when(F.col("left_id").isNull(), F.concat(F.lit("leaf "), F.col("score").cast("string"))).otherwise(_test(sig, True))
    return nodes.select("tree_id", "node_id", F.concat(pad, F.col("node_id").cast("string"), F.lit(": "), what).alias("line"))

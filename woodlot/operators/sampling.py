"""Row and predictor sampling (P1-P18). Every draw is a hash of (seed, purpose, tree, row or draw)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import small, written
from ..functions.uniform import uniform
from ..sources.encode import numbered

BINS = 1 << 16


def sample_count(n_avail: int, n_samp: int = 0, with_repl: bool = True) -> int:
    """Rows to draw for a tree."""
    if n_samp <= 0:
        return n_avail if with_repl else round((1 - math.exp(-1)) * n_avail)
    return n_samp if with_repl else min(n_samp, n_avail)


def holdout(rows: DataFrame, n_holdout: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """row_id of held-out rows: n_holdout by hash, and every row without a label."""
    present = rows if label is None else rows.where(F.col(label).isNotNull())
    picked = lowest(present.select("row_id", uniform(seed, "holdout", F.col("row_id")).alias("u")), [], "u", n_holdout).select("row_id")
    return picked if label is None else picked.unionByName(rows.where(F.col(label).isNull()).select("row_id"))


def lowest(df: DataFrame, by: list[str], u: str, k: int, tie: str = "row_id") -> DataFrame:
    """The k rows of least u in [0, 1) for each group. Whole bins below the k-th row pass; only the bin that
    holds the k-th row is sorted, so no task sees a group whole."""
    if k <= 0:
        return df.limit(0)
    binned = df.withColumn("__bin", F.floor(F.col(u) * BINS))
    counts = binned.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    until = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wanted = until.where(F.col("__before") < k).select(*by, "__bin", (F.lit(k) - F.col("__before")).alias("__left"), "__n")
    near = binned.join(wanted, [*by, "__bin"])
    order = F.row_number().over(W.partitionBy(*by, "__bin").orderBy(u, tie))
    whole = near.where(F.col("__n") <= F.col("__left"))
    part = near.where(F.col("__n") > F.col("__left")).withColumn("__r", order).where(F.col("__r") <= F.col("__left")).drop("__r")
    return whole.unionByName(part).drop("__bin", "__left", "__n")


def draws(spark, n_tree: int, n_samp: int, seed: int, first_tree: int = 0) -> DataFrame:
    """tree_id, draw, u: n_samp draws for each tree, made in parallel."""
    return spark.range(n_tree * n_samp).select((F.floor(F.col("id") / n_samp) + first_tree).cast("int").alias("tree_id"), (F.col("id") % n_samp).alias("draw")).withColumn("u", uniform(seed, "bag", F.col("tree_id"), F.col("draw")))


def bag_with_replacement(rows: DataFrame, n_tree: int, n_samp: int, seed: int = 0, first_tree: int = 0, n_avail: int | None = None) -> DataFrame:
    """tree_id, row_id, s_count (P3, P9); multiplicities are combined before the join to row ids."""
    index = numbered(rows.select("row_id"), ["row_id"])
    n = n_avail if n_avail is not None else rows.count()
    picks = draws(rows.sparkSession, n_tree, n_samp, seed, first_tree).select("tree_id", F.floor(F.col("u") * n).alias("i")).groupBy("tree_id", "i").agg(F.count(F.lit(1)).alias("s_count"))
    return picks.join(index, "i").select("tree_id", "row_id", "s_count")


def _each_tree(rows: DataFrame, n_tree: int, first_tree: int) -> DataFrame:
    return rows.withColumn("tree_id", F.explode(F.sequence(F.lit(first_tree), F.lit(first_tree + n_tree - 1))))


def bag_without_replacement(rows: DataFrame, n_tree: int, n_samp: int, seed: int = 0, first_tree: int = 0, n_avail: int | None = None) -> DataFrame:
    """tree_id, row_id, s_count = 1: the n_samp rows of least hash for each tree (P4); a bag of all n_avail rows needs no hash."""
    each = _each_tree(rows.select("row_id"), n_tree, first_tree)
    if n_avail is not None and n_samp >= n_avail:
        return each.select("tree_id", "row_id", F.lit(1).cast("long").alias("s_count"))
    each = each.withColumn("u", uniform(seed, "bag", F.col("tree_id"), F.col("row_id")))
    return lowest(each, ["tree_id"], "u", n_samp).select("tree_id", "row_id", F.lit(1).cast("long").alias("s_count"))


def bag_weighted_without(rows: DataFrame, weight: str, n_tree: int, n_samp: int, seed: int = 0, first_tree: int = 0) -> DataFrame:
    """Efraimidis-Spirakis: rows of least -ln(u) / weight; rows of weight 0 never."""
    some = rows.where(F.col(weight) > 0).select("row_id", F.col(weight).cast("double").alias("w"))
    u = uniform(seed, "bag", F.col("tree_id"), F.col("row_id"))
    key = -F.log(F.greatest(u, F.lit(2.0**-54))) / F.col("w")
    scale = some.agg(F.max("w")).first()[0] or 1.0
    # 1 - exp(-key * max w) grows with key: a place in [0, 1) for the bins; the key itself breaks ties
    each = _each_tree(some, n_tree, first_tree).withColumn("key", key).withColumn("u", F.least(-F.expm1(-F.col("key") * scale), F.lit(1 - 2.0**-53)))
    return lowest(each, ["tree_id"], "u", n_samp, tie="key").select("tree_id", "row_id", F.lit(1).cast("long").alias("s_count"))


def bag_weighted_with(rows: DataFrame, weight: str, n_tree: int, n_samp: int, seed: int = 0, first_tree: int = 0) -> DataFrame:
    """Draws fall on the line of summed weights; each is joined to its row by a cell of the line (P5)."""
    index = numbered(rows.where(F.col(weight) > 0).select("row_id", F.col(weight).cast("double").alias("w")), ["row_id"])
    total, n = index.agg(F.sum("w"), F.count(F.lit(1))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "tree_id int, row_id long, s_count long")
    blocks = index.withColumn("b", F.shiftright("i", 12))
    sums = written(blocks.groupBy("b").agg(F.sum("w").alias("bw")).withColumn("s", F.shiftright("b", 12)), "weight-blocks")
    # offsets on two levels: one row for 16.7 million rows passes the window without partitions
    until = lambda w: F.coalesce(F.sum("bw").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    tops = sums.groupBy("s").agg(F.sum("bw").alias("bw")).select("s", until(W.orderBy("s")).alias("top"))
    before = sums.withColumn("inner", until(W.partitionBy("s").orderBy("b"))).join(tops, "s").select("b", (F.col("top") + F.col("inner")).alias("base"))
    line = blocks.join(small(written(before, "weight-offsets"), 32), "b").withColumn("high", F.col("base") + F.sum("w").over(W.partitionBy("b").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    line = line.withColumn("low", F.col("high") - F.col("w"))
    cell = lambda x: F.floor(x / F.lit(total / n))
    # a heavy row covers many cells: it falls into stretches, spread over tasks, before those unfold
    first, last = cell(F.col("low")), cell(F.col("high"))
    parts = line.select("row_id", "low", "high", first.alias("c0"), last.alias("c1"), F.explode(F.sequence(F.shiftright(first, 16), F.shiftright(last, 16))).alias("part"))
    heavy = F.col("c1") - F.col("c0") >= 1 << 16
    own = F.sequence(F.greatest("c0", F.shiftleft("part", 16)), F.least("c1", F.shiftleft("part", 16) + 65535))
    spread = parts.where(~heavy).unionByName(parts.where(heavy).repartition("part"))
    cells = spread.select("row_id", "low", "high", F.explode(own).alias("cell"))
    at = draws(rows.sparkSession, n_tree, n_samp, seed, first_tree).withColumn("at", F.col("u") * total).withColumn("cell", cell(F.col("at")))
    return at.join(cells, "cell").where("at >= low AND at < high").groupBy("tree_id", "row_id").agg(F.count(F.lit(1)).alias("s_count"))


def bag(rows: DataFrame, n_tree: int, n_samp: int = 0, with_repl: bool = True, weight: str | None = None, seed: int = 0, first_tree: int = 0) -> DataFrame:
    """The bag of a forest, by the kind of sampling."""
    n = sample_count(rows.count(), n_samp, with_repl)
    if weight is not None:
        return (bag_weighted_with if with_repl else bag_weighted_without)(rows, weight, n_tree, n, seed, first_tree)
    return (bag_with_replacement if with_repl else bag_without_replacement)(rows, n_tree, n, seed, first_tree)


def bag_hash(bag_: DataFrame) -> str:
    """A digest of the bag that does not depend on row order: sums of two parts of each row's md5, and the rows."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("tree_id", "row_id", "s_count")]))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return "-".join(map(str, bag_.agg(part(1), part(13), F.count(F.lit(1))).first()))


def out_of_bag(rows: DataFrame, bag_: DataFrame, n_tree: int, first_tree: int = 0) -> DataFrame:
    """tree_id, row_id of pairs that the bag lacks."""
    return _each_tree(rows.select("row_id"), n_tree, first_tree).join(bag_.select("tree_id", "row_id"), ["tree_id", "row_id"], "left_anti")


def permuted(rows: DataFrame, seed: int = 0) -> DataFrame:
    """row_id, from_id: each row's partner in a random permutation."""
    a = numbered(rows.select("row_id"), ["row_id"])
    b = numbered(rows.select(F.col("row_id").alias("from_id"), uniform(seed, "permute", F.col("row_id")).alias("u")), ["u", "from_id"]).drop("u")
    return a.join(b, "i").select("row_id", "from_id")


# ---- predictors


def default_candidates(p: int, classification: bool) -> tuple[int, float]:
    """(predFixed, predProb) where the user gives neither."""
    if p >= 16:
        return 0, math.ceil(math.sqrt(p)) / p if classification else 0.4
    return max(1, math.isqrt(p) if classification else p // 3), 0.0


def probabilities(p: int, prob: float, weights: list[float] | None = None) -> list[float]:
    """Bernoulli probability of each predictor: prob at weight one, in proportion to weight."""
    w = weights or [1.0] * p
    total = sum(w)
    return [x * p * prob / total for x in w]


def _pairs(nodes: DataFrame, p: int) -> DataFrame:
    return nodes.select("tree_id", "node_id", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("pred_id"))


def candidates_bernoulli(nodes: DataFrame, probs: list[float], seed: int = 0) -> DataFrame:
    """tree_id, node_id, pred_id that pass their own coin."""
    prob = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("pred_id") + 1)
    return _pairs(nodes, len(probs)).where(uniform(seed, "mtry", F.col("tree_id"), F.col("node_id"), F.col("pred_id")) < prob)


def candidates_fixed(nodes: DataFrame, p: int, m: int, seed: int = 0) -> DataFrame:
    """m predictors of least hash for each node (P15); the window is over p rows of a node."""
    u = uniform(seed, "mtry", F.col("tree_id"), F.col("node_id"), F.col("pred_id"))
    return _pairs(nodes, p).withColumn("u", u).withColumn("r", F.row_number().over(W.partitionBy("tree_id", "node_id").orderBy("u", "pred_id"))).where(F.col("r") <= m).drop("u", "r")


def candidates(nodes: DataFrame, p: int, pred_fixed: int, probs: list[float], seed: int = 0) -> DataFrame:
    """By Bernoulli iff pred_fixed is 0 (P17); all predictors for pred_fixed >= p."""
    if pred_fixed == 0:
        return candidates_bernoulli(nodes, probs, seed)
    return _pairs(nodes, p) if pred_fixed >= p else candidates_fixed(nodes, p, pred_fixed, seed)

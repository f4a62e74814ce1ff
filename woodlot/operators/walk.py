"""Tree walking and the combination of trees.

nodes: tree_id, node_id (heap numbers: root 1, children 2i and 2i + 1), pred_id, kind, cut, true_codes,
observed_codes, na_left, left_id, right_id, score, ... A walk is one join for each level, with the splits of that level alone (a node's heap
number tells its level): they are broadcast within a counted bound, so the few splits of the upper levels,
where all rows share a node, always are; larger levels shuffle on (tree_id, node_id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import BROADCAST_BYTES, small
from .scores import plurality


#: A split's size as a row of a broadcast table, with room for some lists of codes.
SPLIT_BYTES = 200


def goes_left(x: Column) -> Column:
    """Branch of a value at a node's columns (F1-F3): a missing number follows na_left, a code outside true_codes goes right."""
    number = F.when(x.isNull(), F.col("na_left")).otherwise(x <= F.col("cut"))
    code = F.coalesce(F.array_contains("true_codes", x.cast("int")), F.lit(False))
    return F.when(F.col("kind") == "factor", code).otherwise(number)


def trapped(x: Column) -> Column:
    """Whether a value stops here: missing, or a code that the node did not see in training."""
    return x.isNull() | ((F.col("kind") == "factor") & ~F.coalesce(F.array_contains("observed_codes", x.cast("int")), F.lit(False)))


def walk(encoded: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None, trap: bool = False, depth: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, tree_id, node_id and the kept columns: the last node of each row in each tree.

    pairs: (row_id, tree_id) to walk, as out-of-bag pairs; else every row walks every tree (J4).
    """
    trees = nodes.select("tree_id").distinct()
    held = ["row_id", "x", *(c for c in keep if c != "x")]
    at = encoded.select(*held).join(pairs.select("row_id", "tree_id"), "row_id") if pairs is not None else encoded.select(*held).crossJoin(F.broadcast(trees))
    at = at.withColumn("node_id", F.lit(1).cast("long"))
    splits = nodes.where("left_id IS NOT NULL").select("tree_id", "node_id", "pred_id", "kind", "cut", "true_codes", "observed_codes", "na_left", "left_id", "right_id", (F.length(F.bin("node_id")) - 1).alias("level"))
    sizes = {r[0]: r[1] for r in splits.groupBy("level").count().collect()}  # a row for each level, 62 at most
    for level in range(max(sizes, default=-1) + 1 if depth is None else depth):
        own = splits.where(F.col("level") == level).drop("level")
        own = F.broadcast(own) if sizes.get(level, 0) * SPLIT_BYTES <= BROADCAST_BYTES else own
        x = F.try_element_at("x", F.col("pred_id") + 1)
        stop = F.col("pred_id").isNull() | (trapped(x) if trap else F.lit(False))
        step = at.join(own, ["tree_id", "node_id"], "left")
        at = step.select(*held, "tree_id", F.when(stop, F.col("node_id")).when(goes_left(x), F.col("left_id")).otherwise(F.col("right_id")).alias("node_id"))
    return at.select("row_id", "tree_id", "node_id", *keep)


class FlatTree:
    """A tree as arrays: place of each child, predictor (-1 at a leaf), cut, and (place, code) keys of the lists of codes."""

    def __init__(self, t: pd.DataFrame):
        t = t.sort_values("node_id")
        self.node = t["node_id"].to_numpy(np.int64)
        inner = t["left_id"].notna().to_numpy()
        child = lambda c: np.searchsorted(self.node, np.where(inner, t[c].to_numpy(float), self.node).astype(np.int64))
        self.left, self.right = child("left_id"), child("right_id")
        self.pred = np.where(inner, t["pred_id"].to_numpy(float), -1).astype(np.int64)
        self.factor = (t["kind"] == "factor").to_numpy()
        self.cut = t["cut"].to_numpy(float)
        self.na_left = np.array([bool(v) for v in t["na_left"]])
        lists = {c: [list(v) if ok and f else [] for v, ok, f in zip(t[c], inner, self.factor)] for c in ("true_codes", "observed_codes")}
        self.width = 1 + max((int(k) for rows in lists.values() for v in rows for k in v), default=0)
        keys = {c: np.array([i * self.width + int(k) for i, v in enumerate(rows) for k in v], np.int64) for c, rows in lists.items()}
        self.true, self.seen = keys["true_codes"], keys["observed_codes"]

    def walk(self, x: np.ndarray, trap: bool) -> np.ndarray:
        """Last node of each row."""
        at = np.full(len(x), np.searchsorted(self.node, 1))
        live = np.flatnonzero(self.pred[at] >= 0)
        while len(live):
            here = at[live]
            v = x[live, self.pred[here]]
            gone, factor = np.isnan(v), self.factor[here]
            code = np.where(gone, -1, v).astype(np.int64)
            key = np.where((code >= 0) & (code < self.width), here * self.width + code, -1)
            left = np.where(factor, np.isin(key, self.true), np.where(gone, self.na_left[here], v <= self.cut[here]))
            if trap:
                go = ~(gone | factor & ~np.isin(key, self.seen))
                live, here, left = live[go], here[go], left[go]
            at[live] = np.where(left, self.left[here], self.right[here])
            live = live[self.pred[at[live]] >= 0]
        return self.node[at]


def walk_blocks(encoded: DataFrame, nodes: DataFrame, trap: bool = False) -> DataFrame:
    """As walk over all trees, by flat arrays in each worker, a block of rows at a time.

    The trees are sent whole only if their counted nodes are within the bound of a broadcast; beyond it the
    joins of `walk` do the work.
    """
    if nodes.count() * SPLIT_BYTES > BROADCAST_BYTES:
        return walk(encoded, nodes, trap=trap)
    table = nodes.select("tree_id", "node_id", "pred_id", "kind", "cut", "true_codes", "observed_codes", "na_left", "left_id", "right_id").toPandas()
    shared = encoded.sparkSession.sparkContext.broadcast({int(t): FlatTree(g) for t, g in table.groupby("tree_id")})

    def run(blocks):
        for b in blocks:
            x = np.array(b["x"].tolist(), dtype=float).reshape(len(b), -1)
            for tree, flat in shared.value.items():
                yield pd.DataFrame({"row_id": b["row_id"].to_numpy(), "tree_id": tree, "node_id": flat.walk(x, trap)})

    return encoded.select("row_id", "x").mapInPandas(run, "row_id long, tree_id int, node_id long")


def scored(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    return walked.join(small(nodes.select("tree_id", "node_id", "score")), ["tree_id", "node_id"])


def predict_mean(rows: DataFrame, scores: DataFrame, base: float) -> DataFrame:
    """Mean over the trees that took part; the training mean without any (R2)."""
    got = scores.groupBy("row_id").agg(F.avg("score").alias("p"))
    return rows.select("row_id").join(got, "row_id", "left").select("row_id", F.coalesce("p", F.lit(float(base))).alias("y_pred"))


def predict_sum(rows: DataFrame, scores: DataFrame, base: float, nu: float) -> DataFrame:
    """base + nu * sum of scores."""
    got = scores.groupBy("row_id").agg(F.sum("score").alias("p"))
    return rows.select("row_id").join(got, "row_id", "left").select("row_id", (F.lit(float(base)) + F.lit(float(nu)) * F.coalesce("p", F.lit(0.0))).alias("y_pred"))


def predict_logistic(rows: DataFrame, scores: DataFrame, base: float, nu: float) -> DataFrame:
    """Probability of class 1 by the logistic function of the sum; class 1 iff above 0.5."""
    total = predict_sum(rows, scores, base, nu)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("y_pred")))
    return total.select("row_id", prob.alias("prob"), F.when(prob > 0.5, 1).otherwise(0).alias("ctg"))


def census(scores: DataFrame) -> DataFrame:
    """row_id, ctg, votes (R6); a score's class is its whole part."""
    return scores.groupBy("row_id", F.floor("score").cast("int").alias("ctg")).agg(F.count(F.lit(1)).alias("votes"))


def predict_plurality(rows: DataFrame, votes: DataFrame, modal: int, seed: int = 0) -> DataFrame:
    """Class of most votes; ties by hash; the modal class without votes."""
    best = plurality(votes, ["row_id"], "ctg", "votes", seed)
    return rows.select("row_id").join(best, "row_id", "left").select("row_id", F.coalesce("ctg", F.lit(modal)).alias("ctg"))


def probabilities(rows: DataFrame, votes: DataFrame, frequencies: list[float]) -> DataFrame:
    """row_id, ctg, prob: votes over all votes of the row; class frequencies without any."""
    total = votes.groupBy("row_id").agg(F.sum("votes").alias("total"))
    each = rows.select("row_id", F.posexplode(F.array(*[F.lit(float(f)) for f in frequencies])).alias("ctg", "f"))
    out = each.join(votes, ["row_id", "ctg"], "left").join(total, "row_id", "left")
    return out.select("row_id", "ctg", F.when(F.col("total").isNull(), F.col("f")).otherwise(F.coalesce("votes", F.lit(0)) / F.col("total")).alias("prob"))


def dominated(walked: DataFrame, leaves: DataFrame) -> DataFrame:
    """row_id, tree_id, node_id (leaf): the leaves under each row's last node; a leaf is its own.

    Heap numbers make ancestors shifts: each leaf lists its few ancestors, and the join is by equality.
    """
    depth = F.floor(F.log2(F.col("leaf_id").cast("double"))).cast("int")
    up = leaves.select("tree_id", F.col("node_id").alias("leaf_id")).select("tree_id", "leaf_id", F.explode(F.sequence(F.lit(0), depth)).alias("k"))
    up = up.select("tree_id", "leaf_id", F.expr("shiftright(leaf_id, k)").alias("node_id"))
    return walked.join(small(up), ["tree_id", "node_id"]).select("row_id", "tree_id", F.col("leaf_id").alias("node_id"))

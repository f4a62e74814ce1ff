"""Split scoring.

Input is a histogram: one row for each (tree_id, node_id, pred_id, x) of a candidate, with n = sum of
multiplicities, s = sum of y over them, and for classification c0, c1, ... = summed class weights. It is
combined on the map side, and a node's windows run over its distinct values, not its rows. Missing values
are left out of a candidate's totals (F8). A split row says which side is true (left): x <= cut, or
x in true_codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import small, written
from ..functions.uniform import coin, uniform

CELL = ["tree_id", "node_id", "pred_id"]
MAX_RUNS = 10
#: A histogram of more rows than these is scanned in ranges, since one cell may hold most of it.
CELL_ROWS = 1 << 20


def classes(n_ctg: int) -> list[str]:
    return [f"c{k}" for k in range(n_ctg)]


def histogram(staged: DataFrame, n_ctg: int = 0) -> DataFrame:
    """From rows (CELL, x, s_count, y[, ctg, w]) to distinct values."""
    sums = [F.sum("s_count").alias("n"), F.sum(F.col("y") * F.col("s_count")).alias("s")]
    sums += [F.sum(F.when(F.col("ctg") == k, F.col("y") * F.col("s_count")).otherwise(0.0)).alias(c) for k, c in enumerate(classes(n_ctg))]
    return staged.where("x IS NOT NULL").groupBy(*CELL, "x").agg(*sums)


def squares(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c * c for c in columns])


def _scan(hist: DataFrame, order: list[Column], n_ctg: int) -> DataFrame:
    """Prefix sums (l*) and totals (t*) of each cell in the order."""
    up = W.partitionBy(*CELL).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*CELL)
    out = {}
    for c in ["n", "s", *classes(n_ctg)]:
        out["l" + c], out["t" + c] = F.sum(c).over(up), F.sum(c).over(whole)
    return hist.withColumns(out)


def _scan_ranges(hist: DataFrame, n_ctg: int) -> DataFrame:
    """As _scan in the order of x, and x_right: ranges of (cell, x) add up side by side, and each starts from the
    sums of a cell's ranges before it, so no task sees a large cell whole."""
    sums = ["n", "s", *classes(n_ctg)]
    tag = written(hist.repartitionByRange(*CELL, "x").withColumn("part", F.spark_partition_id()), "ranges")
    parts = tag.groupBy(*CELL, "part").agg(F.min("x").alias("first"), *[F.sum(c).alias(c) for c in sums])
    cell = W.partitionBy(*CELL).orderBy("part")
    before = {f"b{c}": F.coalesce(F.sum(c).over(cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    totals = {f"t{c}": F.sum(c).over(W.partitionBy(*CELL)) for c in sums}
    base = written(parts.withColumns(before | totals | {"next": F.lead("first").over(cell)}).drop("first", *sums), "range-sums")
    own = W.partitionBy(*CELL, "part").orderBy("x")
    run = {f"l{c}": F.sum(c).over(own.rowsBetween(W.unboundedPreceding, 0)) for c in sums} | {"right": F.lead("x").over(own)}
    out = tag.withColumns(run).join(small(base, 48 + 16 * len(sums)), [*CELL, "part"])
    out = out.withColumns({f"l{c}": F.col(f"l{c}") + F.col(f"b{c}") for c in sums} | {"x_right": F.coalesce("right", "next")})
    return out.drop("part", "right", "next", *[f"b{c}" for c in sums])


def info(n_ctg: int) -> tuple[Column, Column]:
    """(info of the two sides, gain over the whole) from l* and t* columns: variance (A3) or Gini (A4).

    With class weights a side weighs the sum of its weights, s.
    """
    if n_ctg == 0:
        ln, rn, ls, rs = F.col("ln"), F.col("tn") - F.col("ln"), F.col("ls"), F.col("ts") - F.col("ls")
        both = F.try_divide(ls * ls, ln) + F.try_divide(rs * rs, rn)
        return both, both - F.try_divide(F.col("ts") * F.col("ts"), F.col("tn"))
    l, t = [F.col("l" + c) for c in classes(n_ctg)], [F.col("t" + c) for c in classes(n_ctg)]
    both = F.try_divide(squares(l), F.col("ls")) + F.try_divide(squares([b - a for a, b in zip(l, t)]), F.col("ts") - F.col("ls"))
    return both, both - F.try_divide(squares(t), F.col("ts"))


def best_cut(scored: DataFrame, order: list[Column]) -> DataFrame:
    """The row of greatest gain of each cell."""
    r = F.row_number().over(W.partitionBy(*CELL).orderBy(F.desc("gain"), *order))
    return scored.withColumn("r", r).where("r = 1").drop("r")


def numeric_splits(hist: DataFrame, n_ctg: int = 0, mono: dict[int, float] | None = None, seed: int = 0, ranges: bool = False) -> DataFrame:
    """CELL, gain, x_left, x_right, ln, tn: the best cut between two distinct values; of equals the rightmost.

    ranges: for a histogram, written, with more values in a cell than a task should scan.
    """
    if ranges:
        s = _scan_ranges(hist, n_ctg)
    else:
        s = _scan(hist, [F.col("x")], n_ctg).withColumn("x_right", F.lead("x").over(W.partitionBy(*CELL).orderBy("x")))
    s = s.where("x_right IS NOT NULL").withColumn("gain", info(n_ctg)[1])
    if mono and n_ctg == 0:
        sign = F.lit(0)
        for p, v in mono.items():
            sign = F.when((F.col("pred_id") == p) & (uniform(seed, "mono", *map(F.col, CELL)) < abs(v)), F.lit(1 if v > 0 else -1)).otherwise(sign)
        step = F.try_divide(F.col("ts") - F.col("ls"), F.col("tn") - F.col("ln")) - F.try_divide(F.col("ls"), F.col("ln"))
        s = s.where(step * sign >= 0)
    if ranges:
        best = s.where("gain IS NOT NULL").groupBy(*CELL).agg(F.max(F.struct("gain", F.col("x").alias("x_left"), "x_right", "ln", "tn")).alias("m"))
        return best.select(*CELL, "m.*")
    return best_cut(s.where("gain IS NOT NULL"), [F.desc("x")]).select(*CELL, "gain", F.col("x").alias("x_left"), "x_right", "ln", "tn")


def _codes(hist: DataFrame, scored: DataFrame, order: list[Column], best_by: list[Column]) -> DataFrame:
    """The best prefix of runs as lists of codes."""
    place = F.row_number().over(W.partitionBy(*CELL).orderBy(*order))
    best = best_cut(scored.where("gain IS NOT NULL"), best_by).select(*CELL, "gain", "k", "ln", "tn")
    runs = hist.withColumn("k0", place).join(best, CELL)
    code = F.col("x").cast("int")
    return runs.groupBy(*CELL, "gain", "ln", "tn").agg(F.sort_array(F.collect_list(F.when(F.col("k0") <= F.col("k"), code))).alias("true_codes"), F.sort_array(F.collect_list(code)).alias("observed_codes"))


def prefix_factor_splits(hist: DataFrame, n_ctg: int = 0) -> DataFrame:
    """CELL, gain, ln, tn, true_codes, observed_codes: runs in order of mean (A9) or of P(class 1) (A10), best prefix."""
    score = F.try_divide(F.col("s"), F.col("n")) if n_ctg == 0 else F.try_divide(F.col("c1"), F.col("s"))
    order = [score.asc(), F.col("x").asc()]
    s = _scan(hist, order, n_ctg).withColumns({"k": F.row_number().over(W.partitionBy(*CELL).orderBy(*order)), "m": F.count(F.lit(1)).over(W.partitionBy(*CELL))})
    return _codes(hist, s.where("k < m").withColumn("gain", info(n_ctg)[1]), order, [F.col("k").asc()])


def sampled_runs(hist: DataFrame, seed: int = 0, most: int = MAX_RUNS) -> DataFrame:
    """At most `most` runs of each cell, by hash (A12); the others fall to the false side."""
    u = uniform(seed, "runs", *map(F.col, CELL), F.col("x").cast("int"))
    return hist.withColumn("u", u).withColumn("r", F.row_number().over(W.partitionBy(*CELL).orderBy("u", "x"))).where(F.col("r") <= most).drop("u", "r")


def subset_splits(hist: DataFrame, n_ctg: int, seed: int = 0) -> DataFrame:
    """As prefix_factor_splits for three or more classes: every subset of up to ten runs, up to complement.

    The runs of a cell are one array of at most ten structs, so masks unfold inside a row, without a join.
    """
    cs = classes(n_ctg)
    cells = sampled_runs(hist, seed).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("x", "n", "s", *cs))).alias("runs")).where(F.size("runs") > 1)
    masks = cells.withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("runs") - 1).cast("int") - 1)))
    total = lambda c: F.aggregate("runs", F.lit(0.0), lambda a, r: a + r[c])
    part = lambda c: F.aggregate(F.filter("runs", lambda r, i: _bit(i)), F.lit(0.0), lambda a, r: a + r[c])
    s = masks.withColumns({"l" + c: part(c) for c in ["n", "s", *cs]} | {"t" + c: total(c) for c in ["n", "s", *cs]}).withColumn("gain", info(n_ctg)[1])
    best = best_cut(s.where("gain IS NOT NULL"), [F.col("mask").asc()])
    code = lambda r: r["x"].cast("int")
    return best.select(*CELL, "gain", F.col("ln").cast("long").alias("ln"), F.col("tn").cast("long").alias("tn"), F.transform(F.filter("runs", lambda r, i: _bit(i)), code).alias("true_codes"), F.transform("runs", code).alias("observed_codes"))


def _bit(i: Column) -> Column:
    return F.expr("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) > 0


def flipped(splits: DataFrame, seed: int = 0) -> DataFrame:
    """Factor splits whose true side is, by coin, the argmax subset or its complement."""
    turn = coin(seed, "flip", *map(F.col, CELL))
    return splits.withColumn("true_codes", F.when(turn, F.array_except("observed_codes", "true_codes")).otherwise(F.col("true_codes")))


def interpolated(cuts: DataFrame, values: DataFrame, split_quant: float = 0.5, hint=lambda df: df) -> DataFrame:
    """cuts with `cut`: the value at rank_left + split_quant * (rank_right - rank_left) of the whole frame's
    ranks, linear between the values at the ranks around it (W3). hint marks the cuts, which are fewer than values."""
    at = lambda x, rank, value: values.select(F.col("pred_id").alias("pred_id"), F.col("rank").alias(rank), F.col("x").alias(value)).withColumn(x, F.col(value))
    left = hint(hint(cuts).join(at("x_left", "rank_l", "v_l").drop("v_l"), ["pred_id", "x_left"])).join(at("x_right", "rank_r", "v_r").drop("v_r"), ["pred_id", "x_right"])
    r = left.withColumn("r", F.col("rank_l") + F.lit(split_quant) * (F.col("rank_r") - F.col("rank_l"))).withColumns({"r0": F.floor("r"), "r1": F.ceil("r")})
    low = values.select("pred_id", F.col("rank").alias("r0"), F.col("x").alias("v0"))
    high = values.select("pred_id", F.col("rank").alias("r1"), F.col("x").alias("v1"))
    out = hint(hint(r).join(low, ["pred_id", "r0"])).join(high, ["pred_id", "r1"])
    return out.withColumn("cut", F.col("v0") + (F.col("r") - F.col("r0")) * (F.col("v1") - F.col("v0"))).drop("rank_l", "rank_r", "r", "r0", "r1", "v0", "v1")


def node_best(splits: DataFrame, seed: int = 0) -> DataFrame:
    """The best candidate of each node; of equals that of greater hash."""
    u = uniform(seed, "tie", *map(F.col, CELL))
    r = F.row_number().over(W.partitionBy("tree_id", "node_id").orderBy(F.desc("gain"), F.desc("u"), "pred_id"))
    return splits.withColumn("u", u).withColumn("r", r).where("r = 1").drop("u", "r")


def informative(best: DataFrame, nodes: DataFrame) -> DataFrame:
    """Splits whose gain passes the least their node allows: a share of the parent's gain."""
    return best.join(nodes.select("tree_id", "node_id", "min_info"), ["tree_id", "node_id"]).where("gain > min_info")

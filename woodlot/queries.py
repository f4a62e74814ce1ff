"""Queries over the operators, and the SQL that must give the same rows.

Names follow SURVEY 2 (the operators' numbers stand in OPERATORS). Responses are whole numbers, so sums are
exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.storage import shared_path, written
from .functions.uniform import sql_uniform
from .operators import export, quantiles, sampling, scores, splits, validate, walk
from .plans import model as M
from .plans.config import Options
from .plans.grow import NODE_SCHEMA, prune
from .sources import encode as E

SEED = 7
QUERIES: dict = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = operators
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


U = lambda *keys: sql_uniform(str(SEED), *keys)

# ---- encoding


def _part_long(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return E.long_form(E.encode(part, E.signature(part, ["p_size", "p_retailprice"]), "p_partkey"))


_PART_LONG = "(SELECT p_partkey AS row_id, 0 AS pred_id, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part)"
_PART_RANKS = f"(SELECT row_id, pred_id, x, dense_rank() OVER (PARTITION BY pred_id ORDER BY x) - 1 AS rank FROM {_PART_LONG})"


@query("S1 S2 S3 S5 S7 S9 W1 K2", f"SELECT row_id, pred_id, x, rank FROM {_PART_RANKS}")
def dense_rank_encode(spark, d):
    long = written(_part_long(spark, d), "long")
    return E.ranked(long, E.rank_values(long))


@query("S7 W1", f"SELECT DISTINCT pred_id, x, rank FROM {_PART_RANKS}")
def dense_rank_at_scale(spark, d):
    return E.rank_values_at_scale(_part_long(spark, d)).select("pred_id", "x", "rank")


_RUNS = f"(SELECT pred_id, rank, min(row_id) AS row, count(*) AS extent FROM (SELECT *, row_id - row_number() OVER (PARTITION BY pred_id, rank ORDER BY row_id) AS g FROM {_PART_RANKS}) GROUP BY pred_id, rank, g)"


@query("S8 S9", f"SELECT * FROM {_RUNS}")
def rle_encode(spark, d):
    return E.runs(dense_rank_encode(spark, d))


@query("S10", f"SELECT * FROM {_RUNS}")
def rle_stored(spark, d):
    return written(rle_encode(spark, d), "runs")


@query("S11", f"SELECT row_id, pred_id, rank FROM {_PART_RANKS}")
def rle_decode(spark, d):
    return E.decode_runs(rle_encode(spark, d)).select("row_id", "pred_id", "rank")


@query("S12", f"""SELECT pred_id, count(*) AS n_ranks, arg_max(rank, n * 1000000000 - rank) AS mode_rank, max(n) AS mode_count, CAST(0 AS BIGINT) AS n_missing, max(n) > sum(n) * 0.25 AS dense
FROM (SELECT pred_id, rank, count(*) AS n FROM {_PART_RANKS} GROUP BY ALL) GROUP BY pred_id""")
def mode_rank_survey(spark, d):
    return E.survey(dense_rank_encode(spark, d))


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("S4 S13 S14 F3", f"SELECT o_orderkey AS row_id, CAST(coalesce(list_position({_LEVELS}, o_orderpriority) - 1, {len(_LEVELS)}) AS DOUBLE) AS code FROM orders")
def level_reconcile(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), E.factor_code(F.col("o_orderpriority"), _LEVELS).alias("code"))


@query("S13", """SELECT * FROM (VALUES (0, 'p_size', 'numeric', CAST(0 AS BIGINT)), (1, 'p_retailprice', 'numeric', 0)) t(pred_id, name, form, n_levels)
UNION ALL SELECT 2, 'p_brand', 'factor', count(DISTINCT p_brand) FROM part UNION ALL SELECT 3, 'p_type', 'factor', count(DISTINCT p_type) FROM part""")
def frame_signature(spark, d):
    sig = E.signature(table(spark, d, "part"), ["p_size", "p_retailprice", "p_brand", "p_type"])
    return spark.createDataFrame([(i, n, f, len(sig.levels.get(n, []))) for i, (n, f) in enumerate(zip(sig.names, sig.forms))], "pred_id int, name string, form string, n_levels long")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("S6", f"""SELECT c_custkey AS row_id, p AS pred_id, CASE WHEN list_position({_SEGMENTS}, c_mktsegment) - 1 = p THEN c_acctbal ELSE 0.0 END AS x
FROM customer, (SELECT unnest(range(0, {len(_SEGMENTS)})) AS p)""")
def sparse_frame(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.array_position(F.array(*map(F.lit, _SEGMENTS)), F.col("c_mktsegment")) - 1).cast("int").alias("pred_id"), F.col("c_acctbal").alias("x"))
    return E.long_form(E.sparse(c.where("pred_id >= 0"), c, len(_SEGMENTS)))


# ---- sampling

TREES = 4


def _rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") % 5).cast("double").alias("w"))


_N = "(SELECT count(*) FROM customer)"
_TREE = f"(SELECT CAST(unnest(range(0, {TREES})) AS INTEGER) AS tree_id)"
_BAG_U = U("'bag'", "tree_id", "row_id")
_CUST = "(SELECT c_custkey AS row_id, CAST(c_nationkey % 5 AS DOUBLE) AS w FROM customer)"


@query("P1 P2 P3 P7 P9", f"""WITH i AS (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
k AS (SELECT tree_id, draw FROM {_TREE}, (SELECT unnest(range(0, {_N})) AS draw)),
p AS (SELECT tree_id, CAST(floor({U("'bag'", "tree_id", "draw")} * {_N}) AS BIGINT) AS i FROM k)
SELECT tree_id, row_id, count(*) AS s_count FROM p JOIN i USING (i) GROUP BY tree_id, row_id""")
def bag_with_replacement(spark, d):
    return sampling.bag(_rows(spark, d), TREES, seed=SEED)


_W = "CAST(round((1 - exp(-1)) * (SELECT count(*) FROM customer)) AS BIGINT)"


@query("P2 P4 P7", f"SELECT tree_id, row_id, CAST(1 AS BIGINT) AS s_count FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY {_BAG_U}, row_id) AS r FROM {_CUST}, {_TREE}) WHERE r <= {_W}")
def bag_without_replacement(spark, d):
    return sampling.bag(_rows(spark, d), TREES, with_repl=False, seed=SEED)


@query("P6", f"SELECT tree_id, row_id, CAST(1 AS BIGINT) AS s_count FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY -ln(greatest({_BAG_U}, power(CAST(2 AS DOUBLE), -54))) / w) AS r FROM {_CUST}, {_TREE} WHERE w > 0) WHERE r <= {_W} // 2")
def bag_weighted_without(spark, d):
    rows = _rows(spark, d)
    return sampling.bag_weighted_without(rows, "w", TREES, sampling.sample_count(rows.count(), 0, False) // 2, SEED)


@query("P5", f"""WITH c AS (SELECT row_id, w, sum(w) OVER (ORDER BY row_id) AS high FROM {_CUST} WHERE w > 0),
k AS (SELECT tree_id, draw, {U("'bag'", "tree_id", "draw")} * (SELECT sum(w) FROM c) AS spot FROM {_TREE}, (SELECT unnest(range(0, {_N})) AS draw))
SELECT tree_id, row_id, count(*) AS s_count FROM k JOIN c ON spot >= high - w AND spot < high GROUP BY tree_id, row_id""")
def bag_weighted_with(spark, d):
    rows = _rows(spark, d)
    return sampling.bag_weighted_with(rows, "w", TREES, rows.count(), SEED)


@query("P8 K1", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {U(chr(39) + 'holdout' + chr(39), 'row_id')}, row_id) AS r FROM {_CUST}) WHERE r <= 100")
def holdout_rows(spark, d):
    return sampling.holdout(_rows(spark, d), 100, SEED)


@query("P11 F7 J7", f"SELECT tree_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY {_BAG_U}, row_id) AS r FROM {_CUST}, {_TREE}) WHERE r > {_W}")
def oob_filter(spark, d):
    rows = _rows(spark, d)
    return sampling.out_of_bag(rows, bag_without_replacement(spark, d), TREES).select("tree_id", "row_id")


_BAG_MD5 = "md5(concat_ws('|', tree_id, row_id, 1))"


@query("P12", f"SELECT concat_ws('-', sum(CAST('0x' || substr({_BAG_MD5}, 1, 12) AS BIGINT)), sum(CAST('0x' || substr({_BAG_MD5}, 13, 12) AS BIGINT)), count(*)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY {_BAG_U}, row_id) AS r FROM {_CUST}, {_TREE}) WHERE r <= {_W}")
def bag_digest(spark, d):
    return spark.createDataFrame([(sampling.bag_hash(bag_without_replacement(spark, d)),)], "digest string")


@query("P13", f"""SELECT a.row_id, b.row_id AS from_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i FROM {_CUST}) a
JOIN (SELECT row_id, row_number() OVER (ORDER BY {U(chr(39) + 'permute' + chr(39), 'row_id')}, row_id) AS i FROM {_CUST}) b USING (i)""")
def permutation(spark, d):
    return sampling.permuted(_rows(spark, d), SEED)


_NODES_OF = f"(SELECT tree_id, CAST(c_nationkey + 1 AS BIGINT) AS node_id FROM (SELECT DISTINCT c_nationkey FROM customer), {_TREE})"


def _some_nodes(spark, d):
    return table(spark, d, "customer").select((F.col("c_nationkey") + 1).cast("long").alias("node_id")).distinct().withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))


_MTRY = U("'mtry'", "tree_id", "node_id", "pred_id")


@query("P15 P17", f"SELECT tree_id, node_id, pred_id FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY {_MTRY}, pred_id) AS r FROM {_NODES_OF}, (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS pred_id)) WHERE r <= 3")
def mtry_fixed(spark, d):
    return sampling.candidates(_some_nodes(spark, d), 9, sampling.default_candidates(9, True)[0], [], SEED)


@query("P14 P17 P18", f"SELECT tree_id, node_id, pred_id FROM {_NODES_OF}, (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS pred_id) WHERE {_MTRY} < (pred_id % 4 + 1) * 20 * CAST(0.25 AS DOUBLE) / 50")
def mtry_bernoulli(spark, d):
    probs = sampling.probabilities(20, sampling.default_candidates(20, True)[1], [float(i % 4 + 1) for i in range(20)])
    return sampling.candidates(_some_nodes(spark, d), 20, 0, probs, SEED)


@query("P16", f"SELECT tree_id, node_id, pred_id FROM {_NODES_OF}, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS pred_id)")
def mtry_all(spark, d):
    return sampling.candidates(_some_nodes(spark, d), 3, 3, [], SEED)


# ---- splits


def _staged(df, preds: list, y, ctg=None, tree=None, node=None):
    """Root cells of one tree from columns, without row ids."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("pred_id"), p.cast("double").alias("x")) for i, p in enumerate(preds)])).alias("c")
    base = df.select((tree if tree is not None else F.lit(0)).alias("tree_id"), (node if node is not None else F.lit(1)).cast("long").alias("node_id"), F.lit(1).cast("long").alias("s_count"), y.cast("double").alias("y"), (ctg if ctg is not None else F.lit(None)).cast("int").alias("ctg"), x)
    return base.select("tree_id", "node_id", "c.pred_id", "c.x", "s_count", "y", "ctg")


def _line_hist(spark, d, ctg: bool):
    line = table(spark, d, "lineitem")
    preds = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    if ctg:
        return splits.histogram(_staged(line, preds, F.lit(1.0), F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")) - 1), 3)
    return splits.histogram(_staged(line, preds, F.round(F.col("l_extendedprice") / 100)))


_LINE = "(SELECT 0 AS pred_id, l_quantity AS x, {y} AS y FROM lineitem UNION ALL SELECT 1, l_discount, {y} FROM lineitem UNION ALL SELECT 2, l_tax, {y} FROM lineitem)"


def _reg_scan(source: str, by: str = "pred_id", order: str = "x") -> str:
    return f"""h AS (SELECT {by}, x, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM {source} GROUP BY ALL),
p AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY {by}) AS tn, sum(s) OVER (PARTITION BY {by}) AS ts, lead(x) OVER (PARTITION BY {by} ORDER BY {order}) AS x_right,
  row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM h WINDOW w AS (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM p WHERE x_right IS NOT NULL)"""


_LINE_Y = _LINE.format(y="round(l_extendedprice / 100)")


@query("A1 A3 A5 A6 A7 W2 F1 F8 T6", f"WITH {_reg_scan(_LINE_Y)} SELECT pred_id, round(gain, 3) AS gain, x AS x_left, x_right, CAST(ln AS BIGINT) AS ln, CAST(tn AS BIGINT) AS tn FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY gain DESC, x DESC) AS r FROM g) WHERE r = 1")
def split_reg_numeric(spark, d):
    return _cells(splits.numeric_splits(_line_hist(spark, d, False)), 3)


def _cells(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("gain", F.round("gain", digits)).drop("tree_id", "node_id")


@query("A2 A4 A5 W2", f"""WITH h AS (SELECT pred_id, x, CAST(count(*) AS DOUBLE) AS n, sum((y = 'A')::INT) AS c0, sum((y = 'N')::INT) AS c1, sum((y = 'R')::INT) AS c2 FROM {_LINE.format(y="l_returnflag")} GROUP BY ALL),
p AS (SELECT pred_id, x, lead(x) OVER (PARTITION BY pred_id ORDER BY x) AS x_right, {", ".join(f"CAST(sum({c}) OVER w AS DOUBLE) AS l{c}, CAST(sum({c}) OVER (PARTITION BY pred_id) AS DOUBLE) AS t{c}" for c in ("n", "c0", "c1", "c2"))} FROM h WINDOW w AS (PARTITION BY pred_id ORDER BY x ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (lc0 * lc0 + lc1 * lc1 + lc2 * lc2) / ln + ((tc0 - lc0) * (tc0 - lc0) + (tc1 - lc1) * (tc1 - lc1) + (tc2 - lc2) * (tc2 - lc2)) / (tn - ln) - (tc0 * tc0 + tc1 * tc1 + tc2 * tc2) / tn AS gain FROM p WHERE x_right IS NOT NULL)
SELECT pred_id, round(gain, 6) AS gain, x AS x_left, x_right, CAST(ln AS BIGINT) AS ln, CAST(tn AS BIGINT) AS tn FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY gain DESC, x DESC) AS r FROM g) WHERE r = 1""")
def split_gini_numeric(spark, d):
    return _cells(splits.numeric_splits(_line_hist(spark, d, True), 3), 6)


@query("A14", f"WITH {_reg_scan(_LINE_Y)} SELECT pred_id, round(gain, 3) AS gain, x AS x_left, x_right, CAST(ln AS BIGINT) AS ln, CAST(tn AS BIGINT) AS tn FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY gain DESC, x DESC) AS r FROM g WHERE ((ts - ls) / (tn - ln) - ls / ln) * CASE pred_id WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END >= 0) WHERE r = 1")
def split_monotone(spark, d):
    return _cells(splits.numeric_splits(_line_hist(spark, d, False), mono={0: -1.0, 1: 1.0}, seed=SEED), 3)


@query("W3 A5", f"""WITH {_reg_scan(_LINE_Y)},
v AS (SELECT pred_id, x, dense_rank() OVER (PARTITION BY pred_id ORDER BY x) - 1 AS rank FROM (SELECT DISTINCT pred_id, x FROM h)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY gain DESC, x DESC) AS r FROM g) WHERE r = 1),
q AS (SELECT b.pred_id, b.x AS x_left, b.x_right, l.rank + CAST(0.25 AS DOUBLE) * (h.rank - l.rank) AS r FROM b JOIN v l ON l.pred_id = b.pred_id AND l.x = b.x JOIN v h ON h.pred_id = b.pred_id AND h.x = b.x_right)
SELECT q.pred_id, x_left, x_right, a.x + (r - floor(r)) * (z.x - a.x) AS cut FROM q JOIN v a ON a.pred_id = q.pred_id AND a.rank = floor(r) JOIN v z ON z.pred_id = q.pred_id AND z.rank = ceil(r)""")
def cut_interpolate(spark, d):
    hist = written(_line_hist(spark, d, False), "hist")
    values = E.rank_values(hist.select("pred_id", "x"))
    return splits.interpolated(splits.numeric_splits(hist), values, 0.25).select("pred_id", "x_left", "x_right", "cut")


def _code(column: str, levels) -> Column:
    return F.array_position(F.array(*map(F.lit, levels)), F.col(column)) - 1


def _brand(spark, d):
    part = table(spark, d, "part")
    return part, [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]


def _coded(df: DataFrame, digits: int) -> DataFrame:
    """Lists of codes as text, so that both engines compare them alike."""
    return _cells(df, digits).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("true_codes", "observed_codes")})


_BRAND = "(SELECT 0 AS pred_id, dense_rank() OVER (ORDER BY p_brand) - 1 AS x, round(p_retailprice) AS y FROM part)"


@query("A8 A9 W2", f"""WITH {_reg_scan(_BRAND, order="s / n, x")},
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, k) AS r FROM g) WHERE r = 1)
SELECT 0 AS pred_id, round(b.gain, 3) AS gain, CAST(b.ln AS BIGINT) AS ln, CAST(b.tn AS BIGINT) AS tn, string_agg(p.x, ',' ORDER BY p.x) FILTER (p.k <= b.k) AS true_codes, string_agg(p.x, ',' ORDER BY p.x) AS observed_codes FROM p, b GROUP BY b.gain, b.ln, b.tn""")
def split_reg_factor(spark, d):
    part, levels = _brand(spark, d)
    return _coded(splits.prefix_factor_splits(splits.histogram(_staged(part, [_code("p_brand", levels)], F.round("p_retailprice")))), 3)


@query("A10", """WITH h AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS x, l_linestatus FROM lineitem),
c AS (SELECT x, CAST(count(*) AS DOUBLE) AS n, CAST(sum((l_linestatus = 'F')::INT) AS DOUBLE) AS c0, CAST(sum((l_linestatus = 'O')::INT) AS DOUBLE) AS c1 FROM h GROUP BY x),
p AS (SELECT x, row_number() OVER w AS k, lead(x) OVER (ORDER BY c1 / n, x) AS nx, sum(n) OVER w AS ln, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(n) OVER () AS tn, sum(c0) OVER () AS t0, sum(c1) OVER () AS t1 FROM c WINDOW w AS (ORDER BY c1 / n, x ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (l0 * l0 + l1 * l1) / ln + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (tn - ln) - (t0 * t0 + t1 * t1) / tn AS gain FROM p WHERE nx IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, k) AS r FROM g) WHERE r = 1)
SELECT 0 AS pred_id, round(b.gain, 6) AS gain, CAST(b.ln AS BIGINT) AS ln, CAST(b.tn AS BIGINT) AS tn, string_agg(p.x, ',' ORDER BY p.x) FILTER (p.k <= b.k) AS true_codes, string_agg(p.x, ',' ORDER BY p.x) AS observed_codes FROM p, b GROUP BY b.gain, b.ln, b.tn""")
def split_binary_factor(spark, d):
    line = table(spark, d, "lineitem")
    return _coded(splits.prefix_factor_splits(splits.histogram(_staged(line, [_code("l_returnflag", "ANR")], F.lit(1.0), _code("l_linestatus", "FO")), 2), 2), 6)


def _subset_sql(source: str, classes: list[str]) -> str:
    """source: x (code), y (class name); all subsets of up to ten runs taken by hash."""
    cs = [f"c{i}" for i in range(len(classes))]
    u = U("'runs'", "0", "1", "0", "x")
    sq = lambda a: " + ".join(f"{a(c)} * {a(c)}" for c in cs)
    return f"""WITH c AS (SELECT x, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum((y = '{k}')::INT) AS DOUBLE) AS {c}" for c, k in zip(cs, classes))} FROM {source} GROUP BY x),
t AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT *, row_number() OVER (ORDER BY {u}, x) AS r FROM c) WHERE r <= 10),
a AS (SELECT count(*) AS m, sum(n) AS tn, {", ".join(f"sum({c}) AS t{c}" for c in cs)} FROM t),
k AS (SELECT unnest(range(1, (1 << (m - 1)::INT)::BIGINT)) AS mask FROM a),
l AS (SELECT mask, sum(n) AS ln, {", ".join(f"sum({c}) AS l{c}" for c in cs)} FROM k, t WHERE (mask >> i::INT) & 1 = 1 GROUP BY mask),
g AS (SELECT *, ({sq(lambda c: "l" + c)}) / ln + ({sq(lambda c: f"(t{c} - l{c})")}) / (tn - ln) - ({sq(lambda c: "t" + c)}) / tn AS gain FROM l, a),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, mask) AS r FROM g) WHERE r = 1)
SELECT 0 AS pred_id, round(gain, 6) AS gain, CAST(ln AS BIGINT) AS ln, CAST(tn AS BIGINT) AS tn, string_agg(x, ',' ORDER BY x) FILTER ((mask >> i::INT) & 1 = 1) AS true_codes, string_agg(x, ',' ORDER BY x) AS observed_codes FROM b, t GROUP BY gain, ln, tn"""


_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("A11", _subset_sql("(SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS x, o_orderstatus AS y FROM orders)", ["F", "O", "P"]))
def split_multiclass_subset(spark, d):
    o = table(spark, d, "orders")
    levels = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    return _coded(splits.subset_splits(splits.histogram(_staged(o, [_code("o_orderpriority", levels)], F.lit(1.0), _code("o_orderstatus", "FOP")), 3), 3, SEED), 6)


@query("A12", _subset_sql("(SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS x, CAST(p_size % 3 AS VARCHAR) AS y FROM part)", ["0", "1", "2"]))
def split_wide_factor(spark, d):
    part, levels = _brand(spark, d)
    return _coded(splits.subset_splits(splits.histogram(_staged(part, [_code("p_brand", levels)], F.lit(1.0), F.col("p_size") % 3), 3), 3, SEED), 6)


@query("A13", f"SELECT tree_id, node_id, CASE WHEN {U(chr(39) + 'flip' + chr(39), 'tree_id', 'node_id', '0')} < 0.5 THEN '1,2' ELSE '0' END AS true_codes FROM {_NODES_OF}")
def split_inversion(spark, d):
    s = _some_nodes(spark, d).withColumns({"pred_id": F.lit(0), "true_codes": F.array(F.lit(0)), "observed_codes": F.array(*map(F.lit, (0, 1, 2)))})
    return splits.flipped(s, SEED).select("tree_id", "node_id", F.array_join(F.col("true_codes").cast("array<string>"), ",").alias("true_codes"))


_BY_STATUS = "(SELECT CAST(list_position(['F', 'O', 'P'], o_orderstatus) AS BIGINT) AS node_id, 0 AS pred_id, CAST(o_custkey AS DOUBLE) AS x, round(o_totalprice / 1000) AS y FROM orders UNION ALL SELECT CAST(list_position(['F', 'O', 'P'], o_orderstatus) AS BIGINT), 1, CAST(month(o_orderdate) AS DOUBLE), round(o_totalprice / 1000) FROM orders)"


@query("A15 A16", f"""WITH {_reg_scan(_BY_STATUS, "node_id, pred_id")},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, pred_id ORDER BY gain DESC, x DESC) AS r FROM g) WHERE r = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, {U("'tie'", "0", "node_id", "pred_id")} DESC, pred_id) AS q FROM b) WHERE q = 1)
SELECT node_id, pred_id, round(gain, 3) AS gain, x AS x_left FROM m WHERE gain > node_id * 10""")
def node_argmax(spark, d):
    o = table(spark, d, "orders")
    hist = splits.histogram(_staged(o, [F.col("o_custkey"), F.month("o_orderdate")], F.round(F.col("o_totalprice") / 1000), node=_code("o_orderstatus", "FOP") + 1))
    nodes = spark.range(1, 4).select(F.lit(0).alias("tree_id"), F.col("id").alias("node_id"), (F.col("id") * 10.0).alias("min_info"))
    return splits.informative(splits.node_best(splits.numeric_splits(hist), SEED), nodes).select("node_id", "pred_id", F.round("gain", 3).alias("gain"), "x_left")


# ---- scores


def _assign(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.lit(0).alias("tree_id"), _code("o_orderpriority", _PRIORITY).cast("long").alias("node_id"), F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 3 + 1).cast("long").alias("s_count"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"), _code("o_orderstatus", "FOP").cast("int").alias("ctg"))


_ASSIGN = f"(SELECT 0 AS tree_id, CAST(list_position({_PRIORITY}, o_orderpriority) - 1 AS BIGINT) AS node_id, o_custkey % 3 + 1 AS s_count, floor(o_totalprice / 1000) AS y, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS ctg FROM orders)"


@query("A18 T8", f"SELECT tree_id, node_id, sum(y * s_count) / sum(s_count) AS score FROM {_ASSIGN} GROUP BY ALL")
def node_scores_mean(spark, d):
    return scores.mean_scores(_assign(spark, d))


@query("A19 A22 T5 K5", f"""WITH c AS (SELECT tree_id, node_id, ctg, sum(s_count) AS n, {U("'plurality'", "tree_id", "node_id", "ctg")} AS u FROM {_ASSIGN} GROUP BY tree_id, node_id, ctg)
SELECT tree_id, node_id, CAST(ctg AS INTEGER) AS ctg, ctg + u / 2 AS score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, u DESC, ctg DESC) AS r FROM c) WHERE r = 1""")
def node_scores_plurality(spark, d):
    return scores.plurality_scores(_assign(spark, d), SEED)


@query("A22", f"SELECT tree_id, node_id, CAST(ctg AS INTEGER) AS ctg, CAST(sum(s_count) AS BIGINT) AS n FROM {_ASSIGN} GROUP BY ALL")
def leaf_class_counts(spark, d):
    return scores.class_counts(_assign(spark, d))


@query("A20", f"SELECT tree_id, node_id, sum((y - 250) * s_count) / sum(CAST(0.25 AS DOUBLE) * s_count) AS score FROM {_ASSIGN} GROUP BY ALL")
def node_scores_log_odds(spark, d):
    return scores.log_odds_scores(_assign(spark, d).withColumns({"y": F.col("y") - 250, "pq": F.lit(0.25)}))


@query("A21", """WITH c AS (SELECT list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS k, 1 / CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1)
SELECT CAST(k AS INTEGER) AS ctg, round(w / sum(w) OVER (), 12) AS weight FROM c""")
def class_weight_balance(spark, d):
    w = scores.class_weights(_assign(spark, d), "ctg", 3, "balance")
    return spark.createDataFrame(list(enumerate(w)), "ctg int, weight double").withColumn("weight", F.round("weight", 12))


# ---- a fixed forest over orders


def _node(tree, node, depth, score, pred=None, cut=None, codes=None, seen=None, left=None, info=None):
    split = pred is not None
    return (tree, node, depth, pred, None if not split else "factor" if codes is not None else "numeric", cut, codes, seen, left if split else None, 2 * node if split else None, 2 * node + 1 if split else None, float(score), info, 0.0, 1, 1)


FOREST = [
    _node(0, 1, 0, 250, 0, 700.5, left=True, info=8.0), _node(0, 2, 1, 200, 2, None, [0, 2], [0, 1, 2], False, 2.0), _node(0, 3, 1, 300, 1, 250000.0, left=False, info=4.0),
    _node(0, 4, 2, 180), _node(0, 5, 2, 220), _node(0, 6, 2, 150), _node(0, 7, 2, 380),
    _node(1, 1, 0, 250, 3, None, [1, 3], [0, 1, 2, 3], False, 6.0), _node(1, 2, 1, 240, 0, 300.0, left=False, info=1.0), _node(1, 3, 1, 260), _node(1, 4, 2, 210), _node(1, 5, 2, 270),
    _node(2, 1, 0, 251, 1, 200000.0, left=True, info=9.0), _node(2, 2, 1, 120), _node(2, 3, 1, 330),
    _node(3, 1, 0, 249, 2, None, [1], [0, 1], False, 3.0), _node(3, 2, 1, 254), _node(3, 3, 1, 246, 0, 1000.0, left=True, info=0.5), _node(3, 6, 2, 244), _node(3, 7, 2, 248),
]
CLASS_SCORE = {180: 0, 220: 1, 150: 2, 380: 1, 260: 0, 210: 1, 270: 2, 120: 0, 330: 1, 254: 1, 244: 0, 248: 2}
ORDER_SIG = E.Signature(["cust", "price", "status", "priority"], ["numeric", "numeric", "factor", "factor"], {"status": ["F", "O", "P"], "priority": _PRIORITY[:4]})


def forest_nodes(spark, classes: bool = False) -> DataFrame:
    rows = [(*r[:11], CLASS_SCORE.get(int(r[11]), 0) + 0.25 if classes else r[11], *r[12:]) for r in FOREST]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def order_frame(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_custkey") % 10 != 3, F.col("o_custkey")).alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"))


def _encoded(spark, d):
    return E.encode(order_frame(spark, d), ORDER_SIG, "row_id")


_ORDER = f"(SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 10 <> 3 THEN CAST(o_custkey AS DOUBLE) END AS x0, o_totalprice AS x1, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS x2, coalesce(list_position({_PRIORITY[:4]}, o_orderpriority) - 1, 4) AS x3, o_orderstatus AS status, floor(o_totalprice / 1000) AS y FROM orders)"


def _walk_sql(tree: int, node: int = 1, trap: bool = False) -> str:
    """CASE of the last node in a tree of FOREST."""
    r = next(x for x in FOREST if x[0] == tree and x[1] == node)
    if r[3] is None:
        return str(node)
    x = f"x{r[3]}"
    left, right = _walk_sql(tree, 2 * node, trap), _walk_sql(tree, 2 * node + 1, trap)
    if r[4] == "factor":
        stop = f"WHEN {x} IS NULL OR {x} NOT IN ({', '.join(map(str, r[7]))}) THEN {node} " if trap else ""
        return f"CASE {stop}WHEN {x} IN ({', '.join(map(str, r[6]))}) THEN {left} ELSE {right} END"
    gone = f"WHEN {x} IS NULL THEN {node} " if trap else f"WHEN {x} IS NULL THEN {left if r[8] else right} "
    return f"CASE {gone}WHEN {x} <= {r[5]} THEN {left} ELSE {right} END"


def _walked_sql(trap: bool = False) -> str:
    return " UNION ALL ".join(f"SELECT row_id, y, status, {t} AS tree_id, CAST({_walk_sql(t, 1, trap)} AS BIGINT) AS node_id FROM {_ORDER}" for t in range(TREES))


_SCORES = ", ".join(f"({r[0]}, {r[1]}, CAST({r[11]} AS DOUBLE), {CLASS_SCORE.get(int(r[11]), 0)})" for r in FOREST)
_FOREST = f"w AS ({_walked_sql()}), n(tree_id, node_id, score, ctg) AS (VALUES {_SCORES}), s AS (SELECT * FROM w JOIN n USING (tree_id, node_id))"


@query("F1 F2 F3 F6 J4 R8", f"SELECT row_id, tree_id, node_id FROM ({_walked_sql()})")
def tree_walk(spark, d):
    return walk.walk(_encoded(spark, d), forest_nodes(spark))


@query("F6 R11", f"SELECT row_id, tree_id, node_id FROM ({_walked_sql()})")
def tree_walk_blocks(spark, d):
    return walk.walk_blocks(_encoded(spark, d), forest_nodes(spark))


@query("F4 F5 R9", f"SELECT row_id, tree_id, node_id FROM ({_walked_sql(True)})")
def tree_walk_trap(spark, d):
    return walk.walk(_encoded(spark, d), forest_nodes(spark), trap=True)


_LEAVES = [(r[0], r[1]) for r in FOREST if r[3] is None]


@query("J6 W6 R9", f"WITH w AS ({_walked_sql(True)}), l(tree_id, leaf) AS (VALUES {', '.join(map(str, _LEAVES))}) SELECT row_id, w.tree_id, CAST(leaf AS BIGINT) AS node_id FROM w JOIN l ON w.tree_id = l.tree_id AND (leaf = node_id OR leaf >> 1 = node_id OR leaf >> 2 = node_id)")
def leaf_dominators(spark, d):
    nodes = forest_nodes(spark)
    return walk.dominated(walk.walk(_encoded(spark, d), nodes, trap=True), nodes.where("left_id IS NULL"))


def _scored(spark, d, classes=False):
    nodes = forest_nodes(spark, classes)
    rows = _encoded(spark, d)
    return rows, walk.scored(walk.walk(rows, nodes), nodes)


@query("R1 R2", f"WITH {_FOREST} SELECT row_id, avg(score) AS y_pred FROM s GROUP BY row_id")
def forest_mean(spark, d):
    return walk.predict_mean(*_scored(spark, d), 0.0)


@query("R3", f"WITH {_FOREST} SELECT row_id, 10 + CAST(0.5 AS DOUBLE) * sum(score) AS y_pred FROM s GROUP BY row_id")
def forest_sum(spark, d):
    return walk.predict_sum(*_scored(spark, d), 10.0, 0.5)


@query("R5", f"WITH {_FOREST}, p AS (SELECT row_id, -100 + CAST(0.1 AS DOUBLE) * sum(score) AS v FROM s GROUP BY row_id) SELECT row_id, round(1 / (1 + exp(-v)), 9) AS prob, CASE WHEN 1 / (1 + exp(-v)) > 0.5 THEN 1 ELSE 0 END AS ctg FROM p")
def forest_logistic(spark, d):
    return walk.predict_logistic(*_scored(spark, d), -100.0, 0.1).withColumn("prob", F.round("prob", 9))


_VOTES = f"{_FOREST}, v AS (SELECT row_id, ctg, count(*) AS votes FROM s GROUP BY ALL)"


@query("R6", f"WITH {_VOTES} SELECT * FROM v")
def forest_votes(spark, d):
    return walk.census(_scored(spark, d, True)[1])


_PLURAL = f"{_VOTES}, b AS (SELECT row_id, ctg, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, {U(chr(39) + 'argmax' + chr(39), 'row_id', 'ctg')} DESC, ctg) AS r FROM v)"


@query("R4 K5", f"WITH {_PLURAL} SELECT row_id, ctg FROM b WHERE r = 1")
def forest_plurality(spark, d):
    rows, got = _scored(spark, d, True)
    return walk.predict_plurality(rows, walk.census(got), 1, SEED)


@query("R7", f"WITH {_VOTES}, k AS (SELECT row_id, c AS ctg FROM (SELECT DISTINCT row_id FROM s), (SELECT unnest(range(0, 3))::INTEGER AS c)) SELECT row_id, k.ctg, coalesce(votes, 0) / CAST({TREES} AS DOUBLE) AS prob FROM k LEFT JOIN v USING (row_id, ctg)")
def forest_prob(spark, d):
    rows, got = _scored(spark, d, True)
    return walk.probabilities(rows, walk.census(got), [0.25, 0.5, 0.25])


_BINNED = """r AS (SELECT row_id, y, dense_rank() OVER (ORDER BY y) - 1 AS k FROM o), m AS (SELECT min(z) AS shift FROM range(0, 40) t(z) WHERE ((SELECT max(k) FROM r) >> z::INT) < 4096),
i AS (SELECT row_id AS member, k >> (SELECT shift FROM m)::INT AS bin, y FROM r), a AS (SELECT bin, avg(y) AS bin_mean FROM i GROUP BY bin)"""
_POOL = f"{_FOREST}, o AS (SELECT DISTINCT row_id, y FROM w), {_BINNED}, c AS (SELECT tree_id, node_id, bin, count(*) AS n FROM w JOIN i ON w.row_id = i.member GROUP BY ALL), q AS (SELECT row_id, bin, bin_mean, sum(n) AS n FROM w JOIN c USING (tree_id, node_id) JOIN a USING (bin) GROUP BY ALL)"


def _pool(spark, d):
    frame = order_frame(spark, d)
    walked = written(walk.walk(_encoded(spark, d), forest_nodes(spark)), "walked")
    ranks = E.rank_values(frame.select(F.lit(0).alias("pred_id"), F.col("y").alias("x"))).select(F.col("x").alias("y"), F.col("rank").alias("y_rank"))
    binned = quantiles.bins(frame.select("row_id", "y").join(ranks, "y"))
    return walked, lambda some: quantiles.pooled(some, walked.withColumn("s_count", F.lit(1).cast("long")), binned)


@query("W4 J5", f"WITH {_POOL}, z AS (SELECT *, sum(n) OVER (PARTITION BY row_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY row_id) AS total FROM q) SELECT row_id, p AS q, arg_min(bin_mean, bin) AS q_pred FROM z, (SELECT unnest([0.25, 0.5, 0.9])::DOUBLE AS p) WHERE run >= p * total GROUP BY row_id, p")
def forest_quantile(spark, d):
    walked, pool = _pool(spark, d)
    return quantiles.by_leaves(walked, lambda some: quantiles.quantiles(pool(some), [0.25, 0.5, 0.9]))


@query("W5", f"WITH {_POOL}, y AS (SELECT row_id, avg(score) AS y_pred FROM s GROUP BY row_id) SELECT row_id, sum(CASE WHEN bin_mean < y_pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS q_est FROM q JOIN y USING (row_id) GROUP BY row_id")
def quantile_estimate(spark, d):
    walked, pool = _pool(spark, d)
    return quantiles.by_leaves(walked, lambda some: quantiles.quantile_of_prediction(pool(some), forest_mean(spark, d)))


_SUPP = "(SELECT s_suppkey AS row_id, 0 AS tree_id, CAST(CASE WHEN s_acctbal <= 2500 THEN 2 WHEN s_nationkey <= 12 THEN 6 ELSE 7 END AS BIGINT) AS node_id FROM supplier UNION ALL SELECT s_suppkey, 1, CAST(CASE WHEN s_nationkey <= 8 THEN 2 ELSE 3 END AS BIGINT) FROM supplier)"


@query("R10 J5", f"""WITH w AS {_SUPP}, z AS (SELECT tree_id, node_id, count(*) AS size FROM w GROUP BY ALL)
SELECT a.row_id, b.row_id AS member_id, round(sum(1 / CAST(size AS DOUBLE)) / 2, 12) AS weight FROM w a JOIN w b USING (tree_id, node_id) JOIN z USING (tree_id, node_id) GROUP BY a.row_id, b.row_id""")
def forest_weight(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("x"))
    nodes = spark.createDataFrame([_node(0, 1, 0, 0, 0, 2500.0, left=True), _node(0, 2, 1, 0), _node(0, 3, 1, 0, 1, 12.0, left=True), _node(0, 6, 2, 0), _node(0, 7, 2, 0), _node(1, 1, 0, 0, 1, 8.0, left=True), _node(1, 2, 1, 0), _node(1, 3, 1, 0)], NODE_SCHEMA)
    walked = written(walk.walk(s, nodes), "walked")
    return quantiles.forest_weights(walked, walked.withColumn("s_count", F.lit(1).cast("long")), 12)


@query("A17", "SELECT * FROM (VALUES (0, CAST(2.375 AS DOUBLE)), (1, 3.25), (2, 1.25), (3, 1.5)) t(pred_id, info)")
def predictor_info(spark, d):
    return scores.predictor_info(forest_nodes(spark), 4, TREES)


@query("R12", "SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {i}, {r[3] if r[3] is not None else -(i + 1)}, {p.index(2 * r[1]) if r[3] is not None else 0}, {p.index(2 * r[1] + 1) if r[3] is not None else 0}, {'CAST(NULL AS DOUBLE)' if r[5] is None else f'CAST({r[5]} AS DOUBLE)'}, CAST({r[11]} AS DOUBLE))"
    for t in range(TREES) for p in [[x[1] for x in FOREST if x[0] == t]] for i, r in enumerate(x for x in FOREST if x[0] == t)) + ") t(tree_id, i, pred, child_l, child_r, split, score)")
def expand_forest(spark, d):
    return export.expanded(forest_nodes(spark)).select("tree_id", "i", "pred", "child_l", "child_r", "split", "score")


_TESTS = f"""n(tree_id, node_id, pred, cut, codes, na_left, score) AS (VALUES {", ".join(f"({r[0]}, CAST({r[1]} AS BIGINT), {'NULL' if r[3] is None else r[3]}, {'NULL' if r[5] is None else f"CAST({r[5]} AS DOUBLE)"}, {'NULL' if r[6] is None else f"CAST({r[6]} AS INTEGER[])"}, {'NULL' if r[8] is None else r[8]}, CAST({r[11]} AS DOUBLE))" for r in FOREST)}),
c AS (SELECT *, {ORDER_SIG.names}[pred + 1] AS name, CASE pred WHEN 2 THEN {ORDER_SIG.levels["status"]} ELSE {ORDER_SIG.levels["priority"]} END AS levels FROM n WHERE pred IS NOT NULL),
t AS (SELECT tree_id, node_id, CASE WHEN codes IS NULL THEN 'coalesce(`' || name || '` <= ' || cut || ', ' || na_left || ')' ELSE 'coalesce(`' || name || '` IN (' || array_to_string(list_transform(codes, lambda k: chr(39) || levels[k + 1] || chr(39)), ', ') || '), false)' END AS test FROM c)"""


@query("R13", f"""WITH RECURSIVE {_TESTS},
r(tree_id, node_id, rule) AS (SELECT DISTINCT tree_id, CAST(1 AS BIGINT), '' FROM n UNION ALL
  SELECT r.tree_id, 2 * r.node_id + side, rule || CASE WHEN rule = '' THEN '' ELSE ' AND ' END || CASE side WHEN 1 THEN 'NOT ' ELSE '' END || test FROM r JOIN t USING (tree_id, node_id), (VALUES (0), (1)) s(side))
SELECT tree_id, node_id, rule, score FROM r JOIN n USING (tree_id, node_id) WHERE pred IS NULL""")
def leaf_rules(spark, d):
    return export.rules(forest_nodes(spark), ORDER_SIG)


@query("R13", f"WITH {_TESTS} SELECT tree_id, node_id, repeat('  ', CAST(floor(log2(node_id)) AS INTEGER)) || node_id || ': ' || coalesce(test, 'leaf ' || score) AS line FROM n LEFT JOIN t USING (tree_id, node_id)")
def tree_dump(spark, d):
    return export.dump(forest_nodes(spark), ORDER_SIG)


@query("S15 R14 R1 R2", SQL["forest_mean"])
def stored_model(spark, d):
    """A streamlined model, saved and loaded, predicts what it did before."""
    path = shared_path(spark, "model")
    M.Forest(forest_nodes(spark), None, None, None, ORDER_SIG, "mean", 0.0, 0.0, Options(), n_tree=TREES).streamlined().save(path)
    return M.Forest.load(spark, path).predict(order_frame(spark, d))


_KEPT = 2


@query("K4", f"""WITH n(tree_id, node_id, info) AS (VALUES {", ".join(f"({r[0]}, CAST({r[1]} AS BIGINT), {'NULL' if r[3] is None else f"CAST({r[10]} AS DOUBLE)"})" for r in FOREST)}),
t AS (SELECT a.tree_id, a.node_id, sum(b.info) AS total FROM n a JOIN n b ON a.tree_id = b.tree_id AND a.node_id IN (b.node_id, b.node_id >> 1, b.node_id >> 2) WHERE a.info IS NOT NULL GROUP BY ALL),
k AS (SELECT tree_id, node_id FROM t QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY total DESC, node_id) <= {_KEPT - 1})
SELECT tree_id, node_id, (tree_id, node_id) IN (SELECT (tree_id, node_id) FROM k) AS split FROM n WHERE node_id = 1 OR (tree_id, node_id >> 1) IN (SELECT (tree_id, node_id) FROM k)""")
def prune_leaves(spark, d):
    """Splits of least dominated information go until _KEPT leaves are left in each tree."""
    nodes = forest_nodes(spark)
    members = nodes.where("left_id IS NULL").select("tree_id", "node_id", F.lit(1).cast("long").alias("row_id"), F.lit(1).cast("long").alias("s_count"))
    return prune(nodes, members, _KEPT)[0].select("tree_id", "node_id", F.col("left_id").isNotNull().alias("split"))


# ---- validation


@query("V2", f"WITH {_FOREST}, p AS (SELECT row_id, y, avg(score) AS y_pred FROM s GROUP BY row_id, y) SELECT count(*) AS n, round(avg((y - y_pred) * (y - y_pred)), 6) AS mse, round(avg(abs(y - y_pred)), 6) AS mae, round(1 - sum((y - y_pred) * (y - y_pred)) / (var_samp(y) * (count(*) - 1)), 9) AS rsq FROM p")
def test_reg(spark, d):
    both = order_frame(spark, d).select("row_id", "y").join(forest_mean(spark, d), "row_id")
    return validate.test_regression(both).select("n", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"), F.round("rsq", 9).alias("rsq"))


_CONF = f"{_PLURAL}, t AS (SELECT list_position(['F', 'O', 'P'], o_orderstatus)::INTEGER - 1 AS y, ctg FROM b JOIN orders ON o_orderkey = row_id WHERE r = 1), f AS (SELECT y, ctg, count(*) AS n FROM t GROUP BY ALL)"


def _truth(spark, d):
    return validate.confusion(order_frame(spark, d).select("row_id", _code("status", "FOP").cast("int").alias("y")).join(forest_plurality(spark, d), "row_id"))


@query("V1 V3 V4", f"WITH {_CONF} SELECT * FROM f")
def confusion(spark, d):
    return _truth(spark, d)


@query("V3 V4", f"WITH {_CONF}, g AS (SELECT y, sum(CASE WHEN y = ctg THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE) AS m FROM f GROUP BY y) SELECT y, coalesce(m, 0) AS misprediction FROM (SELECT unnest(range(0, 4))::INTEGER AS y) LEFT JOIN g USING (y)")
def misprediction(spark, d):
    return validate.misprediction(_truth(spark, d), spark.range(4).select(F.col("id").cast("int").alias("y")))


@query("V3", f"WITH {_CONF} SELECT CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN y = ctg THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE) AS error FROM f")
def test_error(spark, d):
    return validate.error(_truth(spark, d))


_PERM = f"""a AS (SELECT *, row_number() OVER (ORDER BY row_id) AS i FROM {_ORDER}), b AS (SELECT x1 AS v, row_number() OVER (ORDER BY {sql_uniform(str(SEED + 1), "'permute'", "row_id")}, row_id) AS i FROM {_ORDER}),
p AS (SELECT row_id, x0, v AS x1, x2, x3, y FROM a JOIN b USING (i))"""


@query("V5", f"WITH {_PERM}, w AS (" + " UNION ALL ".join(f"SELECT row_id, y, {t} AS tree_id, {_walk_sql(t)} AS node_id FROM p" for t in range(TREES)) + f"), n(tree_id, node_id, score, ctg) AS (VALUES {_SCORES}), q AS (SELECT row_id, y, avg(score) AS y_pred FROM w JOIN n USING (tree_id, node_id) GROUP BY row_id, y) SELECT 1 AS pred_id, round(avg((y - y_pred) * (y - y_pred)), 6) AS mse, round(avg(abs(y - y_pred)), 6) AS mae FROM q")
def permute_importance(spark, d):
    nodes, rows = forest_nodes(spark), _encoded(spark, d)
    moved = written(validate.permute_predictor(rows, 1, SEED), "moved")
    got = walk.predict_mean(moved, walk.scored(walk.walk(moved, nodes), nodes), 0.0)
    return validate.test_regression(order_frame(spark, d).select("row_id", "y").join(got, "row_id")).select(F.lit(1).alias("pred_id"), F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


# ---- boosting


@query("T11", "SELECT round(avg(floor(o_totalprice / 1000)), 9) AS l2, round(ln(avg((o_orderstatus = 'O')::INT) / (1 - avg((o_orderstatus = 'O')::INT))), 9) AS logistic FROM orders")
def boost_base(spark, d):
    frame = order_frame(spark, d)
    b = M.boost_base(frame, False), M.boost_base(frame.select((F.col("status") == "O").cast("double").alias("y")), True)
    return spark.createDataFrame([b], "l2 double, logistic double").select(F.round("l2", 9).alias("l2"), F.round("logistic", 9).alias("logistic"))


@query("T12", f"WITH {_FOREST} SELECT row_id, y - (10 + CAST(0.5 AS DOUBLE) * sum(score)) AS y FROM s GROUP BY row_id, s.y")
def boost_residual_l2(spark, d):
    rows = order_frame(spark, d).select("row_id", F.col("y").alias("target")).join(forest_sum(spark, d).withColumnRenamed("y_pred", "est"), "row_id")
    return M.residuals(rows, False).select("row_id", "y")


@query("T12 T13", f"WITH {_FOREST}, e AS (SELECT row_id, status, -25 + CAST(0.1 AS DOUBLE) * sum(score) / 4 AS v FROM s GROUP BY row_id, status) SELECT row_id, round((status = 'O')::INT - 1 / (1 + exp(-v)), 9) AS y, round(1 / (1 + exp(-v)) * (1 - 1 / (1 + exp(-v))), 9) AS pq FROM e")
def boost_residual_logistic(spark, d):
    est = walk.predict_sum(*_scored(spark, d), -25.0, 0.025).withColumnRenamed("y_pred", "est")
    rows = order_frame(spark, d).select("row_id", (F.col("status") == "O").cast("double").alias("target")).join(est, "row_id")
    return M.residuals(rows, True).select("row_id", F.round("y", 9).alias("y"), F.round("pq", 9).alias("pq"))


# ---- growth


@query("T1 T2 T3 T4 T6 T7 T9 T14 T15 K3 J3 R15", """WITH t AS (SELECT o_orderkey AS row_id, 0 AS tree_id, floor(o_totalprice / 1000) AS y, CAST(month(o_orderdate) AS DOUBLE) AS x FROM orders),
h AS (SELECT x, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM t GROUP BY x), p AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts, lead(x) OVER (ORDER BY x) AS xr FROM h WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM p WHERE xr IS NOT NULL),
b AS (SELECT gain, (x + xr) / 2 AS cut, ln, ls, tn, ts FROM g ORDER BY gain DESC, x DESC LIMIT 1)
SELECT CAST(1 AS BIGINT) AS node_id, round(cut, 6) AS cut, round(gain, 3) AS info, CAST(tn AS BIGINT) AS n_rows, round(ts / tn, 9) AS score FROM b UNION ALL SELECT 2, NULL, NULL, CAST(ln AS BIGINT), round(ls / ln, 9) FROM b UNION ALL SELECT 3, NULL, NULL, CAST(tn - ln AS BIGINT), round((ts - ls) / (tn - ln), 9) FROM b""")
def grow_two_levels(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"), F.month("o_orderdate").alias("month"))
    prep = M.prepare(o, "y", "row_id", ["month"])
    root = prep.frame.select(F.lit(0).alias("tree_id"), "row_id", F.lit(1).cast("long").alias("s_count"), "y", F.lit(None).cast("int").alias("ctg"))
    nodes, _ = M.grow(prep.frame, root, prep.sig, M.Target(), Options(n_level=2, seed=SEED).checked(1, False), prep.values, [], 1)
    return nodes.select("node_id", F.round("cut", 6).alias("cut"), F.round("info", 3).alias("info"), "n_rows", F.round("score", 9).alias("score"))


def _lines(spark, d):
    """Whole orders table as a training frame: one numeric response, two numeric and two factor predictors."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"), F.month("o_orderdate").alias("month"), "o_orderstatus", "o_orderpriority")


def _stump(k: int) -> str:
    """SQL of one round of boosting by a tree of one split on x: e{k} from e{k - 1}."""
    return f"""h{k} AS (SELECT x, CAST(count(*) AS DOUBLE) AS n, sum(y - est) AS s FROM e{k - 1} GROUP BY x),
p{k} AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts, lead(x) OVER (ORDER BY x) AS xr FROM h{k} WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
b{k} AS (SELECT (x + xr) / 2 AS cut, ls / ln AS l, (ts - ls) / (tn - ln) AS r FROM p{k} WHERE xr IS NOT NULL ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, x DESC LIMIT 1),
e{k} AS (SELECT row_id, y, x, est + CAST(0.1 AS DOUBLE) * CASE WHEN x <= cut THEN l ELSE r END AS est FROM e{k - 1}, b{k})"""


@query("R16 T11 T12 T13 R3", f"""WITH t AS (SELECT o_orderkey AS row_id, floor(o_totalprice / 1000) AS y, CAST(month(o_orderdate) AS DOUBLE) AS x FROM orders),
e0 AS (SELECT *, (SELECT avg(y) FROM t) AS est FROM t), {_stump(1)}, {_stump(2)} SELECT row_id, round(est, 6) AS y_pred FROM e2""")
def boost_two_stumps(spark, d):
    """Boosting end to end, where each tree sees every row and splits once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"), F.month("o_orderdate").alias("month"))
    how = Options(n_tree=2, n_level=2, nu=0.1, with_repl=False, n_samp=o.count(), pred_fixed=1, seed=SEED)
    return M.fit_boosted(M.prepare(o, "y", "row_id", ["month"]), how).predict(o).select("row_id", F.round("y_pred", 6).alias("y_pred"))


@query("R15 T1 T9 P1")
def fit_regression(spark, d):
    m = M.fit(_lines(spark, d), "price", "row_id", n_tree=4, n_level=4, seed=SEED)
    return m.nodes.select("tree_id", "node_id", "depth", "pred_id", "kind", "cut", "na_left", "score", "info", "n_rows", "s_count")


@query("R15 A21 T5")
def fit_classification(spark, d):
    m = M.fit(_lines(spark, d), "o_orderstatus", "row_id", ["price", "cust", "month", "o_orderpriority"], n_tree=4, n_level=4, max_leaf=6, class_weight="balance", seed=SEED)
    return m.nodes.select("tree_id", "node_id", "depth", "pred_id", "kind", "cut", "na_left", "score", "info", "n_rows", "s_count")


@query("R16 T11 T12 T13 R3")
def fit_boosted(spark, d):
    frame = _lines(spark, d)
    return M.fit(frame, "price", "row_id", boost=True, n_tree=2, n_level=3, seed=SEED).predict(frame)


def flagship(spark, d) -> DataFrame:
    """Best cuts of the line items' numeric predictors."""
    return split_reg_numeric(spark, d)


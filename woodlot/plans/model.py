"""The fitted forest: training, prediction, validation, persistence."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import small, written
from ..operators import quantiles, sampling, scores, splits, validate, walk
from ..sources import encode as E
from .config import Options
from .grow import Target, grow, prune


@dataclass
class Forest:
    """Tables and descriptor of a fitted forest."""

    nodes: DataFrame
    members: DataFrame | None
    labels: DataFrame | None
    bag: DataFrame | None
    sig: E.Signature
    scorer: str
    base: float
    nu: float
    options: Options
    levels: list[str] = field(default_factory=list)
    frequencies: list[float] = field(default_factory=list)
    bag_hash: str = ""
    n_tree: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # ---- prediction

    def encoded(self, df: DataFrame, row_id: str = "row_id", keyed: bool = True) -> DataFrame:
        return E.encode(df, self.sig, row_id, keyed=keyed)

    def walked(self, rows: DataFrame, bagging: bool = False, trap: bool | None = None, blocks: bool = False) -> DataFrame:
        trap = self.options.trap_unobserved if trap is None else trap
        if bagging:
            if self.bag is None:
                raise ValueError("the bag was not kept: out-of-bag prediction needs it")
            return walk.walk(rows, self.nodes, sampling.out_of_bag(rows, self.bag, self.n_tree), trap)
        return walk.walk_blocks(rows, self.nodes, trap) if blocks else walk.walk(rows, self.nodes, trap=trap)

    def from_walk(self, rows: DataFrame, walked: DataFrame) -> DataFrame:
        got = walk.scored(walked, self.nodes)
        if self.scorer == "mean":
            return walk.predict_mean(rows, got, self.base)
        if self.scorer == "sum":
            return walk.predict_sum(rows, got, self.base, self.nu)
        if self.scorer == "logistic":
            return self.named(walk.predict_logistic(rows, got, self.base, self.nu))
        return self.named(walk.predict_plurality(rows, walk.census(got), self.frequencies.index(max(self.frequencies)), self.options.seed))

    def named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("y_pred", F.element_at(F.array(*[F.lit(v) for v in self.levels]), F.col("ctg") + 1))

    def predict(self, df: DataFrame, row_id: str = "row_id", *, keyed: bool = True, bagging: bool = False, trap: bool | None = None, blocks: bool = False) -> DataFrame:
        """row_id, y_pred (and ctg, for classes; prob, for boosting)."""
        rows = self.encoded(df, row_id, keyed)
        return self.from_walk(rows, self.walked(rows, bagging, trap, blocks))

    def indices(self, df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
        """row_id, tree_id, node_id."""
        return self.walked(self.encoded(df, row_id), **how)

    def census(self, df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
        """row_id, ctg, votes, or prob if options.ctg_census says so."""
        rows = self.encoded(df, row_id)
        votes = walk.census(walk.scored(self.walked(rows, **how), self.nodes))
        return votes if self.options.ctg_census == "votes" else walk.probabilities(rows, votes, self.frequencies)

    def prob(self, df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
        rows = self.encoded(df, row_id)
        return walk.probabilities(rows, walk.census(walk.scored(self.walked(rows, **how), self.nodes)), self.frequencies)

    # ---- leaves

    def _thick(self) -> tuple[DataFrame, DataFrame]:
        if self.members is None or self.labels is None:
            raise ValueError("leaves are thin: train with thin_leaves=False for quantiles and weights")
        return self.members, self.labels

    def _leaves_of(self, walked: DataFrame, trap: bool | None) -> DataFrame:
        """Where a trapped walk stopped at a split, the leaves under it take its place."""
        if not (self.options.trap_unobserved if trap is None else trap):
            return walked
        return walk.dominated(walked, self.nodes.where("left_id IS NULL"))

    def quantiles(self, df: DataFrame, levels: list[float] | None = None, row_id: str = "row_id", **how) -> DataFrame:
        """row_id, q, q_pred."""
        pool, _, walked = self._pool(df, row_id, how)
        levels = levels or self.options.quant_vec or [0.25, 0.5, 0.75, 1.0]
        return quantiles.by_leaves(walked, lambda some: quantiles.quantiles(pool(some), levels))

    def quantile_estimates(self, df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
        """row_id, q_est."""
        pool, rows, walked = self._pool(df, row_id, how)
        predicted = self.from_walk(rows, walked)
        return quantiles.by_leaves(walked, lambda some: quantiles.quantile_of_prediction(pool(some), predicted))

    def _pool(self, df, row_id, how):
        members, labels = self._thick()
        rows = self.encoded(df, row_id)
        walked = self.walked(rows, **how)
        ranks = E.rank_values(labels.select(F.lit(0).alias("pred_id"), F.col("y").alias("x")))
        binned = quantiles.bins(labels.join(ranks.select(F.col("x").alias("y"), F.col("rank").alias("y_rank")), "y"))
        return (lambda some: quantiles.pooled(self._leaves_of(some, how.get("trap")), members, binned)), rows, walked

    def weights(self, df: DataFrame, row_id: str = "row_id", **how) -> DataFrame:
        """row_id, member_id, weight; weights of a row sum to one."""
        members, _ = self._thick()
        return quantiles.forest_weights(self._leaves_of(self.indices(df, row_id, **how), how.get("trap")), members)

    # ---- validation

    def test(self, df: DataFrame, label: str, row_id: str = "row_id", **how) -> dict[str, DataFrame]:
        """Statistics of predictions against df's label: regression, or confusion, misprediction and error (V2-V4)."""
        return self._tested(self.predict(df, row_id, **how), df.select(F.col(row_id).cast("long").alias("row_id"), F.col(label).alias("y")))

    def _tested(self, predicted: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
        both = truth.where("y IS NOT NULL").join(predicted, "row_id")
        if not self.levels:
            return {"regression": validate.test_regression(both)}
        cells = validate.confusion(both.select("y", F.col("y_pred").alias("ctg")))
        known = self.spark.createDataFrame([(v,) for v in self.levels], "y string")
        return {"confusion": cells, "misprediction": validate.misprediction(cells, known), "error": validate.error(cells)}

    def validate(self, df: DataFrame, label: str, row_id: str = "row_id") -> dict[str, DataFrame]:
        """Out-of-bag test on the training frame (V1); with imp_permute, importance of each predictor too (V5)."""
        if self.bag is not None and sampling.bag_hash(self.bag) != self.bag_hash:
            raise ValueError("the bag is not the one that the forest was trained with")
        out = self.test(df, label, row_id, bagging=True)
        if self.options.imp_permute:
            out["importance"] = self.importance(df, label, row_id)
        return out

    def importance(self, df: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
        """pred_id and the out-of-bag statistics with that predictor permuted (V5)."""
        rows = written(self.encoded(df, row_id), "encoded")
        truth = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(label).alias("y"))
        parts = []
        for p in range(self.sig.p):
            moved = validate.permute_predictor(rows, p, self.options.seed)
            got = self._tested(self.from_walk(moved, self.walked(moved, bagging=True)), truth)
            parts.append((got["regression"] if not self.levels else got["error"]).withColumn("pred_id", F.lit(p)))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def predictor_info(self) -> DataFrame:
        return scores.predictor_info(self.nodes, self.sig.p, self.n_tree)

    # ---- storage

    def streamlined(self, keep_bag: bool = False) -> Forest:
        """Without what only quantiles, weights and out-of-bag tests need."""
        return replace(self, members=None, labels=None, bag=self.bag if keep_bag else None)

    def save(self, path: str) -> None:
        """Parquet tables and one JSON row under path."""
        for name in ("nodes", "members", "labels", "bag"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        have = [n for n in ("nodes", "members", "labels", "bag") if getattr(self, n) is not None]
        meta = {"tables": have, "sig": self.sig.json(), "scorer": self.scorer, "base": self.base, "nu": self.nu, "levels": self.levels, "frequencies": self.frequencies, "bag_hash": self.bag_hash, "n_tree": self.n_tree, "options": {**self.options.__dict__, "reg_mono": list(self.options.reg_mono.items())}}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        m = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        m["options"]["reg_mono"] = {int(k): v for k, v in m["options"]["reg_mono"]}
        if isinstance(m["options"]["split_quant"], dict):
            m["options"]["split_quant"] = {int(k): v for k, v in m["options"]["split_quant"].items()}
        t = {n: spark.read.parquet(f"{path}/{n}") if n in m["tables"] else None for n in ("nodes", "members", "labels", "bag")}
        return Forest(**t, sig=E.Signature.of_json(m["sig"]), scorer=m["scorer"], base=m["base"], nu=m["nu"], options=Options(**m["options"]), levels=m["levels"], frequencies=m["frequencies"], bag_hash=m["bag_hash"], n_tree=m["n_tree"])


@dataclass
class Prepared:
    """An encoded training frame that several trainings share."""

    frame: DataFrame
    sig: E.Signature
    values: DataFrame
    levels: list[str]


def prepare(df: DataFrame, label: str, row_id: str, predictors: list[str] | None = None) -> Prepared:
    """Encode and rank once; row_id must be unique and not null."""
    sig = E.signature(df, predictors or [c for c in df.columns if c not in (label, row_id)])
    kind = df.schema[label].dataType
    levels: list[str] = []
    if kind.simpleString() == "string":
        levels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
        y = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), F.col(label)).cast("double") - 1
    elif isinstance(kind, E.NUMERIC):
        y = F.col(label).cast("double")
        y = F.when(~F.isnan(y), y)
    else:
        raise TypeError("the response is numeric or string")
    frame = written(E.encode(df.withColumn("__y", y), sig, row_id, keep=("__y",)).withColumnRenamed("__y", "y"), "frame")
    # sorts of distinct values, range by range where one predictor may have more of them than a task should sort
    distinct = written(E.long_form(frame.select("row_id", "x")).where("x IS NOT NULL").select("pred_id", "x").distinct(), "distinct")
    ranks = E.rank_values_at_scale if distinct.count() > splits.CELL_ROWS else E.rank_values
    return Prepared(frame, sig, written(ranks(distinct), "values"), levels)


def _start(prepared: Prepared, options: Options, n_ctg: int):
    options = replace(options).checked(prepared.sig.p, n_ctg > 0)
    fixed, prob = options.pred_fixed, options.pred_prob
    if not fixed and not prob:
        fixed, prob = sampling.default_candidates(prepared.sig.p, n_ctg > 0)
    rows = prepared.frame.where("y IS NOT NULL")
    if options.n_holdout:
        rows = rows.join(sampling.holdout(rows, options.n_holdout, options.seed), "row_id", "left_anti")
    return options, fixed, sampling.probabilities(prepared.sig.p, prob, options.pred_weight), rows


def fit_forest(prepared: Prepared, options: Options | None = None, weights: DataFrame | None = None) -> Forest:
    """A random forest (R15): bag, grow in blocks of trees, prune. weights: row_id, weight for sampling."""
    n_ctg = len(prepared.levels)
    options, fixed, probs, rows = _start(prepared, options or Options(), n_ctg)
    counts = {int(r[0]): r[1] for r in rows.groupBy("y").count().collect()} if n_ctg else {}
    if n_ctg and (n_ctg < 2 or len(counts) < n_ctg):
        raise ValueError("every class needs rows, and there are at least two")
    base = 0.0 if n_ctg else rows.agg(F.avg("y")).first()[0] or 0.0
    w = scores.class_weights(rows, "y", n_ctg, options.class_weight) if n_ctg else []
    y = F.element_at(F.array(*map(F.lit, w)), F.col("y").cast("int") + 1) if n_ctg else F.col("y")
    labels = rows.select("row_id", y.alias("y"), (F.col("y").cast("int") if n_ctg else F.lit(None).cast("int")).alias("ctg"), "x")
    drawn = rows.select("row_id") if weights is None else rows.join(weights, "row_id").select("row_id", "weight")
    target = Target(n_ctg, "plurality" if n_ctg else "mean")
    nodes, members, bags = [], [], []
    for first in range(0, options.n_tree, options.tree_block):
        n = min(options.tree_block, options.n_tree - first)
        size = sampling.sample_count(drawn.count(), options.n_samp, options.with_repl)
        if weights is not None:
            bag = (sampling.bag_weighted_with if options.with_repl else sampling.bag_weighted_without)(drawn, "weight", n, size, options.seed, first)
        else:
            bag = (sampling.bag_with_replacement if options.with_repl else sampling.bag_without_replacement)(drawn, n, size, options.seed, first)
        bag = written(bag, "bag")
        some, leaf = grow(prepared.frame, bag.join(labels, "row_id").select("tree_id", "row_id", "s_count", "y", "ctg", "x"), prepared.sig, target, options, prepared.values, probs, fixed)
        if options.max_leaf:
            some, leaf = prune(some, leaf, options.max_leaf)
        nodes.append(some)
        members.append(leaf)
        bags.append(bag)
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    table, bag = written(union(nodes), "forest"), written(union(bags), "bags")
    total = sum(counts.values())
    return Forest(table, None if options.thin_leaves else written(union(members), "members"), labels.select("row_id", "y") if not n_ctg else rows.select("row_id", "y"), bag, prepared.sig, "plurality" if n_ctg else "mean", base, 0.0, options, prepared.levels, [counts[k] / total for k in range(n_ctg)], sampling.bag_hash(bag), options.n_tree)


def boost_base(rows: DataFrame, binary: bool) -> float:
    """Mean, or log odds of class 1."""
    m = rows.agg(F.avg("y")).first()[0] or 0.0
    return math.log(m / (1 - m)) if binary else m


def residuals(rows: DataFrame, binary: bool) -> DataFrame:
    """rows (row_id, target, est) with y = the residual and pq = p(1 - p)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("est")))
    if binary:
        return rows.withColumns({"y": F.col("target") - p, "pq": p * (1 - p)})
    return rows.withColumns({"y": F.col("target") - F.col("est"), "pq": F.lit(1.0)})


def fit_boosted(prepared: Prepared, options: Options | None = None) -> Forest:
    """Gradient boosting, squared or logistic loss (R16, T11-T13): each tree fits the residuals, and every
    row's estimate moves by nu times its leaf's score."""
    options = options or Options(n_tree=100, n_level=6, nu=0.1, with_repl=False, pred_fixed=prepared.sig.p)
    binary = bool(prepared.levels)
    if binary and len(prepared.levels) != 2:
        raise ValueError("boosting takes a numeric or a two-level response")
    if not 0 < options.nu <= 1:
        raise ValueError("nu lies in (0, 1]")
    options, fixed, probs, rows = _start(prepared, options, 0)
    n_avail = rows.count()
    if not options.n_samp:
        options.n_samp = max(1, n_avail // 2)
    base = boost_base(rows, binary)
    estimate = written(rows.select("row_id", "x", F.col("y").alias("target"), F.lit(float(base)).alias("est")), "estimate")
    nodes, bags = [], []
    for tree in range(options.n_tree):
        current = residuals(estimate, binary)
        bag = written((sampling.bag_with_replacement if options.with_repl else sampling.bag_without_replacement)(rows.select("row_id"), 1, options.n_samp, options.seed, tree, n_avail), "bag")
        root = bag.join(current.select("row_id", "y", "pq", "x"), "row_id").select("tree_id", "row_id", "s_count", "y", F.lit(None).cast("int").alias("ctg"), "pq", "x")
        some, _ = grow(prepared.frame, root, prepared.sig, Target(0, "log_odds" if binary else "mean"), options, prepared.values, probs, fixed)
        some = written(some, "tree")
        # rows keep their columns on the walk, so no join brings them back
        step = walk.scored(walk.walk(estimate, some, keep=("x", "target", "est")), some)
        estimate = written(step.select("row_id", "x", "target", (F.col("est") + F.lit(options.nu) * F.col("score")).alias("est")), "estimate")
        nodes.append(some)
        bags.append(bag)
    table, bag = nodes[0], bags[0]
    for a, b in zip(nodes[1:], bags[1:]):
        table, bag = table.unionByName(a), bag.unionByName(b)
    table, bag = written(table, "boosted"), written(bag, "bags")
    return Forest(table, None, None, bag, prepared.sig, "logistic" if binary else "sum", base, options.nu, options, prepared.levels, [], sampling.bag_hash(bag), options.n_tree)


def fit(df: DataFrame, label: str, row_id: str, predictors: list[str] | None = None, *, boost: bool = False, **options) -> Forest:
    """Encode, sample and train in one call (R15, R16); options are those of Options."""
    prepared = prepare(df, label, row_id, predictors)
    if boost:
        return fit_boosted(prepared, Options(**{"n_tree": 100, "n_level": 6, "nu": 0.1, "with_repl": False, "pred_fixed": prepared.sig.p} | options))
    weight = options.get("sampling_weight")
    weights = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(weight).cast("double").alias("weight")) if weight else None
    return fit_forest(prepared, Options(**options), weights)

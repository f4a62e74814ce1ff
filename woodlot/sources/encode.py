"""Encoding of frames: signature, levels, dense ranks, runs and surveys.

A frame becomes (row_id, x): x is an array of doubles with one place for each predictor, in the user's
order. A numeric predictor keeps its value, a factor its code; NaN and null are null. The long form
(row_id, pred_id, x) is for operators on single predictors.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.storage import written

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


@dataclass
class Signature:
    """Predictor names, forms ('numeric' or 'factor') and the levels of each factor."""

    names: list[str]
    forms: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def p(self) -> int:
        return len(self.names)

    def factors(self) -> list[int]:
        return [i for i, f in enumerate(self.forms) if f == "factor"]

    def json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of_json(text: str) -> Signature:
        return Signature(**json.loads(text))


def signature(df: DataFrame, predictors: list[str] | None = None) -> Signature:
    """The signature of df's predictors; a type that is neither numeric nor string is an error."""
    predictors = list(predictors or df.columns)
    if not predictors or len(set(predictors)) != len(predictors):
        raise ValueError("predictor names must be there, and unique")
    forms = []
    for c in predictors:
        kind = df.schema[c].dataType
        if isinstance(kind, NUMERIC):
            forms.append("numeric")
        elif isinstance(kind, T.StringType):
            forms.append("factor")
        else:
            raise TypeError(f"{c} is {kind.simpleString()}; predictors are numeric or string: cast it first")
    sig = Signature(predictors, forms)
    for c, f in zip(predictors, forms):
        if f == "factor":
            sig.levels[c] = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
    return sig


def check(df: DataFrame, sig: Signature, keyed: bool = True) -> list[str]:
    """df's columns for sig, by name or by position; missing names and unlike types are errors."""
    columns = sig.names if keyed else df.columns[: sig.p]
    if keyed and not set(sig.names) <= set(df.columns):
        raise ValueError(f"missing predictors: {sorted(set(sig.names) - set(df.columns))}")
    if len(columns) != sig.p:
        raise ValueError(f"{sig.p} predictors expected, {len(columns)} given")
    for c, form in zip(columns, sig.forms):
        got = "numeric" if isinstance(df.schema[c].dataType, NUMERIC) else "factor" if isinstance(df.schema[c].dataType, T.StringType) else "other"
        if got != form:
            raise TypeError(f"{c}: {form} expected, {got} given")
    return columns


def factor_code(column, levels: list[str]):
    """0-based code; a level unseen in training gets the proxy code len(levels); null stays null."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), column) - 1 if levels else F.lit(-1)
    return F.when(column.isNotNull(), F.when(place >= 0, place).otherwise(F.lit(len(levels)))).cast("double")


def encode(df: DataFrame, sig: Signature, row_id: str, keep: tuple[str, ...] = (), keyed: bool = True) -> DataFrame:
    """row_id, the kept columns and x; idempotent on encoded frames."""
    if "x" in df.columns and isinstance(df.schema["x"].dataType, T.ArrayType) and "x" not in sig.names:
        return df
    values = []
    for c, source, form in zip(sig.names, check(df, sig, keyed), sig.forms):
        v = F.col(source)
        values.append(F.when(~F.isnan(v.cast("double")), v.cast("double")) if form == "numeric" else factor_code(v, sig.levels[c]))
    return df.select(F.col(row_id).cast("long").alias("row_id"), *keep, F.array(*values).alias("x"))


def sparse(entries: DataFrame, rows: DataFrame, p: int) -> DataFrame:
    """Wide form of (row_id, pred_id, x) entries, zero where there is none (S6). Pre-aggregated by row."""
    given = entries.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("pred_id", F.when(~F.isnan("x"), F.col("x")).alias("x")))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(p - 1))
    value = lambda j: F.when(F.array_contains(F.map_keys("m"), j), F.try_element_at("m", j)).otherwise(F.lit(0.0))
    return rows.select("row_id").join(given, "row_id", "left").select("row_id", F.when(F.col("m").isNull(), F.transform(places, lambda j: F.lit(0.0))).otherwise(F.transform(places, value)).alias("x"))


def long_form(encoded: DataFrame) -> DataFrame:
    """row_id, pred_id, x."""
    keep = [c for c in encoded.columns if c != "x"]
    return encoded.select(*keep, F.posexplode("x").alias("pred_id", "x"))


def rank_values(long: DataFrame) -> DataFrame:
    """pred_id, x, rank: dense 0-based rank of each distinct value, missing left out."""
    return long.where("x IS NOT NULL").select("pred_id", "x").distinct().withColumn("rank", (F.dense_rank().over(W.partitionBy("pred_id").orderBy("x")) - 1).cast("long"))


def numbered(df: DataFrame, key: list[str], out: str = "i", within: str | None = None) -> DataFrame:
    """df with its 0-based place in the order of key, without a task that sees all rows.

    Rows are range-partitioned and sorted; each partition numbers its own, and the offsets come from one
    count for each partition. within: numbers restart for each value of the first key column.
    """
    tag = df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__m", F.monotonically_increasing_id())
    tag = written(tag.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)}), "numbered")
    offsets = tag.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).withColumn("__o", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out_df = tag.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__o") + F.col("__i")).drop("__m", "__p", "__i", "__o")
    if within:
        first = out_df.groupBy(within).agg(F.min(out).alias("__f"))
        out_df = out_df.join(F.broadcast(first), within).withColumn(out, F.col(out) - F.col("__f")).drop("__f")
    return out_df


def rank_values_at_scale(long: DataFrame) -> DataFrame:
    """As rank_values, where one predictor has more distinct values than a task should sort."""
    return numbered(long.where("x IS NOT NULL").select("pred_id", "x").distinct(), ["pred_id", "x"], "rank", "pred_id")


def ranked(long: DataFrame, values: DataFrame) -> DataFrame:
    """long with rank; missing values get the rank after the last (missing sorts last)."""
    after = values.groupBy("pred_id").agg((F.max("rank") + 1).alias("missing"))
    return long.join(values, ["pred_id", "x"], "left").join(F.broadcast(after), "pred_id", "left").select("row_id", "pred_id", "x", F.coalesce("rank", "missing", F.lit(0)).cast("long").alias("rank"))


def runs(ranks: DataFrame) -> DataFrame:
    """pred_id, rank, row, extent: maximal runs of neighbouring rows of one rank."""
    island = F.col("row_id") - F.row_number().over(W.partitionBy("pred_id", "rank").orderBy("row_id"))
    return ranks.withColumn("island", island).groupBy("pred_id", "rank", "island").agg(F.min("row_id").alias("row"), F.count(F.lit(1)).alias("extent")).drop("island")


def decode_runs(rle: DataFrame) -> DataFrame:
    """row_id, pred_id, rank from runs."""
    return rle.select("pred_id", "rank", F.explode(F.sequence("row", F.col("row") + F.col("extent") - 1)).alias("row_id"))


def survey(ranks: DataFrame, compress: float = 0.25) -> DataFrame:
    """pred_id, n_ranks, mode_rank (least of equals), mode_count, n_missing, dense: whether the mode passes compress."""
    counts = ranks.groupBy("pred_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x").isNull(), 1)).alias("missing"))
    best = counts.groupBy("pred_id").agg(F.count(F.lit(1)).alias("n_ranks"), F.max(F.struct("n", (-F.col("rank")).alias("r"))).alias("m"), F.sum("n").alias("total"), F.sum("missing").alias("n_missing"))
    return best.select("pred_id", "n_ranks", (-F.col("m.r")).alias("mode_rank"), F.col("m.n").alias("mode_count"), "n_missing", (F.col("m.n") > F.col("total") * F.lit(compress)).alias("dense"))

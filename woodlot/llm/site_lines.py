"""Lines by how many pages of their host hold them, in DataFrame functions alone: what the line rules share.

A page is a row. Each page contributes each of its distinct normalised lines once, counts are combined
before the shuffle, and only lines above the limits go back to the pages: one array of line hashes for each
host. A line above a share s of its host's pages is one of at most (mean lines of a page) / s such lines,
so the array is bounded for each host; the table of all hosts is broadcast only when its measured size is
at most BROADCAST_BYTES, else it is joined by host, with the pages of a host spread over SALTS keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BROADCAST_BYTES = 32 << 20
SALTS = 32
#: White space that may surround or part words.
SPACES = " \t\n\x0b\f\r"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def line_hash(line: Column) -> Column:
    """64 bits of a normalised line."""
    return F.xxhash64(line)


def with_frequent(df: DataFrame, host: str, text: str, normal: Callable[[Column], Column], limit: Callable[[Column], Column], out: str) -> DataFrame:
    """df with the hashes of the lines of its row's host that more than limit(pages of the host) pages hold, or null."""
    spark = df.sparkSession
    key = F.coalesce(F.col(host), F.lit("")).alias("host")
    pages = df.select(key, F.col(host).isNull().alias("nohost"), F.col(text).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), normal), lambda x: x != "")
    hashes = F.array_distinct(F.transform(lines, line_hash))
    counts = pages.select("host", "nohost", F.explode(hashes).alias("line")).groupBy("host", "nohost", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("host", "nohost").agg(F.count(F.lit(1)).alias("pages"))
    often = (
        counts.where(F.col("n") > limit(F.lit(0)))
        .join(totals, ["host", "nohost"])
        .where(F.col("n") > limit(F.col("pages")))
        .groupBy("host", "nohost")
        .agg(F.sort_array(F.collect_list("line")).alias(out))
    )
    often = written(often, "frequent-lines")
    size = often.agg(F.sum(F.size(out) * 8 + F.length("host") + 64)).first()[0] or 0
    left = df.withColumns({"__host": F.coalesce(F.col(host), F.lit("")), "__nohost": F.col(host).isNull()})
    right = often.select(F.col("host").alias("__host"), F.col("nohost").alias("__nohost"), out)
    on = ["__host", "__nohost"]
    if size <= BROADCAST_BYTES:
        joined = left.join(F.broadcast(right), on, "left")
    else:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = left.join(right, [*on, "__salt"], "left").drop("__salt")
    return joined.drop(*on)

"""Line dedup by site-relative frequency.

Group pages by host, divide the pages that hold a line by all pages of the host, and drop the line from
every page of that host where the ratio exceeds `ratio` and at least `min_pages` pages hold it. Lines
compare without the white space around them; a blank line is no line and always stays. The text of a page
is read once more to cut the lines out; it is not shuffled.

Cases: a null text stays null with 0 lines; an empty text stays empty; null is a host of its own, apart
from the empty name; a line repeated within a page counts once for it and is dropped everywhere in it; rows
are pages, repeated rows too; an empty table gives an empty table; other columns pass through, and columns
that already have the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .site_lines import line_hash, stripped, with_frequent

RATIO = 0.05
MIN_PAGES = 5


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with boilerplate lines cut from text, and n_lines (with a word) and n_dropped of each page."""
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    found = with_frequent(df.select(columns), host, text, stripped, lambda pages: F.greatest(F.lit(float(min_pages) - 0.5), pages * F.lit(float(ratio))), "__drop")
    split = found.withColumn("__lines", F.split(text, "\n"))
    kept = split.withColumn("__kept", F.when(F.col("__drop").isNotNull(), F.filter("__lines", lambda x: ~F.array_contains(F.col("__drop"), line_hash(stripped(x))))))
    return kept.select(
        *[F.coalesce(F.array_join("__kept", "\n"), F.col(text)).alias(c) if c == text else F.col(c) for c in columns],
        F.coalesce(F.size(F.filter("__lines", lambda x: stripped(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__kept").isNotNull(), F.size("__lines") - F.size("__kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
f AS (SELECT c.source, list(line) AS dropped FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE) GROUP BY c.source),
k AS (SELECT doc_id, d.source, text, lines, dropped,
        CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) END AS kept
      FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
  CAST(len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped
FROM k
"""

"""Quality rules with cross-document line frequency.

Base rules look at one text: too few words, or too many words inside 8-word windows that the text repeats.
The method then hashes normalised lines (lower case, white space collapsed), counts the documents of each
host that hold a line, removes lines that more than max(min_docs, share * documents of the host) hold, and
rejects a document that keeps less than `least` of its words. All of it is DataFrame functions; a text is
never shuffled and its repeated windows are found by sorting hashes inside its own row.

Cases: a null or empty text has no words and fails the base rules; null is a host of its own; rows are
documents, repeated rows too; ties do not occur; an empty table gives an empty table; other columns pass
through `apply_rules`, and columns that already have the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .site_lines import SPACES, line_hash, stripped, with_frequent

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SHARE = 0.05
MIN_DOCS = 20
LEAST = 0.3
SYMBOLS = "#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept")


def normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(line), r"[\x20\x09-\x0D]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def apply_rules(df: DataFrame, host: str = "source", text: str = "text", share: float = SHARE, min_docs: int = MIN_DOCS, least: float = LEAST) -> DataFrame:
    """df with the base figures, the words left after frequent lines are gone, and the verdict."""
    columns = [c for c in df.columns if c not in COLUMNS]
    found = with_frequent(df.select(columns), host, text, normal, lambda docs: F.greatest(F.lit(float(min_docs)), docs * F.lit(float(share))), "__drop")
    t = F.coalesce(F.col(text), F.lit(""))
    step = found.withColumns({"__words": F.transform(words(t), lambda w: F.xxhash64(w)), "__lines": F.split(t, "\n")})
    step = step.withColumns({
        "__full": F.filter("__lines", lambda x: stripped(x) != ""),
        "__windows": F.when(F.size("__words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))),
    })
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumn("__sorted", F.when(F.col("__windows").isNotNull() & twice, F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("h"), i.alias("i"))))))
    same = lambda x, j: (F.coalesce(F.try_element_at("__sorted", j + 2)["h"] == x["h"], F.lit(False))) | F.when(j > 0, F.coalesce(F.try_element_at("__sorted", j)["h"] == x["h"], F.lit(False))).otherwise(F.lit(False))
    step = step.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.array_sort(F.transform(F.filter("__sorted", same), lambda x: x["i"]))))
    gap = lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at("__at", j + 2) - p, F.lit(WINDOW)))
    repeated = F.when(F.col("__at").isNotNull(), F.aggregate(F.transform("__at", gap), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    left = F.filter("__lines", lambda x: ~F.array_contains(F.col("__drop"), line_hash(normal(x))))
    step = step.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
        "n_words_left": F.when(F.col("__drop").isNotNull(), F.size(words(F.array_join(left, "\n")))).otherwise(F.size("__words")).cast("long"),
    })
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    return step.select(*columns, *COLUMNS[:-1], (~F.col("base_failed") & (F.col("n_words_left") >= F.col("n_words") * F.lit(float(least)))).alias("kept"))


_WS = r"[\x20\x09-\x0D]"
_NORMAL = f"lower(trim(regexp_replace(x, '{_WS}+', ' ', 'g'), ' '))"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS words FROM d),
e AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: {_NORMAL}), lambda x: x <> ''))) AS line FROM s),
c AS (SELECT source, line, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT source, count(*) AS docs FROM d GROUP BY ALL),
f AS (SELECT c.source, list(line) AS dropped FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > {MIN_DOCS} AND n > docs * CAST({SHARE} AS DOUBLE) GROUP BY c.source),
w AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s WHERE len(words) >= {WINDOW})),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM r WHERE n > 1) GROUP BY doc_id),
a AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(CASE WHEN dropped IS NULL THEN len(words) ELSE len(list_filter(string_split_regex(array_to_string(list_filter(lines, lambda x: NOT list_contains(dropped, {_NORMAL})), chr(10)), '{_WS}+'), lambda x: x <> '')) END AS BIGINT) AS n_words_left
  FROM s LEFT JOIN p USING (doc_id) LEFT JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND n_words_left >= n_words * CAST({LEAST} AS DOUBLE) AS kept
FROM a
"""

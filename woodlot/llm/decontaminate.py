"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Both sides are brought to templates: numbers become 0, capitalised words (names) become 1 wherever they
stand, units after a number become 2, the rest is lower case without punctuation. Windows of WORDS template
tokens with at least LITERALS tokens of their own are hash-joined. An item has a second list of windows, the
literal one, where names are lower-case words, so that a copy in other case is found as well; either list
decides for itself.

The windows of a text that match an item fall on diagonals (position in the text less position in the item).
On a diagonal each slot of the item has one value: a name, a unit, or a number with the word after it (so
that "2 apples and 2 pears" are two slots). What most places of a slot hold is its value, the least of
equals; windows over a place that holds something else do not count. An item is in a text when the windows
that count are SHARE of a list, so a question whose numbers or names were exchanged is found, and one
whose template merely agrees while its values contradict each other is not.

Two passes over the documents: the first hashes windows and keeps (text, item) pairs with enough matching
windows; the second looks at the few texts kept. A text without any of the benchmark's marks is not hashed:
marks of a list are words, its longest first, that stand in so many of its windows that the others are less
than SHARE, so a text that holds an item has one of them. Beyond MARKS of them all texts are hashed. The
windows of the benchmark, and the pairs, are broadcast only when their measured number of rows is within a
bound, else joined by shuffle.

Cases: the verdict of a row depends on its text alone, so rows without doc_id, rows of one doc_id and
repeated rows are each judged; a null or empty text holds nothing. An item_id with several texts is found by
any of them. An item of fewer than WORDS words, or without a window of LITERALS literals, is found where a
whole line of a document has its words; an item without words never is. Of items with equal coverage the
smallest item_id is reported; an empty table on either side finds nothing; other columns pass through, and
columns that already have the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = 5
LITERALS = 3
SHARE = 0.8
#: Bounds of what is broadcast: keys of benchmark windows (64 bytes a row as a hash table), and other tables.
KEY_BYTES = 128 << 20
BROADCAST_BYTES = 32 << 20
#: Most marks, which are part of the plan.
MARKS = 4096
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "days", "day", "weeks", "years", "year", "meters", "miles", "feet", "inches", "dollars", "dollar", "cents", "euros", "euro", "pounds", "percent", "degrees", "litres", "grams")
COLUMNS = ("contaminated", "item_id", "coverage")
_UNITS = "|".join(sorted(UNITS, key=len, reverse=True))
_PAIR = ["k", "item_id", "v", "a"]


def collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def templates(flat: Column) -> tuple[Column, Column]:
    """Template of a collapsed text and its literal variant, token for token: a token of punctuation alone becomes empty."""
    numbers = F.regexp_replace(flat, r"[0-9][0-9.,]*", "0")

    def ended(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}01 ]+", ""), rf"(^| )0 (?:{_UNITS})(?= |$)", "$10 2")

    return ended(F.regexp_replace(numbers, r"(?<![^ ])\p{Lu}\p{Ll}+", "1")), ended(numbers)


def words_of(flat: Column) -> Column:
    """The words of a collapsed text as a string: lower case, without punctuation around them."""
    bare = F.regexp_replace(F.lower(flat), r"(?<![^ ])[^\p{L}0-9 ]+|[^\p{L}0-9 ]+(?![^ ])", "")
    return F.btrim(F.regexp_replace(bare, " +", " "))


def _places(tokens: Column) -> Column:
    """First places of the windows of a list of tokens; null without any."""
    n = F.size(tokens) - (WORDS - 1)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda x: ~x.isin("0", "1", "2")))


def _tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, and aligned lists of tokens without empty ones: template (t), literal variant (u), raw (r)."""
    flat = df.select(*keep, collapsed(F.col(text)).alias("flat"))
    t, u = templates(F.col("flat"))
    zipped = F.arrays_zip(F.split(t, " ").alias("t"), F.split(u, " ").alias("u"), F.split(F.lower("flat"), " ").alias("r"))
    full = flat.select(*keep, F.filter(zipped, lambda x: x["t"] != "").alias("p"))
    raw = F.transform("p", lambda x: F.regexp_replace(x["r"], r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""))
    return full.select(*keep, F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["u"]).alias("u"), raw.alias("r"))


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, v (which text of the item), t, u, r."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("v", F.xxhash64("text"))
    return _tokens(items, "text", "item_id", "v")


def item_windows(tokens: DataFrame) -> DataFrame:
    """item_id, v, a (the list, t or u), n (its windows), i, key, t, r, x (the word after each) of windows with LITERALS literals."""
    each = tokens.select("item_id", "v", "t", "u", "r", F.explode(_places(F.col("t"))).alias("i"))
    cut = lambda c: F.slice(c, F.col("i"), WORDS).alias(c)
    after = F.transform(F.sequence(F.col("i") + 1, F.col("i") + WORDS), lambda j: F.coalesce(F.try_element_at("r", j), F.lit("")))
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("t")) for a in "tu"])).alias("w")
    windows = each.withColumn("x", after).select("item_id", "v", "i", cut("t"), cut("u"), cut("r"), "x").select("item_id", "v", "i", "r", "x", both)
    windows = windows.select("item_id", "v", "i", "r", "x", "w.a", "w.t").where(_literals(F.col("t")) >= LITERALS)
    n = windows.groupBy("item_id", "v", "a").agg(F.count(F.lit(1)).alias("n"))
    return windows.join(n, ["item_id", "v", "a"]).withColumn("key", F.xxhash64("t"))


def _hint(df: DataFrame, row_bytes: int, most: int | None = None) -> DataFrame:
    """df, a written table, broadcast within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= (BROADCAST_BYTES if most is None else most) else df


def marks(items: DataFrame) -> list[str] | None:
    """Words of which every text that holds an item has one; None if there are none such, or over MARKS of them."""
    word = F.array_max(F.transform(F.filter("t", lambda x: ~x.rlike("[0-9]")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    count = items.select("item_id", "v", "a", "n", word.alias("w")).groupBy("item_id", "v", "a", "n", "w").agg(F.count("w").alias("c"))
    others = F.col("n") - F.sum("c").over(Window.partitionBy("item_id", "v", "a").orderBy(F.desc("w"))) + F.col("c")
    # a window without such a word comes last, as null
    got = count.withColumn("others", others).where(F.col("others") >= F.col("n") * F.lit(SHARE)).select("w.x").distinct().limit(MARKS + 1).collect()
    return None if len(got) > MARKS or any(r.x is None for r in got) else sorted(r.x for r in got)


def _marked(text: Column, words: list[str]) -> Column:
    """Whether one of the words, which are letters alone, is a token of the text."""
    letters = F.regexp_replace(F.lower(text), r"[^a-z\x20\x09-\x0D\p{L}]+", "")
    return F.arrays_overlap(F.split(letters, r"[\x20\x09-\x0D]+"), F.array(*map(F.lit, words)).cast("array<string>"))


def _key(text: Column) -> Column:
    """What stands for a text: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def matches(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """k (key of a text), item_id, coverage of each item that a text holds."""
    tokens = written(item_tokens(benchmark), "item-tokens")
    items = written(item_windows(tokens), "items")
    docs = documents.select(_key(F.col(text)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    keys = written(items.select("key", "item_id", "v", "a", "i", "n"), "keys")
    t, u = templates(collapsed(F.col("text")))
    words = marks(items)
    hashed = docs if words is None else docs.where(_marked(F.col("text"), words))
    lists = hashed.select("k", F.split(t, " ").alias("t"), F.split(u, " ").alias("u")).select("k", F.filter("t", lambda x: x != "").alias("t"), F.filter("u", lambda x: x != "").alias("u"))
    window = lambda c, i: F.slice(c, i, WORDS)
    plain = F.transform(_places(F.col("t")), lambda i: F.xxhash64(window("t", i)))
    names = F.filter(F.transform("t", lambda x, i: F.when(x == "1", i + 1)), lambda p: p.isNotNull())
    first, last = lambda p: F.greatest(p - (WORDS - 1), F.lit(1)), lambda p: F.least(p, F.size("t") - (WORDS - 1))
    named = F.when(F.size("t") >= WORDS, F.array_distinct(F.flatten(F.transform(names, lambda p: F.sequence(first(p), last(p))))))
    each = lists.select("k", F.explode(F.concat(plain, F.transform(named, lambda i: F.xxhash64(window("u", i))))).alias("key"))
    enough = F.col("hits") >= F.col("n") * F.lit(SHARE)
    found = each.join(_hint(keys, 64, KEY_BYTES), "key").groupBy(*_PAIR, "n").agg(F.count_distinct("i").alias("hits")).where(enough)
    found = written(found.select(*_PAIR, "n"), "candidates")

    wanted = written(found.select("k").distinct(), "wanted")
    some = docs.join(_hint(wanted, 64), "k", "left_semi").dropDuplicates(["k"])
    at = _tokens(some, "text", "k").select("k", "t", "u", "r", F.explode(_places(F.col("t"))).alias("p"))
    cut = lambda c: F.slice(c, F.col("p"), WORDS)
    at = at.select("k", "p", cut("t").alias("t"), cut("u").alias("u"), cut("r").alias("d"))
    either = F.array_compact(F.array(F.col("t"), F.when(F.col("t") != F.col("u"), F.col("u"))))
    windows = at.select("k", "p", "d", F.explode(either).alias("t")).withColumn("key", F.xxhash64("t"))
    hits = windows.join(_hint(items, 400).withColumnRenamed("t", "own"), "key").where("t = own").join(found, [*_PAIR, "n"])
    hits = written(hits.select(*_PAIR, "n", "i", (F.col("p") - F.col("i")).alias("diagonal"), "t", "r", "x", "d"), "hits")

    line = [*_PAIR, "diagonal"]
    places = F.arrays_zip(F.col("t"), F.col("r"), F.col("x"), F.col("d"), F.sequence(F.col("i"), F.col("i") + (WORDS - 1)).alias("j"))
    slots = hits.select(*line, F.explode(F.filter(places, lambda s: s["t"].isin("0", "1", "2"))).alias("s"))
    slots = slots.select(*line, F.col("s.j").alias("j"), F.col("s.t").alias("t"), F.col("s.r").alias("r"), F.when(F.col("s.t") == "0", F.col("s.x")).otherwise("").alias("x"), F.col("s.d").alias("d")).distinct()
    slot = [*line, "t", "r", "x"]
    votes = slots.groupBy(*slot, "d").agg(F.count(F.lit(1)).alias("c"))
    value = votes.groupBy(*slot).agg(F.min(F.struct((-F.col("c")).alias("c"), "d")).alias("m")).select(*slot, F.col("m.d").alias("value"))
    bad = slots.join(value, slot).where("d <> value").select(*line, F.explode(F.sequence(F.col("j") - (WORDS - 1), F.col("j"))).alias("i")).distinct()
    good = hits.join(bad, [*line, "i"], "left_anti").groupBy(*_PAIR, "n").agg(F.count_distinct("i").alias("hits")).where(enough)
    good = good.select("k", "item_id", (F.col("hits") / F.col("n")).alias("coverage"))

    short = tokens.join(items.select("item_id", "v").distinct(), ["item_id", "v"], "left_anti").where(F.size("r") > 0)
    short = written(short.select("item_id", F.array_join("r", " ").alias("line")).distinct(), "short-items")
    if not short.limit(1).count():
        return good
    lines = docs.select("k", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: words_of(collapsed(x))))).alias("line"))
    return good.unionByName(lines.join(_hint(short, 200), "line").select("k", "item_id", F.lit(1.0).alias("coverage")))


def flag(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """documents with contaminated, and the best item with its coverage (null without one)."""
    columns = [c for c in documents.columns if c not in COLUMNS]
    best = matches(documents, benchmark, text).groupBy("k").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("__best"))
    best = written(best, "contaminated").withColumnRenamed("k", "__k")
    out = documents.select(*columns).join(_hint(best, 96), _key(F.col(text)) == F.col("__k"), "left")
    return out.select(*columns, F.col("__best").isNotNull().alias("contaminated"), F.col("__best.item_id").alias("item_id"), (-F.col("__best.c")).alias("coverage"))


_EDGES = r"^[^\p{L}0-9]+|[^\p{L}0-9]+$"


def _sql_tokens(table: str, keys: str) -> str:
    """keys, text and the lists t, u, r."""
    done = r"regexp_replace(lower({}), '[^\p{{L}}01]+', '', 'g')"
    unit = f"CASE WHEN i > 1 AND {{0}}[i - 1] = '0' AND list_contains([{', '.join(f"'{u}'" for u in UNITS)}], {{0}}[i]) THEN '2' ELSE {{0}}[i] END"
    return rf"""
    (SELECT {keys}text, list_transform(p, lambda x: x.t) AS t, list_transform(p, lambda x: x.u) AS u, list_transform(p, lambda x: x.r) AS r FROM (
      SELECT {keys}text, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'t': {unit.format("a")}, 'u': {unit.format("b")}, 'r': regexp_replace(lower(w[i]), '{_EDGES}', '', 'g')}}), lambda x: x.t <> '') AS p FROM (
        SELECT {keys}text, w, list_transform(z, lambda x: {done.format("regexp_replace(x, '^\\p{Lu}\\p{Ll}+', '1')")}) AS a, list_transform(z, lambda x: {done.format("x")}) AS b FROM (
          SELECT {keys}text, w, list_transform(w, lambda x: regexp_replace(x, '[0-9][0-9.,]*', '0', 'g')) AS z FROM (
            SELECT {keys}text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT {keys}coalesce(text, '') AS text FROM {table}))))))"""


def _sql_windows(table: str, rows: str, only: str = "true") -> str:
    """A row for each window of table and list (a): rows is what to select, only a condition on the literal list's."""
    each = f"(SELECT *, unnest(range(1, len(t) - {WORDS - 2})) AS i FROM {table} WHERE len(t) >= {WORDS})"
    cut = f"[i:i + {WORDS - 1}]"
    return f"SELECT {rows}, 't' AS a, t{cut} AS t FROM {each} UNION ALL SELECT {rows}, 'u', u{cut} FROM {each} WHERE {only.format(cut=cut)}"


SQL = f"""
WITH b AS {_sql_tokens("benchmark", "item_id, ")},
d AS {_sql_tokens("documents", "")},
bw AS (SELECT * FROM ({_sql_windows("b", f"item_id, text AS v, i, r[i:i + {WORDS - 1}] AS r, list_transform(range(i + 1, i + {WORDS + 1}), lambda j: coalesce(r[j], '')) AS x")}) WHERE len(list_filter(t, lambda y: y NOT IN ('0', '1', '2'))) >= {LITERALS}),
bn AS (SELECT item_id, v, a, count(*) AS n FROM bw GROUP BY ALL),
dw AS ({_sql_windows("d", f"text AS k, i, r[i:i + {WORDS - 1}] AS d", "t{cut} <> u{cut}")}),
h AS (SELECT k, bw.item_id, bw.v, bw.a, n, bw.i, dw.i - bw.i AS diagonal, bw.t, r, x, d FROM dw JOIN bw ON dw.t = bw.t JOIN bn ON bn.item_id IS NOT DISTINCT FROM bw.item_id AND bn.v = bw.v AND bn.a = bw.a),
s AS (SELECT DISTINCT k, item_id, v, a, diagonal, i + q - 1 AS j, t[q] AS t, r[q] AS r, CASE WHEN t[q] = '0' THEN x[q] ELSE '' END AS x, d[q] AS d FROM (SELECT *, unnest(range(1, {WORDS + 1})) AS q FROM h) WHERE t[q] IN ('0', '1', '2')),
m AS (SELECT k, item_id, v, a, diagonal, t, r, x, d AS value FROM (SELECT k, item_id, v, a, diagonal, t, r, x, d, count(*) AS c FROM s GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k, item_id, v, a, diagonal, t, r, x ORDER BY c DESC, d) = 1),
bad AS (SELECT DISTINCT k, item_id, v, a, diagonal, unnest(range(j - {WORDS - 1}, j + 1)) AS i FROM s JOIN m USING (k, item_id, v, a, diagonal, t, r, x) WHERE d <> value),
g AS (SELECT k, item_id, v, a, n, count(DISTINCT i) AS hits FROM h ANTI JOIN bad USING (k, item_id, v, a, diagonal, i) GROUP BY ALL),
l AS (SELECT DISTINCT text AS k, array_to_string(list_filter(list_transform(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda y: regexp_replace(lower(y), '{_EDGES}', '', 'g')), lambda y: y <> ''), ' ') AS line FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM d)),
o AS (SELECT item_id, array_to_string(r, ' ') AS line FROM b ANTI JOIN bn ON bn.item_id IS NOT DISTINCT FROM b.item_id AND bn.v = b.text WHERE len(r) > 0),
f AS (SELECT k, item_id, hits / n AS coverage FROM g WHERE hits >= n * CAST({SHARE} AS DOUBLE) UNION ALL SELECT k, item_id, 1.0 FROM o JOIN l USING (line)),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY coverage DESC, item_id) = 1)
SELECT doc_id, k IS NOT NULL AS contaminated, item_id, coverage FROM documents LEFT JOIN z ON coalesce(text, '') = k
"""

"""Near-duplicates by DartMinHash signatures, banded joining and verified links.

A text is the weighted set of its shingles of five words; the weight is the number of occurrences, so two
texts compare by weighted Jaccard similarity. Each unit of weight is a region into which darts are thrown
by hash: a dart has a rank and a coordinate. Ranks come in levels [0, 1/256), [1/256, 2/256), then doubling;
darts of a level follow a Poisson count drawn by hash. Each coordinate of a document keeps its earliest
dart, and a document throws levels until every coordinate has one. Equal texts have one signature.

Bands of ROWS coordinates meet in a hash join. In a bucket, texts of other components than the pivot's are
compared with the pivot (rounds of up to PIVOTS pivots not used before, drawn by hash from all but the
largest component, until none is left unused), so a bucket of n like texts costs n comparisons and no pair
of different components is skipped. The share of equal coordinates decides a pair when it is further than 5.4 standard
deviations from the threshold (below LOW or above HIGH); between, or for all pairs with exact=True, the
similarity of the two whole texts does. Links never reach the driver: components come from contraction by
least neighbour. What meets in buckets are distinct texts; each is known by the least doc_id that has it.

Cases: null and empty texts are equal texts and form one class; a text of one to four words is one
shingle; the class id is the least doc_id; a doc_id with several texts ties their classes, and `dedupe`
keeps the text of least hash; rows without doc_id have no class (null) and stay; repeated rows share a
class, and `dedupe` keeps one of them; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, arrow_rows, batch_of, discard, list_array, mix, slices, unhash, utf8, words, written
from .exchange import pack, unpack

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 8
K = BANDS * ROWS
LOW, HIGH = 0.68, 0.92
PIVOTS = 64
BROADCAST_BYTES = 32 << 20
SLICE = 400_000
_ODD = U64(0x9E3779B97F4A7C15)


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every unit of weight, row by row, and how many each row has."""
    _, _, per, h = words(raw, offsets)
    return _units(h, per)


def _units(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    row = np.repeat(np.arange(len(per)), per)
    first = np.concatenate([[0], np.cumsum(per)])
    size = np.minimum(per, SHINGLE)[row] if n else row
    position = np.arange(n) - first[row]
    starts = np.flatnonzero(position + size <= per[row])
    key = np.zeros(len(starts), U64)
    for j in range(SHINGLE):
        at = starts + j
        inside = j < size[starts]
        key = mix(key * _ODD + np.where(inside, h[np.minimum(at, max(n - 1, 0))], U64(j + 1)))
    row = row[starts]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else row
    return mix(key + run.astype(U64) * _ODD), np.bincount(row, minlength=len(per)).astype(np.int64)


@functools.cache
def _poisson(rate: float) -> np.ndarray:
    """Cumulative Poisson probabilities up to where the rest is below 2**-53."""
    top = int(rate + 12 * rate**0.5 + 30)
    k = np.arange(1, top + 1)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(rate) - np.log(k))]) - rate))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(unit: np.ndarray, per: np.ndarray, k: int = K) -> np.ndarray:
    """Earliest rank (float64) of each coordinate of each row; inf for a row without units."""
    out = np.full((len(per), k), np.inf)
    row = np.repeat(np.arange(len(per)), per)
    start, width, level = 0.0, 2.0**-8, 0
    while len(row):
        seed = mix(unit ^ U64((level + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        count = np.searchsorted(_poisson(k * width), _uniform(mix(seed + U64(1))), side="right")
        which = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(seed[which] + (nth.astype(U64) + U64(2)) * _ODD)
        rank = start + width * _uniform(dart)
        at = row[which] * k + ((dart & U64(0xFFFF_FFFF)) % U64(k)).astype(np.int64)
        np.minimum.at(out.reshape(-1), at, rank)
        open_ = np.isinf(out).any(axis=1)[row]
        row, unit = row[open_], unit[open_]
        start, level = start + width, level + 1
        width = start
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(U64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * _ODD, (len(sig), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key + bits[:, :, j])
    return key


def _sketch(df: DataFrame) -> DataFrame:
    """doc_id, h, bands (none for a text without words), one byte of each coordinate; df: doc_id, h, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("bands", pa.list_(pa.int64())), ("coords", pa.binary())])

    def run(batches):
        for whole in batches:
            raw, offsets = utf8(whole.column(2))
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1]
                unit, per = units(raw[o[0] : o[-1]], o - o[0])
                sig = signatures(unit, per)
                some = per > 0
                keys = band_keys(sig[some])
                low = np.zeros(sig.shape, np.uint8)
                low[some] = (mix(sig[some].view(U64)) & U64(255)).astype(np.uint8)
                yield batch_of(schema, doc_id=whole.column(0).slice(i, j - i), h=whole.column(1).slice(i, j - i), bands=list_array(unhash(keys.reshape(-1)), some * BANDS, pa.int64()), coords=pa.array([x.tobytes() for x in low], pa.binary()))

    return df.mapInArrow(run, "doc_id long, h binary, bands array<long>, coords binary")


def _unlike(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, root (least id of its component) for every id in links (a, b)."""
    roots, edges, old = None, written(_unlike(links), "edges"), []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parent = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p"), "parents")
        if roots is None:
            roots = parent.select("id", F.col("p").alias("root"))
        else:
            step = parent.select(F.col("id").alias("root"), "p")
            roots = roots.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        pa_, pb = parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        old += [edges, parent]
        edges, was = written(_unlike(edges.join(pa_, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges"), roots
        roots = written(roots, "roots")
        if hasattr(was, "written_to"):
            old.append(was)
    discard(edges, *old)
    return roots if roots is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _compare(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """a, b, share of equal coordinates, freed of chance agreements of one byte."""
    left = sketch.select(F.col("id").alias("a"), F.col("coords").alias("ca"))
    right = sketch.select(F.col("id").alias("b"), F.col("coords").alias("cb"))

    def run(batches):
        for b in batches:
            x, _ = utf8(b.column(2))
            y, _ = utf8(b.column(3))
            same = (x.reshape(-1, K) == y.reshape(-1, K)).mean(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((same - 1 / 256) / (1 - 1 / 256))], ["a", "b", "share"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long, share double")


def _exact(pairs: DataFrame, docs: DataFrame, texts: DataFrame, threshold: float, repeats: bool) -> DataFrame:
    """Pairs whose whole texts have the similarity, by 40 bits of each unit's hash. repeats: rows may come twice."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select("id", F.col("first").alias("doc_id"), F.col("h").alias("__h"))
    wanted = written(wanted, "wanted")
    few = wanted.count() * 64 <= BROADCAST_BYTES
    some = docs.select("doc_id", "h", "text").join(F.broadcast(wanted) if few else wanted, "doc_id").where("h = __h").select("id", "text")

    def sets(batches):
        for whole in batches:
            raw, offsets = utf8(whole.column(1))
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1]
                unit, per = units(raw[o[0] : o[-1]], o - o[0])
                at = np.concatenate([[0], np.cumsum(per)])
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(i, j - i), pa.array([pack(np.sort(unit[a:b] >> U64(24))) for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "units"])

    def judge(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = unpack(x.as_py())[0].astype(U64), unpack(y.as_py())[0].astype(U64)
                both = len(np.intersect1d(p, q))
                ok.append(both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with arrow_rows(docs.sparkSession, 1000):
        made = some.mapInArrow(sets, "id long, units binary")
        table = written(made.dropDuplicates(["id"]) if repeats else made, "units")
    discard(wanted)
    left = table.select(F.col("id").alias("a"), F.col("units").alias("ua"))
    right = table.select(F.col("id").alias("b"), F.col("units").alias("ub"))
    with arrow_rows(docs.sparkSession, 300):
        out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(judge, "a long, b long"), "near-links")
    discard(table)
    return out


def classes(df: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, class_id for each doc_id; df has doc_id and text. exact: every candidate pair is decided on whole texts."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = rows.where("doc_id IS NOT NULL").select("doc_id", F.unhex(F.md5("text")).alias("h"), "text")
    with arrow_rows(spark, 1000):
        sketch = written(_sketch(docs), "sketch")
    texts = written(sketch.groupBy("h").agg(F.min("doc_id").alias("first")), "texts")
    # a doc_id that is the least of several texts is the id of one of them; the others get ids below all others
    many = written(texts.groupBy("first").agg(F.min("h").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "many")
    if many.limit(1).count():
        other = F.col("own").isNotNull() & (F.col("own") != F.col("h"))
        texts = texts.join(many, "first", "left").select("h", "first", F.when(other, F.lit(-(1 << 62)) - F.monotonically_increasing_id()).otherwise(F.col("first")).alias("id"))
        texts = written(texts, "texts")
    else:
        texts = texts.withColumn("id", F.col("first"))
    # the texts of one doc_id are tied, whether they are alike or not
    owners = sketch.select("doc_id", "h").join(texts, "h").groupBy("doc_id").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    owners = written(owners, "owners")
    repeats = owners.where("n > 1").limit(1).count() > 0
    tied = owners.where("id < last")
    several = repeats and tied.limit(1).count() > 0
    ties = sketch.select("doc_id", "h").join(texts, "h").select("doc_id", F.col("id").alias("b")).join(tied.select("doc_id", F.col("id").alias("a")), "doc_id").where("a <> b").select("a", "b")
    only = sketch.join(texts.select("h", F.col("first").alias("doc_id"), "id"), ["h", "doc_id"]).select("id", "bands", "coords")
    only = written(only.dropDuplicates(["id"]) if repeats else only, "representatives")
    bands = only.select("id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = written(bands.join(shared, "key"), "buckets")
    links = ties if several else spark.createDataFrame([], "a long, b long")
    tested = spark.createDataFrame([], "a long, b long")
    low, high = (0.0, 2.0) if exact else (LOW + threshold - THRESHOLD, HIGH + threshold - THRESHOLD)
    used = written(buckets.groupBy("key").agg(F.min("id").alias("pivot")), "pivots")
    roots = live = None
    while True:
        if roots is None:
            pairs = buckets.join(used, "key").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        else:
            labelled = buckets.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
            mixed = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
            if live is not None:
                discard(live)
            live = written(labelled.join(mixed, "key"), "mixed")
            sizes = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m")).select("key", F.col("m.root").alias("big"))
            # all but the largest component of a bucket are pivots in the end; that tests every pair of two components,
            # whatever component is the largest by then, since a used pivot has met all texts it was not yet linked with
            small = live.join(largest, "key").where("root <> big").select("key", F.col("id").alias("pivot"), F.col("root").alias("pr"))
            order = Window.partitionBy("key").orderBy(F.xxhash64("pivot"), "pivot")
            now = small.join(used, ["key", "pivot"], "left_anti").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS).drop("nth")
            now = written(now, "pivots")
            if not now.limit(1).count():
                break
            pairs = live.join(now, "key").where("root <> pr").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
            used = used.union(now.select("key", "pivot"))
        fresh = written(_unlike(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        if fresh.limit(1).count():
            shares = written(_compare(fresh, only), "shares")
            near = (fresh if exact else shares.where((F.col("share") < high) & (F.col("share") >= low))).select("a", "b")
            links = links.union(shares.where(F.col("share") >= high).select("a", "b"))
            if near.limit(1).count():
                links = links.union(_exact(near, docs, texts, threshold, repeats))
            tested = tested.union(fresh)
            roots = components(links)
        elif roots is None:
            roots = components(links) if several else None
            break
    out = owners.select("doc_id", "id")
    if roots is not None:
        if several:  # made ids are no doc_ids: a class is named by the least doc_id of its texts
            least = texts.join(roots, "id").groupBy("root").agg(F.min("first").alias("name"))
            roots = written(roots.join(least, "root").select("id", F.col("name").alias("root")), "names")
        out = out.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("class_id"))
    else:
        out = out.select("doc_id", F.col("id").alias("class_id"))
    discard(sketch, only, buckets)
    return out.unionByName(rows.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def dedupe(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """df with one row of each class: that of its least doc_id."""
    gone = written(classes(df, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "gone")
    few = gone.count() * 64 <= BROADCAST_BYTES
    one = df.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    again = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5(F.coalesce("text", F.lit("")))).alias("__h")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again"), "__h")
    again = written(again, "again")
    if again.limit(1).count():
        same = F.col("doc_id") == F.col("__again")
        twice = one.join(again, same & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__h"))).select(*df.columns).dropDuplicates(["doc_id"])
        one = one.join(again, same, "left_anti").unionByName(twice)
    return one

"""Blobs of arrays between tasks: what operators on billions of small records shuffle instead of rows.

Documents are gathered into chunks, one row each, in shared storage; a chunk's records go to buckets as
one compressed blob for each bucket, sorted and delta-coded, and answers come back as one blob for each
(chunk, bucket) in the order of the request. Records are combined inside a chunk first, so a hot key is at
most one record of each chunk.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, slices, utf8, written

CHUNK_BYTES = 8 << 20
REPLY = "chunk long, bucket int, blob binary"
_TYPES = ("u1", "u2", "u4", "u8", "i8", "f8")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, int64 or float64; a sorted uint64 array is stored as differences."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        delta = a.dtype == U64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if delta:
            a = np.concatenate([a[:1], np.diff(a)])
        if a.dtype.kind == "u":
            top = int(a.max()) if len(a) else 0
            a = a.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8")
        head += [_TYPES.index(a.dtype.str[1:]), int(delta), len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for kind, delta, size in head.tolist():
        t = np.dtype(_TYPES[kind])
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * t.itemsize, at).reshape(t.itemsize, size).T).view(t).reshape(size)
        at += size * t.itemsize
        out.append(np.cumsum(a.astype(U64), dtype=U64) if delta else a)
    return out


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the key space, so that sorted keys are sorted by bucket."""
    return ((key >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def split(bucket: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, past last) of each bucket that a sorted array of buckets holds."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, int(edge[b]), int(edge[b + 1])) for b in range(buckets) if edge[b + 1] > edge[b]]


def chunks(df: DataFrame, make, name: str, target: int = CHUNK_BYTES) -> DataFrame:
    """chunk, blob: rows (doc_id, text, ...) of about target bytes made into blobs, written to shared storage."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            _, offsets = utf8(b.column(1))
            for i, j in slices(offsets, target):
                blob = make(b.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([part * (1 << 24) + n], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])
                n += 1

    return written(df.mapInArrow(run, "chunk long, blob binary"), name)


def requests(table: DataFrame, make, schema: str = REPLY) -> DataFrame:
    """make(chunk, blob) -> rows of schema, for each chunk of the table."""

    def run(batches):
        for b in batches:
            for c, blob in zip(b.column(0).to_pylist(), b.column(1)):
                for row in make(c, blob.as_py()):
                    yield rows_of([row], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return table.mapInArrow(run, schema)


def settle(spark) -> None:
    """Lets Spark's cleaner remove the shuffle files of stages whose tables are written.

    The cleaner acts on collected garbage, and the session still holds its last action: so a small one comes between.
    """
    spark.range(1).count()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


KINDS = {"chunk": pa.int64(), "bucket": pa.int32(), "blob": pa.binary(), "kind": pa.int32()}


def rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[n]) for i, n in enumerate(names)], names)


def reduce(rows: DataFrame, make, schema: str = REPLY) -> DataFrame:
    """make(bucket, [(chunk, blob)] in order of chunk) -> rows of schema, for each bucket."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, table):
        order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
        got = [(table.column("chunk")[int(i)].as_py(), table.column("blob")[int(i)].as_py()) for i in order]
        return pa.Table.from_batches([rows_of(make(key[0].as_py(), got), names)])

    return rows.groupBy("bucket").applyInArrow(run, schema)


def with_replies(table: DataFrame, replies: list[DataFrame], make, schema: str) -> DataFrame:
    """make(chunk, blob, [{bucket: blob} for each of replies]) -> rows of schema, for each chunk."""
    rows = table.select("chunk", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), "blob")
    for i, r in enumerate(replies):
        rows = rows.unionByName(r.select("chunk", F.lit(i).alias("kind"), "bucket", "blob"))
    names, n = [x.split()[0] for x in schema.split(", ")], len(replies)

    def run(key, t):
        own, got = None, [{} for _ in range(n)]
        for k, b, blob in zip(t.column("kind").to_pylist(), t.column("bucket").to_pylist(), t.column("blob")):
            if k < 0:
                own = blob.as_py()
            else:
                got[k][b] = blob.as_py()
        out = make(key[0].as_py(), own, got)
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([rows_of(out, names)])

    return rows.groupBy("chunk").applyInArrow(run, schema)

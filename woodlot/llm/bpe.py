"""BPE encoding and decoding by tree concatenation.

Texts are encoded where they lie, without a shuffle: one pass adds the ids, one turns ids back into text,
and `round_trip` does both in one. A long text is cut into halves down to leaves, wherever the cuts fall;
leaves are encoded side by side, and each join re-encodes a growing window around the cut until both sides
agree (tokenizer.Codec.encode_tree). A run that the vocabulary's pattern does not split (a pre-token of
more than 4 KiB) is a tree of its own (tokenizer.tree_encode). Memory is bounded by one Arrow batch and the
longest single text.

Cases: a null or empty text has no ids and decodes to the empty text; a null list of ids decodes to the
empty text; ids outside the vocabulary decode to nothing; repeated rows are kept, each with its own
result; an empty table gives an empty table; other columns pass through, and a column that already has the
name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, slices
from .tokenizer import codec, default_path

#: Bytes of text, or ids, that are handled at a time: Python objects of one slice alone are alive.
SLICE = 500_000


def _append(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """df with columns of fields computed by make(pyarrow column) -> pyarrow arrays, batch by batch."""
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index(column)
            lengths = pc.binary_length(whole.column(at)) if not pa.types.is_list(whole.column(at).type) else pc.list_value_length(whole.column(at))
            offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
            for i, j in slices(offsets, SLICE):
                b = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*b.columns, *make(b.column(at))], [*b.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)


def _ids(each: list[np.ndarray]) -> pa.Array:
    return list_array(np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64), pa.int32())


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each whole text."""
    path = path or default_path()

    def make(column):
        c = codec(path)
        return [_ids([c.encode_array(t or "") for t in column.to_pylist()])]

    return _append(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that each list of ids stands for; bytes that are no UTF-8 read as U+FFFD."""
    path = path or default_path()

    def make(column):
        c = codec(path)
        return [pa.array([c.decode(x or ()) for x in column.to_pylist()], pa.string())]

    return _append(df, ids, [T.StructField(text, T.StringType())], make)


def round_trip(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded", leaves: str = "n_leaves") -> DataFrame:
    """df with the ids of each whole text, the text decoded from them, and the leaves of the text's tree: encode
    and decode in one pass, so that a task needs one worker."""
    path = path or default_path()

    def make(column):
        c = codec(path)
        each, n = [], []
        for t in column.to_pylist():
            each.append(c.encode_array(t or ""))
            n.append(c.leaves)
        return [_ids(each), pa.array([c.decode(x.tolist()) for x in each], pa.string()), pa.array(n, pa.int32())]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType()), T.StructField(leaves, T.IntegerType())]
    return _append(df, text, fields, make)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the text decoded from them, leaves of the tree."""
    return round_trip(df.select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "n_leaves",
    )

"""Random numbers as pure functions of a seed and keys.

u = first 52 bits of md5('seed|key|...') / 2**52: the same in Spark and in any SQL engine, on every retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys) -> Column:
    """A number in [0, 1) for the keys (columns, or literals of any type)."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def coin(*keys) -> Column:
    return uniform(*keys) < 0.5


def sql_uniform(*keys: str) -> str:
    """The same for the oracle; keys are SQL expressions."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13)) AS BIGINT) / CAST(4503599627370496.0 AS DOUBLE))"

"""Random draws as hashes of a seed and a row's key: the same on every engine, retry and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int, *keys: str | Column) -> Column:
    """The MD5 of seed and keys, joined by bars, in hexadecimal: an order that any engine can name."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)))


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) for each key: the first 52 bits of its hash."""
    return F.conv(F.substring(key_hash(seed, *keys), 1, 13), 16, 10).cast("long") / float(2**52)

"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAST = 100_000
_HOT_KEYS = 1000


def share(total: int) -> int:
    """How many rows of a key one task may get: so many that fewer than _HOT_KEYS keys of ``total`` rows can have more."""
    return max(_LEAST, total // _HOT_KEYS)


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, limit: int, how: str = "inner") -> DataFrame:
    """left.join(right, key) where right has one row a key and says in ``count`` how many rows of left the key has.

    The rows of a key with more than ``limit`` are spread over several tasks, to each of which right's row is copied. The list
    of such keys is broadcast; there are at most left's rows / limit of them. ``count`` is dropped.
    """
    many = F.ceil(F.col(count) / limit).cast("int")
    hot = right.where(F.col(count) > limit).select(key, many.alias("_parts"))
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    spread = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1))
    return spread.join(right.withColumn("_salt", copies).drop(count), [key, "_salt"], how).drop("_salt")

"""Joins of a large table with one small row per key, safe for very frequent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Salts under which each row of a small table stands.
COPIES = 16


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "left",
    copies: int = COPIES,
) -> DataFrame:
    """Join where ``small`` has few rows per key and ``big`` may have very many.

    Each row of ``small`` is copied under ``copies`` salts and ``spread`` (any column that
    varies within a key) picks the salt in ``big``, so a frequent key becomes many keys.
    The copies come from a join with the salts: Spark's estimate knows what that adds, while
    after an explode it broadcasts all copies of a table that only by itself is small.
    """
    salted = big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(copies)))
    salts = small.sparkSession.range(0, copies, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    copied = small.crossJoin(salts.hint("shuffle_replicate_nl"))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def counted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Column,
    few: int = 50_000,
) -> DataFrame:
    """Inner join with a stored table that is small as a rule, but may grow with the input.

    Spark's estimate does not know what explodes and aggregations make of a table, so its
    rows are counted: up to ``few`` are sent to every task, more are salted and shuffled. There
    are no more copies than ``few`` rows would have, so a table that has grown is hardly copied
    at all; Spark splits the partition of a key that is frequent even then.
    """
    rows = small.count()
    if rows <= few:
        return big.join(F.broadcast(small), list(keys))
    return spread_join(big.hint("merge"), small, keys, spread, "inner", max(1, COPIES * few // rows))

"""Patterns and small helpers that several operators share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake import session

# The word and space patterns of the operators' contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole(column: str) -> Column:
    """A text column, a missing text being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it again.

    Like a checkpoint this cuts the lineage, but later steps read only the columns they
    need and Spark knows the table's size. The folder is ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    folder = f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)

"""Connected components of a table of links, without holding them anywhere whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx


def _rooted(parents: DataFrame) -> DataFrame:
    """(child, parent) with every parent a root; parents are smaller than their children."""
    while True:
        above = parents.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        parents = tx.stored(parents.join(above, F.col("parent") == F.col("_c"), "left").select(
            "child", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")), "cc-parents")
        if parents.filter("moved").isEmpty():
            return parents.select("child", "parent")
        parents = parents.select("child", "parent")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after joining the components that ``links`` (a, b) connect.

    Each round hooks every component to the smallest one it touches, follows the hooks to
    their ends by doubling and keeps only links that still lie between components.
    """
    own = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    pairs = links.join(own, F.col("a") == F.col("_id")).select("b", F.col("_component").alias("x")).join(
        own, F.col("b") == F.col("_id")).select("x", F.col("_component").alias("y"))
    while True:
        pairs = tx.stored(pairs.filter("x != y").select(
            F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "cc-links")
        if pairs.isEmpty():
            return labels
        roots = _rooted(tx.stored(pairs.groupBy(F.col("x").alias("child")).agg(F.min("y").alias("parent")), "cc-hooks"))
        at = lambda df, c: df.join(
            roots.select(F.col("child").alias("_c"), F.col("parent").alias("_p")), F.col(c) == F.col("_c"), "left").withColumn(
            c, F.coalesce("_p", c)).drop("_c", "_p")
        labels = tx.stored(at(labels, "component"), "cc-labels")
        pairs = at(at(pairs, "x"), "y")

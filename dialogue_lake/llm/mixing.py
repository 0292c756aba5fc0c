"""Mix sources to target weights by hash thresholds, without sorting documents.

Every document has a hash. Sizes are summed by source and hash bucket; the budget of a
source ends in one bucket, and only that bucket is split again by the next bits of the
hash. Documents below the threshold found so are taken once more than the others.

Sources in code point order, a missing one last, weigh 1, 2, 3, 1, 2, 3, ... A missing
text has size 0. Rows of equal document id share a hash and are taken alike. An empty table gives
an empty result, and other columns are carried along unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx

BITS, LEVELS = 12, 4
MOST_COPIES = 3


def size_of(text: str) -> Column:
    return F.regexp_count(tx.whole(text), F.lit(tx.WORD)).cast("long")


def bucket(key: Column, level: int) -> Column:
    """The hash bits that ``level`` looks at, three hex digits of a digest of the id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1 + level * BITS // 4, BITS // 4), 16, 10).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, rest) from one row per source.

    A target is the weight's share of a common level, but for sources that stop at three
    times their size. In order of size by weight the stopped ones come first, so running
    sums find the level. There are as many rows as sources; documents take no part.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    full = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    cap = MOST_COPIES * F.col("source_size")
    placed = sizes.withColumn("place", F.row_number().over(everything)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    # left / weights: the level if no source from here on is stopped.
    level = placed.withColumns({
        "left": (F.sum("source_size").over(full) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double"),
        "weights": F.sum("weight").over(onward).cast("double"),
    }).withColumn("stopped", cap.cast("double") * F.col("weights") < F.col("left") * F.col("weight"))
    # The first source that is not stopped sets the level of all after it.
    level = level.withColumn("free", F.max((~F.col("stopped")).cast("int")).over(up_to))
    first = lambda name: F.first(F.when(~F.col("stopped"), F.col(name)), ignorenulls=True).over(full)
    level = level.withColumns({"level_left": first("left"), "level_weights": first("weights")})
    target = F.when(F.col("free") == 1, F.col("level_left") * F.col("weight") / F.col("level_weights")).otherwise(cap.cast("double"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return level.withColumn("target", target).withColumn(
        "copies", F.least(F.floor(share), F.lit(MOST_COPIES)).cast("int"),
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).select(
        "source", "source_size", "target", "copies", "rest")


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): the hash prefix below which a source's documents are taken once more.

    ``cut`` is a list of bucket numbers, one for each level. Each level sums only the rows
    of the boundary bucket before it. The last bucket is taken if that comes nearer.
    """
    state = wanted.select("source", F.col("rest").alias("left"), F.array().cast("array<int>").alias("cut"))
    for level in range(LEVELS):
        known = state.select(F.col("source").alias("_source"), "left", "cut")
        in_bucket = tx.all_of([F.get("cut", F.lit(i)) == F.col(f"b{i}") for i in range(level)])
        # One row per source on the right, as many as a table of sources has.
        sums = sized.join(known, _same_source("source", "_source")).filter(in_bucket).groupBy(
            "source", f"b{level}").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("cut").alias("cut"))
        rows = Window.partitionBy("source").orderBy(f"b{level}")
        sums = sums.withColumn("upto", F.sum("words").over(rows)).withColumn("below", F.col("upto") - F.col("words"))
        crossed = sums.filter((F.col("upto") > F.col("left")) & (F.col("below") <= F.col("left")))
        if level == LEVELS - 1:
            nearer = F.col("upto") - F.col("left") < F.col("left") - F.col("below")
            chosen = F.col(f"b{level}") + nearer.cast("int")
        else:
            chosen = F.col(f"b{level}")
        found = crossed.select(F.col("source").alias("_source"), (F.col("left") - F.col("below")).alias("_left"), chosen.alias("_b"))
        # A source without a crossing wants nothing more: its threshold stays at zero.
        state = tx.stored(state.join(found, _same_source("source", "_source"), "left").select(
            "source", F.coalesce("_left", "left").alias("left"),
            F.concat("cut", F.array(F.coalesce("_b", F.lit(0)))).alias("cut")), "mix-level")
    return state.select("source", "cut")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, times) for every row of ``docs``."""
    sized = tx.stored(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"),
        *[bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), i).alias(f"b{i}") for i in range(LEVELS)]), "mix-sizes")
    wanted = tx.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    plan = wanted.join(thresholds(sized, wanted).withColumnRenamed("source", "_s"), _same_source("source", "_s")).drop("_s")
    once_more = F.array(*[F.col(f"b{i}") for i in range(LEVELS)]) < F.col("cut")
    return sized.withColumnRenamed("source", "_source").join(plan, _same_source("_source", "source")).select(
        F.col("key").alias(key), F.col("_source").alias(source), "size", "source_size", "target",
        (F.col("copies") + once_more.cast("int")).alias("times"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    The thresholds are found on sizes alone and applied to the rows by source and hash.
    A document without words belongs to no budget and stays once.
    """
    sized = tx.stored(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"),
        *[bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), i).alias(f"b{i}") for i in range(LEVELS)]), "mix-sizes")
    wanted = tx.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    plan = wanted.join(thresholds(sized, wanted).withColumnRenamed("source", "_s"), _same_source("source", "_s")).select(
        F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"), F.col("cut").alias("_mix_cut"))
    own = F.array(*[bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), i) for i in range(LEVELS)])
    times = F.when(size_of(text) > 0, F.col("_mix_copies") + (own < F.col("_mix_cut")).cast("int")).otherwise(1)
    return docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn(
        "_mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])

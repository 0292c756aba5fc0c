"""Joins and sweeps over time intervals, all in whole milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.operators import ordered

BIN_MS = 10_000
BUCKET_MS = 600_000


def _bins(start: Column, end: Column, width: int) -> Column:
    """Every bin an interval touches, ends included; points touch exactly one."""
    first = F.floor(start / F.lit(width)).cast("bigint")
    last = F.floor(F.greatest(start, end) / F.lit(width)).cast("bigint")
    return F.sequence(first, last)


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    condition: Column,
    width: int = BIN_MS,
) -> DataFrame:
    """Inner join of rows whose closed spans meet, filtered by ``condition``.

    Column names other than ``keys`` must differ on the two sides. Both sides are spread
    over fixed time bins, so a long meeting becomes many join keys. A pair is kept only
    in the first bin both sides share, which makes a later distinct unnecessary. Spark's
    size estimate does not know the copies, so neither side may be broadcast.
    """
    keys = list(keys)
    a = left.withColumn("_la", F.floor(left_span[0] / F.lit(width)).cast("bigint")).withColumn(
        "_bin", F.explode(_bins(*left_span, width))
    )
    b = right.withColumn("_rb", F.floor(right_span[0] / F.lit(width)).cast("bigint")).withColumn(
        "_bin", F.explode(_bins(*right_span, width))
    )
    joined = a.join(b.hint("merge"), [*keys, "_bin"])
    return joined.filter((F.col("_bin") == F.greatest("_la", "_rb")) & condition).drop(
        "_bin", "_la", "_rb"
    )


#: Bins a span of any length fits: each level is this many times as wide as the one below.
LEVELS, WIDER = 9, 4


def home_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    condition: Column,
    width: int = BIN_MS,
) -> tuple[DataFrame, list[str], Column]:
    """Left join on ``meeting_id`` of rows whose closed spans meet, each left row in one bin.

    Returns the rows, the key they are dealt by, and which of them are pairs; a left row
    without any pair stays. A group by that key and a left row's ids needs no shuffle.

    A left row stands in the bin where it begins, on the first level whose bins are no
    shorter than it is, so it ends in the next bin at the latest. A right row is copied
    to every bin it touches and the one before, on every level; above the last one a
    meeting is one bin. Wide bins hold long left rows only.
    """
    widths = [width * WIDER**k for k in range(LEVELS)]
    length = F.greatest(left_span[1] - left_span[0], F.lit(0))
    level, bin_ = F.lit(LEVELS), F.lit(0).cast("bigint")
    for k, w in reversed(list(enumerate(widths))):
        level = F.when(length <= w, F.lit(k)).otherwise(level)
        bin_ = F.when(length <= w, F.floor(left_span[0] / F.lit(w)).cast("bigint")).otherwise(bin_)
    first, last = right_span[0], F.greatest(*right_span)

    def on(level: int) -> Column:
        w = F.lit(widths[level])
        bins = F.sequence(F.floor(first / w).cast("bigint") - 1, F.floor(last / w).cast("bigint"))
        return F.transform(bins, lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin")))

    whole = F.array(F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("bigint").alias("bin")))
    a = left.withColumns({"_level": level, "_bin": bin_})
    b = right.withColumn("_place", F.explode(F.concat(*map(on, range(LEVELS)), whole))).withColumns(
        {"_level": F.col("_place.level"), "_bin": F.col("_place.bin"), "_found": F.lit(True)}).drop("_place")
    dealt = ["meeting_id", "_level", "_bin"]
    return a.join(b.hint("merge"), dealt, "left"), dealt, F.coalesce(F.col("_found") & condition, F.lit(False))


def range_collect(
    left: DataFrame,
    right: DataFrame,
    ids: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    condition: Column,
    value: Column,
    out: str,
    width: int = BIN_MS,
) -> DataFrame:
    """Every left row with the sorted array of ``value`` over its matching right rows.

    For spans with few matches each. ``ids`` identify a left row within its meeting;
    ``right`` is joined on ``meeting_id``. The array is made where the rows met, so a
    left row is shuffled once.
    """
    key = ["meeting_id", *ids]
    rest = [c for c in left.columns if c not in key]
    joined, dealt, match = home_join(left, right, left_span, right_span, condition, width)
    return (
        joined.groupBy(*dealt, *ids)
        .agg(
            F.first(F.struct(*rest)).alias("_rest"),
            F.array_sort(F.collect_list(F.when(match, value))).alias(out),
        )
        .select(*key, "_rest.*", out)
        .select(*left.columns, out)
    )


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)).cast("bigint")


def coalesce_intervals(
    df: DataFrame,
    keys: Sequence[str],
    observed: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    width: int = BUCKET_MS,
) -> DataFrame:
    """Merge intervals that touch and agree in every ``observed`` column."""
    carried = [end, start, *observed]

    def is_new(before, now):
        changed = before(end) != now(start)
        for name in observed:
            changed = changed | ~before(name).eqNullSafe(now(name))
        return changed

    marked = ordered.islands(
        df.select(*keys, start, end, *observed),
        keys,
        [start],
        ordered.bucket_of(start, width),
        carried,
        is_new,
        out="_island",
    )
    return (
        marked.groupBy(*keys, "_island", *observed)
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .select(*keys, start, end, *observed)
    )


def union_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    width: int = BUCKET_MS,
) -> DataFrame:
    """Union of possibly overlapping intervals per key; touching ones merge."""
    bucket = ordered.bucket_of(start, width)
    spans = df.select(*keys, start, end).groupBy(*keys, start).agg(F.max(end).alias(end))
    reached = ordered.scan(
        spans, keys, [start], bucket, [ordered.running_max("_reach", F.col(end))]
    ).withColumn(
        "_opens",
        F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start)),
    )
    owned = ordered.scan(
        reached, keys, [start], bucket, [ordered.last_before("_island", F.col("_opens"))]
    )
    return (
        owned.groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def elementary_intervals(points: DataFrame, keys: Sequence[str], width: int = BUCKET_MS) -> DataFrame:
    """Consecutive distinct ``at_ms`` points as ``[start_ms, end_ms)``."""
    distinct = points.select(*keys, "at_ms").distinct()
    return (
        ordered.scan(
            distinct,
            keys,
            ["at_ms"],
            ordered.bucket_of("at_ms", width),
            [ordered.following("end_ms", F.col("at_ms"))],
        )
        .filter(F.col("end_ms").isNotNull())
        .withColumnRenamed("at_ms", "start_ms")
    )


def boundaries(df: DataFrame, keys: Sequence[str], start="start_ms", end="end_ms") -> DataFrame:
    return df.select(*keys, F.explode(F.array(F.col(start), F.col(end))).alias("at_ms"))


def active_sets(cells: DataFrame, turns: DataFrame, layers: dict[str, str]) -> DataFrame:
    """For every elementary cell the sorted distinct speakers of each layer.

    ``turns`` has ``meeting_id, layer, speaker_id, start_ms, end_ms``; ``layers`` maps an
    output column to a layer name. Cells without any speaker keep empty arrays.
    """
    names = turns.select(
        "meeting_id",
        F.col("layer"),
        F.col("speaker_id").alias("_who"),
        F.col("start_ms").alias("_ts"),
        F.col("end_ms").alias("_te"),
    )
    met = range_join(
        cells,
        names,
        ["meeting_id"],
        (F.col("start_ms"), F.col("end_ms")),
        (F.col("_ts"), F.col("_te")),
        (F.col("_ts") < F.col("end_ms")) & (F.col("_te") > F.col("start_ms")),
    )
    empty = cells.select(
        "meeting_id",
        "start_ms",
        "end_ms",
        F.lit(None).cast("string").alias("layer"),
        F.lit(None).cast("string").alias("_who"),
    )
    return (
        met.select("meeting_id", "start_ms", "end_ms", "layer", "_who")
        .unionByName(empty)
        .groupBy("meeting_id", "start_ms", "end_ms")
        .agg(
            *[
                F.array_sort(
                    F.collect_set(F.when(F.col("layer") == layer, F.col("_who")))
                ).alias(out)
                for out, layer in layers.items()
            ]
        )
    )


def overlap_regions(turns: DataFrame) -> DataFrame:
    """Maximal intervals in which at least two distinct speakers are active.

    Same-speaker overlap does not count; neighbouring cells merge only when they touch
    and hold the same speakers.
    """
    layered = turns.select("meeting_id", F.lit("regular").alias("layer"), "speaker_id", "start_ms", "end_ms")
    cells = elementary_intervals(boundaries(turns, ["meeting_id"]), ["meeting_id"])
    active = active_sets(cells, layered, {"speakers": "regular"}).filter(F.size("speakers") >= 2)
    return coalesce_intervals(active, ["meeting_id"], ["speakers"])

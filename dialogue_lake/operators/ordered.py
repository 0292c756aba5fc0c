"""Ordered operators that never put one whole meeting into one task.

A window over ``meeting_id`` alone would send every row of a long meeting to a single
task. Here each meeting is cut into ordered buckets. Work inside a bucket is a normal
window; only one summary row per bucket takes part in the window over the meeting, and
its result is joined back on (meeting, bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


@dataclass(frozen=True)
class Step:
    """One output column of :func:`scan`."""

    out: str
    kind: str  # sum | row_number | max | last | lag | lead
    value: Column | None = None


def running_sum(out: str, value: Column) -> Step:
    return Step(out, "sum", value)


def numbered(out: str) -> Step:
    return Step(out, "row_number")


def running_max(out: str, value: Column) -> Step:
    """Maximum over the rows before the current one."""
    return Step(out, "max", value)


def last_before(out: str, value: Column) -> Step:
    """Last non-null value at or before the current row."""
    return Step(out, "last", value)


def previous(out: str, value: Column) -> Step:
    return Step(out, "lag", value)


def following(out: str, value: Column) -> Step:
    return Step(out, "lead", value)


def bucket_of(position: Column | str, width: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(width)).cast("bigint")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    steps: Sequence[Step],
) -> DataFrame:
    """Running values within ``keys`` in ``order``; ``bucket`` must grow with ``order``."""
    keys = list(keys)
    df = df.withColumn(BUCKET, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    over_buckets = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)

    local_columns, summaries, carries, finals = {}, [], [], {}
    for n, step in enumerate(steps):
        here, total, carry = f"_l{n}", f"_s{n}", f"_c{n}"
        mine, brought = F.col(here), F.col(carry)
        if step.kind == "sum":
            local_columns[here] = F.sum(step.value).over(upto)
            summaries.append(F.sum(step.value).alias(total))
            carries.append(F.sum(total).over(earlier).alias(carry))
            finals[step.out] = F.coalesce(mine, F.lit(0)) + F.coalesce(brought, F.lit(0))
        elif step.kind == "row_number":
            local_columns[here] = F.row_number().over(local).cast("bigint")
            summaries.append(F.count(F.lit(1)).alias(total))
            carries.append(F.sum(total).over(earlier).alias(carry))
            finals[step.out] = mine + F.coalesce(brought, F.lit(0))
        elif step.kind == "max":
            local_columns[here] = F.max(step.value).over(before)
            summaries.append(F.max(step.value).alias(total))
            carries.append(F.max(total).over(earlier).alias(carry))
            finals[step.out] = F.greatest(mine, brought)
        elif step.kind == "last":
            local_columns[here] = F.last(step.value, ignorenulls=True).over(upto)
            filled = F.when(step.value.isNotNull(), position)
            summaries.append(F.max_by(step.value, filled).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(earlier).alias(carry))
            finals[step.out] = F.coalesce(mine, brought)
        elif step.kind == "lag":
            wrapped = F.struct(step.value.alias("v"))
            local_columns[here] = F.lag(wrapped).over(local)
            summaries.append(F.max_by(wrapped, position).alias(total))
            carries.append(F.lag(total).over(over_buckets).alias(carry))
            finals[step.out] = F.coalesce(mine, brought)["v"]
        elif step.kind == "lead":
            wrapped = F.struct(step.value.alias("v"))
            local_columns[here] = F.lead(wrapped).over(local)
            summaries.append(F.min_by(wrapped, position).alias(total))
            carries.append(F.lead(total).over(over_buckets).alias(carry))
            finals[step.out] = F.coalesce(mine, brought)["v"]
        else:
            raise ValueError(step.kind)
    inside = df.withColumns(local_columns)
    summary = df.groupBy(*keys, BUCKET).agg(*summaries)
    carried = summary.select(*keys, BUCKET, *carries)
    joined = inside.join(carried, [*keys, BUCKET])
    return joined.withColumns(finals).select(*[c for c in df.columns if c != BUCKET], *finals)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    carried: Sequence[str],
    is_new: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    out: str = "island",
) -> DataFrame:
    """Number the runs of rows; ``is_new(previous, current)`` says where a run begins.

    Both arguments are functions from a column name in ``carried`` to a column. Flags
    are found inside buckets first; only first and last rows meet across borders.
    """
    keys = list(keys)
    df = df.withColumn(BUCKET, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.struct(*carried)
    flagged = df.withColumn("_p", F.lag(edge).over(local)).withColumn(
        "_new",
        F.when(F.col("_p").isNull(), 0).otherwise(
            is_new(lambda c: F.col("_p")[c], lambda c: F.col(c)).cast("int")
        ),
    )
    inside = flagged.withColumn("_count", F.sum("_new").over(upto)).drop("_p", "_new")
    summary = flagged.groupBy(*keys, BUCKET).agg(
        F.sum("_new").alias("_total"),
        F.min_by(edge, F.struct(*order)).alias("_first"),
        F.max_by(edge, F.struct(*order)).alias("_last"),
    )
    over_buckets = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    through = over_buckets.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = (
        summary.withColumn("_before", F.lag("_last").over(over_buckets))
        .withColumn(
            "_opens",
            F.when(F.col("_before").isNull(), 1).otherwise(
                is_new(lambda c: F.col("_before")[c], lambda c: F.col("_first")[c]).cast("int")
            ),
        )
        .select(
            *keys,
            BUCKET,
            (
                F.coalesce(F.sum("_total").over(earlier), F.lit(0)) + F.sum("_opens").over(through)
            ).alias("_base"),
        )
    )
    return (
        inside.join(base, [*keys, BUCKET])
        .withColumn(out, (F.col("_base") + F.col("_count")).cast("bigint"))
        .drop("_base", "_count", BUCKET)
    )


def with_preceding(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    count: int,
    value: Column,
    out: str,
    width: int = 4096,
) -> DataFrame:
    """Array of ``value`` over the ``count`` rows before each row, by dense ``number``.

    The last ``count`` rows of each bucket are copied into the next one, so one shuffle
    on (keys, bucket) is enough.
    """
    home = bucket_of(number, width)
    spilled = F.array(home, bucket_of(F.col(number) + F.lit(count), width))
    copies = df.withColumn("_home", home).withColumn(BUCKET, F.explode(F.array_distinct(spilled)))
    frame = Window.partitionBy(*keys, BUCKET).orderBy(number).rowsBetween(-count, -1)
    return (
        copies.withColumn(out, F.collect_list(value).over(frame))
        .filter(F.col("_home") == F.col(BUCKET))
        .drop("_home", BUCKET)
    )

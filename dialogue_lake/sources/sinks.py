"""Publishing: write-once stage tables, line-oriented text, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered

HALF = 15


def publish_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """Write one stage result once; a second write to the same run fails."""
    path = f"{root}/{stage}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def row_digest(columns: list[str]):
    """SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One digest per key over all its rows, whatever their order.

    The row digests are added up in four parts, so the sum is combined before the shuffle
    and no key needs its rows in one place. Equal rows count as often as they occur.
    """
    digest = row_digest(columns) if columns != ["row_sha"] else F.col("row_sha")
    parts = [F.conv(F.substring("_d", 1 + HALF * i, HALF), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.withColumn("_d", digest).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(p).cast("string").alias(f"_p{i}") for i, p in enumerate(parts)])
    return sums.select(
        *keys, "rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), *[f"_p{i}" for i in range(4)]), 256).alias("digest"))


def record_digest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fan: int = 1024, levels: int = 4) -> DataFrame:
    """One digest per key over its rows in order, however they are partitioned.

    A hash tree: rows are JSON texts with sorted keys, each hashed; ``fan`` digests in a row
    are hashed together, level by level, then the number of rows with the last one. ``fan``
    to the power ``levels`` rows fit. Order and repetition change the digest, and a saved one
    can be compared with it. ``order`` starts with a number that grows with the order.
    """
    rows = df.select(*keys, *[c for c in order if c not in keys], row_digest(columns).alias("_d"))
    rows = ordered.scan(rows, keys, [*order, "_d"], ordered.bucket_of(order[0], 4096), [ordered.numbered("_n")])
    nodes = rows.select(*keys, (F.col("_n") - 1).alias("_n"), "_d", F.lit(1).cast("bigint").alias("_rows"))
    for _ in range(levels):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_d"))), lambda x: x["_d"]), "")
        nodes = nodes.groupBy(*keys, F.floor(F.col("_n") / fan).cast("bigint").alias("_up")).agg(
            F.sha2(joined, 256).alias("_d"), F.sum("_rows").alias("_rows")).withColumnRenamed("_up", "_n")
    return nodes.select(*keys, F.col("_rows").alias("rows"), F.sha2(F.concat_ws(":", F.col("_rows").cast("string"), "_d"), 256).alias("digest"))


def transcript_lines(utterances: DataFrame, text: str = "text") -> DataFrame:
    """``[start --> end] SPEAKER: text`` per utterance; lines stay rows."""
    line = F.concat(
        F.lit("["), tx.timestamp_text(F.col("start_ms")), F.lit(" --> "), tx.timestamp_text(F.col("end_ms")), F.lit("] "),
        F.coalesce("speaker_id", F.lit("UNKNOWN")), F.lit(": "), F.col(text))
    return utterances.select("meeting_id", "utt_idx", line.alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Text files in meeting order: ranges of lines per task, never one meeting per task."""
    lines.repartitionByRange("meeting_id", *order).sortWithinPartitions("meeting_id", *order).select(
        F.concat(F.col("meeting_id").cast("string"), F.lit("\t"), "line").alias("value")).write.mode("errorifexists").text(path)

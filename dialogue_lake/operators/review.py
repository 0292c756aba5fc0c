"""The read path: what a user looks at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reliability_label(utterances: DataFrame) -> DataFrame:
    """One word per meeting: mismatch before uncertain before mixed."""
    some = lambda test: F.bool_or(test)
    return utterances.groupBy("meeting_id").agg(
        F.when(some(F.col("count_mismatch")), "count_mismatch")
        .when(some(F.col("status") == "UNCERTAIN"), "uncertain")
        .when(some(F.col("status") == "MIXED"), "mixed")
        .otherwise("consistent").alias("label"))


def most_disputed(utterances: DataFrame, top: int = 5, floor: float = 0.2) -> DataFrame:
    """Mixed utterances with the largest disagreement; the rank limit is the feature."""
    order = Window.partitionBy("meeting_id").orderBy(F.desc("disagreement_fraction"), "utterance_id")
    return (
        utterances.filter((F.col("status") == "MIXED") & (F.col("disagreement_fraction") >= floor))
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top)
        .select("meeting_id", "utterance_id", "disagreement_fraction"))


def meeting_overview(utterances: DataFrame, items: DataFrame) -> DataFrame:
    base = utterances.groupBy("meeting_id").agg(
        F.count_distinct("speaker_id").alias("speakers"), F.max("end_ms").alias("duration_ms"))
    cited = items.groupBy("meeting_id").agg(
        F.sum(F.size("evidence_ids")).alias("evidence_refs"), F.count(F.lit(1)).alias("items"))
    return base.join(cited, "meeting_id", "left").na.fill(0, ["evidence_refs", "items"])


def job_history(stages: DataFrame, expected: int = 6) -> DataFrame:
    """Finished stages out of the expected ones per job, newest job first by ``newest``."""
    return stages.groupBy("meeting_id").agg(
        F.count_distinct(F.when(F.col("status") == "COMPLETED", F.col("stage"))).alias("completed"),
        F.max("created_at").alias("newest")).withColumn("unfinished", F.col("completed") < expected)


def unique_audit(meetings: DataFrame, audits: DataFrame) -> DataFrame:
    """Attach an audit only when exactly one carries the meeting's digest.

    ``meetings``: ``digest``; ``audits``: ``audit_id, digest``.
    """
    any_ = audits.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_any"))
    right = audits.join(meetings.select("meeting_id", "digest"), ["meeting_id", "digest"]).groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("_fit"), F.min("audit_id").alias("_id"))
    rows = meetings.join(any_, "meeting_id", "left").join(right, "meeting_id", "left")
    return rows.select(
        "meeting_id",
        F.when(F.col("_any").isNull(), "not_generated").when(F.col("_fit") == 1, "available").otherwise("unavailable").alias("state"),
        F.when(F.col("_fit") == 1, F.col("_id")).alias("audit_id"))


def artifact_lookup(artifacts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every allowed artifact kind of every meeting, ready or not."""
    have = artifacts.select("meeting_id", "kind").distinct().withColumn("_have", F.lit(True))
    kinds = F.broadcast(allowed)  # A fixed list of artifact kinds.
    return artifacts.select("meeting_id").distinct().join(kinds).join(have, ["meeting_id", "kind"], "left").select(
        "meeting_id", "kind", "file_name", "media_type", F.coalesce("_have", F.lit(False)).alias("ready"))


def review_queue(utterances: DataFrame, parts: dict[str, DataFrame | None]) -> DataFrame:
    """Ordered union of review rows with the source time of the first cited utterance.

    Every part has ``meeting_id, record_id, title, utterance_id`` (null when none). A part
    that is not asked for is None; the others keep their rank.
    """
    experimental = {"Semantic", "Coverage"}
    out = None
    for rank, (category, rows) in enumerate(parts.items(), 1):
        if rows is None:
            continue
        part = rows.select(
            "meeting_id", F.lit(rank).cast("bigint").alias("category_rank"), F.lit(category).alias("category"), "record_id", "title",
            "utterance_id", F.lit(category in experimental).alias("experimental"))
        out = part if out is None else out.unionByName(part)
    return out.join(utterances.select("meeting_id", "utterance_id", "start_ms", "end_ms"), ["meeting_id", "utterance_id"], "left")

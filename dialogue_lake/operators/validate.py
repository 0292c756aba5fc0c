"""Validation jobs: counts or rows of broken rules, never an exception on data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.operators.lookup import spread_join


def violations(df: DataFrame, record_id: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; every rule is a boolean column of the same pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select("meeting_id", record_id.alias("record_id"), F.explode(broken).alias("rule"))


def transcript_violations(segments: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Numbered segments with ordered starts, words inside their segment and the recording, no missing time."""
    s = ordered.scan(segments, ["meeting_id"], ["seg_idx"], ordered.bucket_of("seg_idx", 4096),
                     [ordered.previous("_ps", F.col("start_ms")), ordered.numbered("_n")])
    missing = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    seg = violations(s, F.col("segment_id"), {
        "misnumbered": F.col("segment_id") != F.format_string("seg_%06d", "_n"), "missing_time": missing,
        "unordered_start": F.col("start_ms") < F.col("_ps"), "negative_length": F.col("end_ms") < F.col("start_ms")})
    w = words.join(segments.select("meeting_id", "segment_id", F.lit(True).alias("_there"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")),
                   ["meeting_id", "segment_id"], "left")
    w = spread_join(w, durations, ["meeting_id"], F.coalesce("start_ms", F.lit(0)))
    word = violations(w, F.concat("segment_id", F.lit("/"), "word_index"), {
        "unknown_segment": F.col("_there").isNull(), "missing_time": missing, "negative_length": F.col("end_ms") < F.col("start_ms"),
        "outside_segment": (F.col("start_ms") < F.col("_s") - 500) | (F.col("end_ms") > F.col("_e") + 500),
        "outside_recording": F.col("end_ms") > F.col("duration_ms") + 1000})
    return seg.unionByName(word)


def turn_violations(turns: DataFrame, durations: DataFrame, exclusive: bool, speakers: DataFrame | None = None) -> DataFrame:
    """Positive length, order, within the recording; exclusive turns may not overlap.

    With ``speakers`` (``meeting_id, speaker_id``) a turn's speaker must be one of them.
    """
    rows = ordered.scan(turns, ["meeting_id"], ["turn_idx"], ordered.bucket_of("turn_idx", 4096), [
        ordered.previous("_ps", F.col("start_ms")), ordered.previous("_pe", F.col("end_ms"))])
    rows = spread_join(rows, durations, ["meeting_id"], F.col("start_ms"))
    rules = {
        "empty": F.col("end_ms") <= F.col("start_ms"), "unordered": F.col("start_ms") < F.col("_ps"),
        "outside_recording": F.col("end_ms") > F.col("duration_ms") + 500}
    if exclusive:
        rules["overlap"] = F.col("start_ms") < F.col("_pe")
    if speakers is not None:
        declared = speakers.select("meeting_id", "speaker_id").distinct().withColumn("_declared", F.lit(True))
        rows = spread_join(rows, declared, ["meeting_id", "speaker_id"], F.col("turn_idx"))
        rules["undeclared_speaker"] = F.col("_declared").isNull()
    return violations(rows, F.col("turn_id"), rules)


def speaker_transcript_violations(utterances: DataFrame, words: DataFrame, regions: DataFrame, speakers: DataFrame, durations: DataFrame) -> DataFrame:
    """Numbered utterances of declared speakers, words of their own utterance, ordered overlap regions.

    ``utterances``: ``utterance_no, utterance_id, speaker_id, start_ms, end_ms, source_segment_ids``;
    ``words``: ``utterance_no, segment_id, word_index, speaker_id, start_ms, end_ms``; ``regions``:
    ``start_ms, end_ms, speakers``. Every word must have its utterance's speaker, lie within its
    times and name one of its segments.
    """
    declared = speakers.select("meeting_id", "speaker_id").distinct().withColumn("_declared", F.lit(True))
    said = spread_join(utterances, declared, ["meeting_id", "speaker_id"], F.col("utterance_no"))
    said = spread_join(said, durations, ["meeting_id"], F.col("utterance_no"))
    said = ordered.scan(said, ["meeting_id"], ["utterance_no"], ordered.bucket_of("utterance_no", 4096), [ordered.numbered("_n")])
    by_utterance = violations(said, F.col("utterance_id"), {
        "misnumbered": F.col("utterance_id") != F.format_string("utt_%06d", "_n"),
        "undeclared_speaker": F.col("speaker_id").isNotNull() & F.col("_declared").isNull(),
        "reversed": F.col("end_ms") < F.col("start_ms"), "outside_recording": F.col("end_ms") > F.col("duration_ms") + 1000})
    own = utterances.select("meeting_id", "utterance_no", "source_segment_ids", F.col("speaker_id").alias("_who"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    rows = words.join(own, ["meeting_id", "utterance_no"])
    by_word = violations(rows, F.concat("segment_id", F.lit("/"), "word_index"), {
        "other_speaker": ~F.col("speaker_id").eqNullSafe(F.col("_who")), "foreign_segment": ~F.array_contains("source_segment_ids", F.col("segment_id")),
        "outside_utterance": (F.col("start_ms") < F.col("_s")) | (F.col("end_ms") > F.col("_e"))})
    who = regions.select("meeting_id", "start_ms", "end_ms", F.explode("speakers").alias("speaker_id")).join(declared, ["meeting_id", "speaker_id"], "left_anti")
    unknown = who.select("meeting_id", F.col("start_ms").cast("string").alias("record_id"), F.lit("undeclared_speaker").alias("rule")).distinct()
    placed = ordered.scan(regions, ["meeting_id"], ["start_ms", "end_ms"], ordered.bucket_of("start_ms", 600_000), [ordered.running_max("_reach", F.col("end_ms"))])
    placed = spread_join(placed, durations, ["meeting_id"], F.col("start_ms"))
    by_region = violations(placed, F.col("start_ms").cast("string"), {
        "overlapping_regions": F.col("start_ms") < F.col("_reach"), "outside_recording": F.col("end_ms") > F.col("duration_ms") + 500})
    return by_utterance.unionByName(by_word).unionByName(by_region).unionByName(unknown)


def speaker_transcript_checks(words: DataFrame, attributed: DataFrame, utterances: DataFrame) -> DataFrame:
    """Each word once, unknown exactly when there is no speaker, regular utterances."""
    key = ["meeting_id", "segment_id", "word_index"]
    seen = attributed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or((F.col("method") == "unknown") != F.col("speaker_id").isNull()).alias("_odd"),
        F.bool_or((F.size("source_turn_ids") == 0) != F.col("speaker_id").isNull()).alias("_turns"))
    both = words.select(*key, F.lit(True).alias("_word")).join(seen, key, "full")
    by_word = both.groupBy("meeting_id").agg(
        F.count_if(F.coalesce("_n", F.lit(0)) != 1).alias("not_once"),
        F.count_if(F.col("_word").isNull()).alias("invented"),
        F.count_if(F.coalesce(F.col("_odd") | F.col("_turns"), F.lit(False))).alias("inconsistent"))
    by_utterance = utterances.groupBy("meeting_id").agg(
        F.count_if(F.col("end_ms") < F.col("start_ms")).alias("reversed"),
        (F.max("utterance_no") - F.count(F.lit(1))).alias("id_gaps"))
    return by_word.join(by_utterance, "meeting_id")


def grounding_checks(records: DataFrame) -> DataFrame:
    """Records per meeting with those that overlap within an utterance or leave its text."""
    from pyspark.sql import Window

    # Partitioned by one utterance, a single text.
    before = F.lag("char_end").over(Window.partitionBy("meeting_id", "utt_idx").orderBy("char_start"))
    return records.withColumn("_p", before).groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("char_start") < F.col("_p")).alias("overlapping"),
        F.count_if(F.col("char_end") > F.length("text")).alias("outside"))


def edit_log_violations(log: DataFrame) -> DataFrame:
    """Status, replacement and reason of every logged edit must fit its action.

    ``log``: ``edit_id, action, status, replacement, rejection, char_start, char_end, observed``.
    """
    action, status = F.col("action"), F.col("status")
    fitting = F.when(action == "REPLACE", status.isin("applied", "rejected")).when(action == "KEEP", status == "kept").when(
        action == "UNCERTAIN", status == "uncertain")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return violations(log, F.col("edit_id"), {
        "unknown_action": fitting.isNull(), "status_of_other_action": ~fitting, "missing_replacement": (action == "REPLACE") & blank("replacement"),
        "needless_replacement": (action != "REPLACE") & F.col("replacement").isNotNull(),
        "rejected_without_reason": (status == "rejected") & blank("rejection"), "needless_reason": (status != "rejected") & F.col("rejection").isNotNull(),
        "empty_span": (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")) | blank("observed")})


def edit_replay(refined: DataFrame, log: DataFrame) -> DataFrame:
    """Refined texts that the edit log reproduces, and that keep their protected tokens."""
    span = F.struct("char_start", "char_end", "replacement")
    spans = log.filter(F.col("status") == "applied").groupBy("meeting_id", "utt_idx").agg(F.collect_list(span).alias("_spans"))
    rows = refined.join(spans, ["meeting_id", "utt_idx"], "left")
    again = F.when(F.col("_spans").isNotNull(), tx.apply_replacements(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    same = F.col("text") == F.col("refined_text")
    kept = same | (tx.protected_signature(F.col("text")) == tx.protected_signature(F.col("refined_text")))
    return rows.withColumns({"_again": again, "_kept": kept}).groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("utterances"), F.count_if(F.col("_again") == F.col("refined_text")).alias("replayed"),
        F.count_if("_kept").alias("signature_kept"))


def items_without_evidence(items: DataFrame, utterances: DataFrame) -> DataFrame:
    """Items that cite nothing, or something that does not exist."""
    cited = items.select("meeting_id", "item_id", F.explode_outer("evidence_ids").alias("utterance_id"))
    return cited.join(utterances.select("meeting_id", "utterance_id"), ["meeting_id", "utterance_id"], "left_anti").select(
        "meeting_id", "item_id").distinct()


def graph_violations(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Endpoints must be accepted, keep their evidence, and supersede forwards in time.

    ``events``: ``event_id, choice, start_ms, accepted, evidence_ids``; ``relations``:
    ``src, dst, relation_type, evidence_ids``.
    """
    end = lambda name: events.select(
        "meeting_id", F.col("event_id").alias(name), F.struct("accepted", "choice", "start_ms", "evidence_ids").alias(f"_{name}"))
    rows = relations.join(end("src"), ["meeting_id", "src"], "left").join(end("dst"), ["meeting_id", "dst"], "left")
    a, b = F.col("_src"), F.col("_dst")
    known = a.isNotNull() & b.isNotNull()
    missing = F.size(F.array_except(F.array_union(a["evidence_ids"], b["evidence_ids"]), F.col("evidence_ids"))) > 0
    supersedes = F.col("relation_type") == "SUPERSEDES"
    fine = (a["choice"] == "DECISION") & (b["choice"] == "DECISION") & (
        F.struct(a["start_ms"], F.col("src")) < F.struct(b["start_ms"], F.col("dst")))
    return violations(rows, F.concat("src", F.lit(">"), "dst"), {
        "endpoint_not_accepted": ~known | ~a["accepted"] | ~b["accepted"],
        "lost_evidence": known & missing,
        "bad_supersession": known & supersedes & ~fine})


def source_mismatches(saved: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Saved observations that no longer equal the row they came from."""
    named = source.select(*key, F.struct(*columns).alias("_source"))
    rows = saved.join(named, key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col("_source")[c])
    return rows.filter(F.col("_source").isNull() | ~same).select(*saved.columns)


def broken_provenance(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Meetings whose stage names a parent digest that is not its parent's.

    Each stage is ``(name, df)`` with ``meeting_id, digest, parent_digest``, in order.
    """
    out = None
    for (_, parent), (name, child) in zip(stages, stages[1:]):
        known = parent.select("meeting_id", F.col("digest").alias("parent_digest"), F.lit(True).alias("_ok"))
        bad = child.join(known, ["meeting_id", "parent_digest"], "left").filter(F.col("_ok").isNull()).select(
            "meeting_id", F.lit(name).alias("stage"))
        out = bad if out is None else out.unionByName(bad)
    return out


def probability_violations(answers: DataFrame, record_id: Column, tolerance: float = 1e-6) -> DataFrame:
    """``probabilities`` must lie in [0, 1], sum to one, and the choice must be a maximum."""
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return violations(answers, record_id, {
        "out_of_range": F.exists(values, lambda p: (p < 0) | (p > 1) | p.isNull()),
        "sum_not_one": F.abs(total - 1) > tolerance,
        "choice_not_maximum": ~F.coalesce(
            F.try_element_at("probabilities", F.col("choice")) >= F.array_max(values) - tolerance, F.lit(False))})


def window_segment_violations(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Second-pass segments in order and inside their window (one second of slack)."""
    key = ["meeting_id", "window_id"]
    from pyspark.sql import Window

    # A window is at most fifteen seconds long, so this partition is small.
    before = F.lag("start_ms").over(Window.partitionBy(*key).orderBy("word_no"))
    rows = segments.withColumn("_p", before).join(
        windows.select(*key, F.col("start_ms").alias("_ws"), F.col("end_ms").alias("_we")), key, "left")
    return violations(rows, F.concat("window_id", F.lit("/"), "word_no"), {
        "unordered": F.col("start_ms") < F.col("_p"), "unknown_window": F.col("_ws").isNull(),
        "outside_window": (F.col("start_ms") < F.col("_ws") - 1000) | (F.col("end_ms") > F.col("_we") + 1000)})


def text_mismatches(hypotheses: DataFrame) -> DataFrame:
    """Second-pass texts that differ from their own segments after normalisation."""
    same = tx.normalize_term(F.col("text")) == tx.normalize_term(F.col("segment_text"))
    return hypotheses.withColumn("_same", same).filter(~F.col("_same")).select("meeting_id", "window_id")


def reliability_violations(rows: DataFrame, record_id: Column) -> DataFrame:
    fractions = [c for c in rows.columns if c.endswith("_fraction")]
    bad = F.lit(False)
    for c in fractions:
        bad = bad | (F.col(c) < 0) | (F.col(c) > 1) | F.col(c).isNull()
    return violations(rows, record_id, {
        "fraction_out_of_range": bad, "unknown_status": ~F.col("status").isin("RELIABLE", "MIXED", "UNCERTAIN")})


def context_pack_violations(terms: DataFrame, sources: DataFrame, max_terms: int = 256, max_sources: int = 64) -> DataFrame:
    """Count limits, unique scoped names, and sources that exist."""
    row = lambda df, record, rule: df.select("meeting_id", record.alias("record_id"), F.lit(rule).alias("rule"))
    many = terms.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_terms)
    crowded = sources.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_sources)
    doubled = terms.groupBy("meeting_id", "scope", "term_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    used = terms.select("meeting_id", "term_key", F.explode("source_ids").alias("source_id"))
    lost = used.join(sources.select("meeting_id", "source_id").distinct(), ["meeting_id", "source_id"], "left_anti")
    none = F.lit("")
    return (
        row(many, none, "too_many_terms").unionByName(row(crowded, none, "too_many_sources"))
        .unionByName(row(doubled, F.concat("scope", F.lit(":"), "term_key"), "duplicate_name"))
        .unionByName(row(lost, F.concat("term_key", F.lit("@"), "source_id"), "unknown_source")))


def missing_artifacts(artifacts: DataFrame, required: list[str]) -> DataFrame:
    have = artifacts.groupBy("meeting_id").agg(F.collect_set(F.when(F.col("kind").isin(required), F.col("kind"))).alias("_have"))
    gap = F.array_except(F.array(*[F.lit(k) for k in required]), "_have")
    return have.select("meeting_id", F.array_sort(gap).alias("missing")).filter(F.size("missing") > 0)


def job_violations(stages: DataFrame, required: list[str]) -> DataFrame:
    """Every required stage of a job exactly once, and no other. ``stages``: ``meeting_id, stage``."""
    counts = stages.groupBy("meeting_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    odd = violations(counts, F.col("stage"), {"repeated_stage": F.col("n") > 1, "unknown_stage": ~F.coalesce(F.col("stage").isin(required), F.lit(False))})
    wanted = stages.select("meeting_id").distinct().select("meeting_id", F.explode(F.array(*[F.lit(x) for x in required])).alias("stage"))
    gone = wanted.join(counts, ["meeting_id", "stage"], "left_anti")
    return odd.unionByName(gone.select("meeting_id", F.col("stage").alias("record_id"), F.lit("missing_stage").alias("rule")))


def response_violations(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to nothing that was asked, and meetings answered by several models."""
    stray = calls.join(requests.select("meeting_id", "request_id").distinct(), ["meeting_id", "request_id"], "left_anti")
    mixed = calls.groupBy("meeting_id").agg(F.count_distinct("model").alias("n")).filter(F.col("n") > 1)
    return stray.select("meeting_id", F.col("request_id").alias("record_id"), F.lit("unknown_request").alias("rule")).distinct().unionByName(
        mixed.select("meeting_id", F.lit("").alias("record_id"), F.lit("several_models").alias("rule")))

"""Logged text edits: neighbour context, verdicts, replay, model requests and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.session import stored

DECISION_SCHEMA = "struct<utterance_id:string,decisions:array<struct<grounding_record_id:string,action:string,candidate_entry_id:string,reason_code:string>>>"


def neighbours(utterances: DataFrame, gap_ms: int | None) -> DataFrame:
    """Adds ``before`` and ``after``: the adjacent utterances, if close enough in time."""
    who = F.struct("utterance_id", "speaker_id", "start_ms", "end_ms", "text")
    rows = ordered.scan(
        utterances, ["meeting_id"], ["utt_idx"], ordered.bucket_of("utt_idx", 4096),
        [ordered.previous("before", who), ordered.following("after", who)])
    if gap_ms is None:
        return rows

    def near(name: str) -> Column:
        other = F.col(name)
        gap = F.greatest(other["start_ms"] - F.col("end_ms"), F.col("start_ms") - other["end_ms"], F.lit(0))
        return F.when(gap <= gap_ms, other)

    return rows.withColumns({"before": near("before"), "after": near("after")})


def neighbour_context(utterances: DataFrame, gap_ms: int = 3000, chars: int = 600) -> DataFrame:
    """Own text first, then close neighbours as far as the character budget goes."""
    rows = neighbours(utterances, gap_ms)
    own = F.substring("text", 1, chars)
    around = F.concat_ws(" ", F.col("before.text"), F.col("after.text"))
    spare = F.greatest(F.lit(0), F.lit(chars - 1) - F.length(own))
    context = F.concat(own, F.lit(" "), F.substr(around, F.lit(1), spare))
    return rows.select("meeting_id", "utt_idx", F.regexp_replace(context, r"^\s+|\s+$", "").alias("context"))


def edit_verdicts(records: DataFrame) -> DataFrame:
    """First reason against a proposed replacement, null when there is none.

    Needs ``observed, replacement, text, char_start, char_end, match_type, scope, category,
    domain, lexical, phonetic, semantic`` and ``candidate_names`` (canonicals listed for
    the record, each as ``comparable`` writes it). No token of a signature has a blank in it,
    so only the words that the span touches can tell the text's signature from the edited one's.
    """
    source, target, text = F.col("observed"), F.col("replacement"), F.col("text")
    before = F.substring_index(F.substr(text, F.lit(1), F.col("char_start").cast("int")), " ", -1)
    after = F.substring_index(F.substr(text, (F.col("char_end") + 1).cast("int")), " ", 1)
    inside = F.substr(text, (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    said, edited = F.concat(before, inside, after), F.concat(before, target, after)
    rows = records.withColumns({
        "_s": tx.comparable(source), "_t": tx.comparable(target),
        "_changed": (tx.protected_signature(source) != tx.protected_signature(target))
        | (tx.protected_signature(said) != tx.protected_signature(edited)),
    })
    words = lambda c: F.size(tx.words_of(c))
    acronym = lambda c: c.rlike("^[A-Z][A-Z0-9]{1,9}$")
    kind = F.col("match_type")
    is_name = (F.col("domain") == "organizations") | F.lower("category").rlike("person|participant|company|name")
    weak = (F.col("lexical") < 0.85) | (F.col("phonetic") < 0.88) | (F.col("semantic") < 0.30)
    reason = (
        F.when((F.length(target) > 160) | (words(target) > 6) | target.rlike(r"[\n\r\t]"), "invalid_term_shape")
        .when(F.col("_changed"), "protected_meaning")
        .when(F.col("_s") == F.col("_t"), "formatting_only")
        .when(F.array_contains("candidate_names", F.col("_s")), "original_supported")
        .when((kind != "asr_alias_exact") & ((acronym(target) & (words(source) > 1)) | (acronym(source) & (words(target) > 1))),
              "acronym_expansion")
        .when(is_name & (~F.col("scope").isin("project", "meeting") | ~kind.isin("asr_alias_exact", "alias_exact", "normalized_exact")),
              "unsupported_name")
        .when(kind == "alias_exact", "equivalent_wording")
        .when((kind == "fuzzy") & weak, "weak_candidate"))
    return rows.withColumn("rejection", reason).drop("_s", "_t", "_changed")


def edit_status(action: Column, rejection: Column) -> Column:
    return (
        F.when(action == "REPLACE", F.when(rejection.isNull(), "applied").otherwise("rejected"))
        .when(action == "KEEP", "kept").otherwise("uncertain"))


def apply_edits(utterances: DataFrame, edits: DataFrame) -> DataFrame:
    """Refined text with the ids of applied edits and of uncertain records."""
    applied = F.col("status") == "applied"
    span = F.struct(F.col("char_start"), F.col("char_end"), F.col("replacement"))
    log = edits.groupBy("meeting_id", "utt_idx").agg(
        F.collect_list(F.when(applied, span)).alias("_spans"),
        F.array_sort(F.collect_list(F.when(applied, F.col("edit_id")))).alias("applied_edit_ids"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "uncertain", F.col("grounding_id")))).alias("uncertain_record_ids"))
    rows = utterances.join(log, ["meeting_id", "utt_idx"], "left")
    nothing = F.array().cast("array<string>")
    return (
        rows.withColumn("refined_text", F.when(F.size("_spans") > 0, tx.apply_replacements(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
        .withColumn("applied_edit_ids", F.coalesce("applied_edit_ids", nothing))
        .withColumn("uncertain_record_ids", F.coalesce("uncertain_record_ids", nothing)).drop("_spans"))


def refine_requests(utterances: DataFrame, candidates: DataFrame, top: int = 3, gap_ms: int = 5000,
                    context_chars: int = 1000, max_records: int = 64, max_chars: int = 24_000) -> DataFrame:
    """One JSON request per utterance with records: target, close neighbours, candidates.

    ``candidates``: one row per (record, candidate) with ``rank``. Requests over a limit
    are marked, so that nothing is sent before all are known to fit.
    """
    named = candidates.filter(F.col("rank") <= top).groupBy("meeting_id", "utt_idx", "grounding_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry_id", "canonical"))).alias("candidates"))
    per_utterance = named.groupBy("meeting_id", "utt_idx").agg(
        F.array_sort(F.collect_list(F.struct("grounding_id", "candidates"))).alias("records"))
    short = lambda side: F.when(
        F.col(side).isNotNull(),
        F.struct(F.col(side)["utterance_id"].alias("id"), F.substring(F.col(side)["text"], 1, context_chars // 2).alias("text")))
    rows = neighbours(utterances, gap_ms).join(per_utterance, ["meeting_id", "utt_idx"])
    close = F.array_compact(F.array(short("before"), short("after")))
    body = F.to_json(F.struct(
        F.struct("utterance_id", "speaker_id", "text").alias("target"), close.alias("neighbours"), "records"))
    return rows.select(
        "meeting_id", "utt_idx", "utterance_id", F.size("records").cast("bigint").alias("n_records"),
        F.size(close).cast("bigint").alias("n_neighbours"),
        F.aggregate("records", F.lit(0), lambda n, r: n + F.size(r["candidates"])).cast("bigint").alias("n_candidates"),
        body.alias("request"),
    ).withColumn("fits", (F.col("n_records") <= max_records) & (F.length("request") <= max_chars))


def parse_decisions(answers: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved model answers as typed decisions, and the utterances whose answer is bad.

    ``answers``: ``meeting_id, utt_idx, utterance_id, payload``; ``candidates``: one row per
    (record, candidate). An answer must name its utterance, cover every record once and
    pick only listed candidates.
    """
    key = ["meeting_id", "utt_idx"]
    parsed = answers.withColumn("_a", F.from_json("payload", DECISION_SCHEMA))
    rows = parsed.select(
        *key, "utterance_id", (F.col("_a.utterance_id") == F.col("utterance_id")).alias("_named"),
        F.explode_outer("_a.decisions").alias("_d"),
    ).select(*key, "_named", F.col("_d.grounding_record_id").alias("grounding_id"), "_d.action",
             F.col("_d.candidate_entry_id").alias("entry_id"), "_d.reason_code")
    listed = candidates.select(*key, "grounding_id", "entry_id").distinct().withColumn("_listed", F.lit(True))
    records = candidates.select(*key, "grounding_id").distinct().withColumn("_known", F.lit(True))
    counted = rows.groupBy(*key, "grounding_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce("_named", F.lit(False))).alias("_named"),
        F.first("action").alias("action"), F.first("entry_id").alias("entry_id"), F.first("reason_code").alias("reason_code"))
    # Both results read what was checked, and the good ones read it twice.
    checked = stored(
        counted.join(records, [*key, "grounding_id"], "full").join(listed, [*key, "grounding_id", "entry_id"], "left")
        .withColumn("_ok", F.coalesce(
            (F.col("_n") == 1) & F.col("_named") & F.col("_known") & F.col("action").isin("KEEP", "REPLACE", "UNCERTAIN")
            & ((F.col("action") != "REPLACE") | F.col("_listed")), F.lit(False))))
    asked = answers.select(*key)
    bad = checked.filter(~F.col("_ok")).select(*key).distinct().join(asked, key, "left_semi")
    good = checked.filter(F.col("_ok")).join(asked, key, "left_semi").join(bad, key, "left_anti").select(
        *key, "grounding_id", "action", "entry_id", "reason_code")
    return good, bad

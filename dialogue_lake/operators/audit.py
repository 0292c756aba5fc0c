"""Model requests, budgets and the policies applied to saved answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import claims, ordered
from dialogue_lake.session import stored

ACCEPT, REVIEW = 0.85, 0.60
PURPOSE_CAPS = {"events": 80, "relations": 100, "verification": 50, "coverage": 70}
TOTAL_CAP = 250


def event_outcome(choice: Column, p: Column) -> Column:
    return (
        F.when(choice.isNull(), "unavailable").when((p < REVIEW) | (choice == "NONE"), "abstained")
        .when((choice == "AMBIGUOUS") | (p < ACCEPT), "ambiguous").otherwise("accepted"))


def relation_outcome(choice: Column, p: Column, src_type: Column, dst_type: Column) -> Column:
    """SUPERSEDES counts only between two decisions."""
    wrong = (choice == "SUPERSEDES") & ((src_type != "DECISION") | (dst_type != "DECISION"))
    return (
        F.when(choice.isNull(), "unavailable").when(wrong, "abstained").when(choice == "NONE", "abstained")
        .when((choice == "AMBIGUOUS") | (p < ACCEPT), "ambiguous").otherwise("accepted"))


def typed_events(events: DataFrame) -> DataFrame:
    return events.withColumn("outcome", event_outcome(F.col("choice"), F.col("p"))).withColumn(
        "evidence_ids", F.array("utterance_id"))


def event_candidates(utterances: DataFrame, cap: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every utterance with any text and its place, and whether a meeting has more than ``cap``.

    ``within_budget`` marks the first ``cap``, the call budget of a meeting.
    """
    said = utterances.filter(F.trim("text") != "")
    ranked = ordered.scan(said, ["meeting_id"], ["utt_idx"], ordered.bucket_of("utt_idx", 4096), [ordered.numbered("candidate_no")])
    total = said.groupBy("meeting_id").agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return ranked.withColumn("within_budget", F.col("candidate_no") <= cap), total


def verification_questions(items: DataFrame) -> DataFrame:
    """Five questions per decision or action; owner and deadline ones only when present."""
    action = F.col("section") == "action_items"
    ask = lambda name, when: F.when(when, F.lit(name))
    names = F.array_compact(F.array(
        *[F.lit(n) for n in ("claim_supported", "item_type_supported", "negation_preserved", "numbers_preserved", "scope_preserved")],
        ask("owner_explicit", action & F.col("owner_speaker").isNotNull()),
        ask("deadline_explicit", action & F.col("deadline_text").isNotNull())))
    return items.filter(F.col("section").isin("decisions", "action_items")).select(
        "meeting_id", "item_id", F.posexplode(names).alias("_n", "question_id")).select(
        "meeting_id", "item_id", (F.col("_n") + 1).cast("bigint").alias("question_no"), "question_id")


def verification_status(answers: DataFrame) -> DataFrame:
    """UNAVAILABLE, UNSUPPORTED by one sure NO, SUPPORTED by sure YES throughout, or REVIEW."""
    sure = F.col("p") >= ACCEPT
    return answers.groupBy("meeting_id", "item_id").agg(
        F.when(F.count("choice") == 0, "UNAVAILABLE")
        .when(F.bool_or((F.col("choice") == "NO") & sure), "UNSUPPORTED")
        .when(F.bool_and(F.coalesce((F.col("choice") == "YES") & sure, F.lit(False))), "SUPPORTED")
        .otherwise("REVIEW").alias("status"))


def _expected(event_type: Column, section: Column, kind: Column) -> Column:
    return (
        F.when(event_type == "DECISION", section == "decisions")
        .when(event_type.isin("COMMITMENT", "TASK_ASSIGNMENT"), section == "action_items")
        .otherwise((section == "summary") | ((section == "minutes") & (kind == "concern"))))


def coverage_candidates(events: DataFrame, items: DataFrame, floor: float = 0.20, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Items that may record an accepted high-value event: the best three and the count.

    Shared evidence is an equi join on utterances. Similar wording is found over shared
    terms: with a Jaccard floor t, two sets can only pass if they share one of the rarest
    ``n - ceil(t * n) + 1`` terms of either, so only those terms are joined. No event meets
    all items of its meeting.
    """
    key = ["meeting_id"]
    e = stored(events.filter((F.col("outcome") == "accepted") & F.col("choice").isin(fixed.HIGH_VALUE)).select(
        *key, "event_id", F.col("choice").alias("event_type"), F.col("evidence_ids").alias("_ee"), tx.content_terms(F.col("text")).alias("_et")))
    i = stored(items.select(*key, "item_id", "section", "kind", F.col("evidence_ids").alias("_ie"), tx.content_terms(F.col("text")).alias("_it")))
    terms = lambda df, id_, c: df.select(*key, F.lit(id_).alias("_side"), F.col(id_).alias("_id"), F.size(c).alias("_n"), F.explode(c).alias("term"))
    rows = terms(e, "event_id", "_et").unionByName(terms(i, "item_id", "_it"))
    counts = rows.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("_df"))
    # Terms left out of the prefix: fewer than any set that passes must share.
    rest = lambda n: F.ceil(n * floor - 1e-9).cast("int") - 1
    ranked = rows.join(counts.hint("merge"), [*key, "term"]).groupBy(*key, "_side", "_id").agg(
        F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_df", "term"))).alias("_o"))
    rare = stored(ranked.select(*key, "_side", "_id", "_n", F.explode(F.slice("_o", F.lit(1), F.col("_n") - rest(F.col("_n")))).alias("_t")).select(
        *key, "_side", "_id", "_n", F.col("_t.term").alias("term")))
    side = lambda id_, n: rare.filter(F.col("_side") == id_).select(*key, "term", F.col("_id").alias(id_), F.col("_n").alias(n))
    # Pairs that cannot reach the floor even if all they leave out were shared go before their texts are fetched.
    most = F.count(F.lit(1)) + F.greatest(rest(F.first("_a")), rest(F.first("_b")))
    alike = side("event_id", "_a").join(side("item_id", "_b").hint("merge"), [*key, "term"]).groupBy(*key, "event_id", "item_id").agg(
        (most >= (F.first("_a") + F.first("_b")) * (floor / (1 + floor)) - 1e-9).alias("_may")).filter("_may").drop("_may")
    together = e.select(*key, "event_id", F.explode("_ee").alias("u")).join(
        i.select(*key, "item_id", F.explode("_ie").alias("u")).hint("merge"), [*key, "u"]).select(*key, "event_id", "item_id")
    pairs = alike.unionByName(together).distinct().join(e.hint("merge"), [*key, "event_id"]).join(i.hint("merge"), [*key, "item_id"])
    shared = F.arrays_overlap("_ee", "_ie")
    similarity = tx.jaccard(F.col("_et"), F.col("_it"))
    kept = pairs.withColumns({
        "shared": shared, "similarity": similarity,
        "wrong_type": ~_expected(F.col("event_type"), F.col("section"), F.col("kind"))}).filter(F.col("shared") | (F.col("similarity") >= floor))
    order = Window.partitionBy(*key, "event_id").orderBy("wrong_type", ~F.col("shared"), F.desc("similarity"), "item_id")
    best = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select(
        *key, "event_id", "event_type", "item_id", "rank", "wrong_type", "shared", "similarity")
    return best, kept.groupBy(*key, "event_id").agg(F.count(F.lit(1)).alias("candidates"))


def coverage_status(events: DataFrame, judged: DataFrame, counts: DataFrame, top: int = 3) -> DataFrame:
    """covered, unavailable, ambiguous or missing, with warnings.

    ``judged``: coverage candidates with the answer ``choice`` (null when there is none)
    and ``p``.
    """
    key = ["meeting_id", "event_id"]
    sure = F.col("p") >= ACCEPT
    yes = F.coalesce((F.col("choice") == "YES") & sure, F.lit(False))
    doubt = F.coalesce((F.col("choice") == "AMBIGUOUS") | ~sure, F.lit(False))
    per_event = judged.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(yes & ~F.col("wrong_type"), F.col("item_id")))).alias("matched"),
        F.array_sort(F.collect_list(F.when(yes & F.col("wrong_type"), F.concat(F.lit("wrong_record_type:"), "item_id")))).alias("wrong"),
        F.bool_or(doubt | (yes & F.col("wrong_type"))).alias("uncertain"), F.bool_or(F.col("choice").isNull()).alias("silent"))
    wanted = events.filter((F.col("outcome") == "accepted") & F.col("choice").isin(fixed.HIGH_VALUE)).select(*key, F.col("choice").alias("event_type"))
    none = F.array().cast("array<string>")
    rows = wanted.join(per_event, key, "left").join(counts, key, "left").withColumns({
        "matched": F.coalesce("matched", none), "wrong": F.coalesce("wrong", none),
        "truncated": F.coalesce(F.col("candidates") > top, F.lit(False))})
    status = (
        F.when(F.size("matched") > 0, "covered").when(F.coalesce("silent", F.lit(False)), "unavailable")
        .when(F.coalesce("uncertain", F.lit(False)) | F.col("truncated"), "ambiguous").otherwise("missing"))
    warnings = F.array_compact(F.concat("wrong", F.array(
        F.when(F.size("matched") > 1, F.lit("multiple_record_matches_review_duplicates")),
        F.when(F.col("truncated"), F.lit("coverage_candidates_truncated")))))
    return rows.select(*key, "event_type", "matched", status.alias("status"), warnings.alias("warnings"))


def budget_rank(requests: DataFrame, caps: dict[str, int] = PURPOSE_CAPS, total: int = TOTAL_CAP) -> DataFrame:
    """Every request with its place in the per-purpose and overall call budgets.

    ``requests``: ``meeting_id, purpose, request_no`` (whole numbers). Adds ``purpose_no``,
    ``call_no`` (counted over requests within their purpose's budget, null for others),
    ``within_budget`` and ``reason``: unknown_purpose, purpose_budget, total_budget or null.
    """
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("_purpose"))
    place = ordered.bucket_of("request_no", 4096)
    named = requests.withColumn("_purpose", F.coalesce("purpose", F.lit("")))
    ranked = ordered.scan(named, ["meeting_id", "_purpose"], ["request_no"], place, [ordered.numbered("purpose_no")])
    fits = F.coalesce(F.col("purpose_no") <= cap, F.lit(False))
    counted = ordered.scan(
        ranked.withColumn("_fits", fits), ["meeting_id"], ["request_no", "_purpose"], place,
        [ordered.running_sum("_call", F.col("_fits").cast("bigint"))])
    reason = F.when(cap.isNull(), "unknown_purpose").when(~F.col("_fits"), "purpose_budget").when(F.col("_call") > total, "total_budget")
    return counted.withColumns({"call_no": F.when(F.col("_fits"), F.col("_call")), "reason": reason}).withColumn(
        "within_budget", F.col("reason").isNull()).drop("_purpose", "_fits", "_call")


def request_dedup(requests: DataFrame, fields: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Requests with a fingerprint, and the first of each fingerprint: the ones to ask."""
    marked = requests.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))
    first = marked.groupBy("fingerprint").agg(F.min_by(F.struct(*requests.columns), order).alias("_r"), F.count(F.lit(1)).alias("uses"))
    return marked, first.select("fingerprint", "uses", "_r.*")


def attach_reliability(events: DataFrame, reliability: DataFrame) -> DataFrame:
    return events.join(
        reliability.select("meeting_id", "utterance_id", "status", "agreement_fraction"), ["meeting_id", "utterance_id"], "left")


def audit_availability(events: DataFrame, warnings: DataFrame) -> DataFrame:
    """available, partial or unavailable per meeting with its distinct warnings."""
    answered = events.groupBy("meeting_id").agg(F.bool_or(F.col("outcome") != "unavailable").alias("_any"))
    told = warnings.groupBy("meeting_id").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    rows = answered.join(told, "meeting_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    return rows.select(
        "meeting_id", "warnings",
        F.when(F.col("_any") & (F.size("warnings") > 0), "partial").when(F.col("_any"), "available").otherwise("unavailable").alias("availability"))


def extraction_requests(chunks: DataFrame, utterances: DataFrame) -> DataFrame:
    """One request per chunk with the ids and speakers an answer may name.

    Chunks are bounded in characters, so each request is one bounded row. Utterance
    indices are matched to chunks through blocks of 64, not over the whole meeting.
    """
    block = lambda c: F.floor(c / 64).cast("bigint")
    good = chunks.filter(F.col("error").isNull()).withColumn(
        "_b", F.explode(F.sequence(block(F.col("first_utt")), block(F.col("last_utt")))))
    rows = utterances.withColumn("_b", block(F.col("utt_idx"))).join(good, ["meeting_id", "_b"]).filter(
        F.col("utt_idx").between(F.col("first_utt"), F.col("last_utt")))
    grouped = rows.withColumn("_record", claims.request_record(rows)).groupBy("meeting_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("utt_idx", "utterance_id", "_record"))).alias("utterances"),
        F.array_sort(F.collect_set("speaker_id")).alias("speakers"))
    ids = F.transform("utterances", lambda u: u["utterance_id"])
    request = claims.request_text(F.transform("utterances", lambda u: u["_record"]))
    return grouped.select(
        "meeting_id", "chunk_no", F.size("utterances").cast("bigint").alias("n_utterances"), "speakers",
        request.alias("request"), response_schema(ids, F.col("speakers")).alias("response_schema"))


def _object(properties: dict[str, Column | str]) -> Column:
    """A JSON schema of an object with exactly these properties."""
    parts: list[Column | str] = []
    for name, schema in properties.items():
        parts += [", " if parts else "", f'"{name}": ', schema]
    names = ", ".join(f'"{name}"' for name in properties)
    whole = ['{"type": "object", "properties": {', *parts, f'}}, "required": [{names}], "additionalProperties": false}}']
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in whole])


def response_schema(ids: Column, speakers: Column) -> Column:
    """The JSON schema of an answer: only the chunk's utterances may be cited, only its speakers own."""
    listed = lambda values: F.concat(F.lit("["), F.array_join(F.transform(values, claims.json_string), ", "), F.lit("]"))
    array = lambda items: F.concat(F.lit('{"type": "array", "items": '), items, F.lit("}"))
    text, nothing = '{"type": "string"}', '{"type": "null"}'
    one_of = lambda values: F.concat(F.lit('{"type": "string", "enum": '), values, F.lit("}"))
    fixed_one = lambda *values: '{"type": "string", "enum": [' + ", ".join(f'"{v}"' for v in values) + "]}"
    evidence = array(one_of(listed(ids)))
    named = _object({"kind": fixed_one("named_entity"), "speaker_id": nothing, "display_text": text})
    speaker = _object({"kind": fixed_one("speaker"), "speaker_id": one_of(listed(speakers)), "display_text": nothing})
    owner = F.concat(
        F.lit('{"anyOf": ['), F.when(F.size(speakers) > 0, F.concat(speaker, F.lit(", "))).otherwise(""), named, F.lit(f", {nothing}]}}"))
    said = _object({"text": text, "evidence_utterance_ids": evidence})
    minute = _object({"text": text, "evidence_utterance_ids": evidence, "topic": text, "kind": fixed_one(*fixed.MINUTE_KINDS)})
    action = _object({"task": text, "owner": owner, "deadline_text": '{"type": ["string", "null"]}', "evidence_utterance_ids": evidence})
    return _object({"summary": array(said), "minutes": array(minute), "decisions": array(said), "action_items": array(action)})


def score_requests(requests: DataFrame, score, schema) -> DataFrame:
    """Hook for a user's own model: ``score`` maps batches of request rows to answers."""
    return requests.mapInPandas(score, schema)

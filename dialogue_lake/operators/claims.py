"""Claims with cited evidence: chunks, items, evidence, consolidation, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.session import checkpointed
from dialogue_lake.sources import strict

PREFIX = {"summary": "sum", "minutes": "min", "decisions": "dec", "action_items": "act"}
# The names around the records of a request.
REQUEST_HEAD = '{"UNTRUSTED_MEETING_TRANSCRIPT_DATA": ['
REQUEST_TAIL = '], "sections": ["summary", "minutes", "decisions", "action_items"]}'


def cited_place(utterance_id: Column) -> Column:
    """The number an utterance id ends with; -1 without one."""
    return F.coalesce(F.regexp_extract(utterance_id, r"(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def in_meeting_order(utterance_ids: Column) -> Column:
    """Ids by their number: as text, the millionth would come before the 999,999th."""
    placed = F.transform(utterance_ids, lambda x: F.struct(cited_place(x).alias("place"), x.alias("id")))
    return F.transform(F.array_sort(placed), lambda s: s["id"])


def identity(items_have: list[str] = ["section", "text", "topic", "kind", "owner_speaker", "deadline_text"]) -> Column:
    """Everything a claim says, without its id and evidence."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in items_have]), {"ignoreNullFields": "false"}), 256)


def json_string(value: Column) -> Column:
    """A JSON string of ``value``, ``null`` without one."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def request_record(utterances: DataFrame) -> Column:
    """One utterance as it stands in a request, with a blank after each comma and colon.

    ``text`` is the refined text; ``raw_text`` and ``applied_edit_ids`` are used if there.
    """
    raw = F.col("raw_text" if "raw_text" in utterances.columns else "text")
    edits = F.col("applied_edit_ids") if "applied_edit_ids" in utterances.columns else F.array().cast("array<string>")
    listed = F.array_join(F.transform(F.coalesce(edits, F.array().cast("array<string>")), json_string), ", ")
    return F.concat(
        F.lit('{"applied_edit_ids": ['), listed, F.lit('], "raw_text": '), json_string(raw), F.lit(', "refined_text": '),
        json_string(F.col("text")), F.lit(', "speaker_id": '), json_string(F.col("speaker_id")), F.lit(', "utterance_id": '),
        json_string(F.col("utterance_id")), F.lit("}"))


def request_text(records: Column) -> Column:
    """The request that holds an array of records."""
    return F.concat(F.lit(REQUEST_HEAD), F.array_join(records, ", "), F.lit(REQUEST_TAIL))


def build_chunks(utterances: DataFrame, max_chars: int = 18_000, overlap: int = 2, max_chunks: int = 32) -> DataFrame:
    """Whole utterances packed into overlapping chunks; too large a meeting is an error row.

    A chunk is as long as its serialised request allows. The next one starts ``overlap``
    utterances before the end, at least one further on. A meeting with an utterance that
    fits no request, or of more than ``max_chunks`` chunks, is refused.

    With running sums of the record sizes, the last utterance of a chunk is the last one
    whose sum is within the room after its first: one ordered pass finds it for every
    possible start. Starts that follow each other from the first are then reached by
    doubling the step. Meetings that fit one request need neither. No meeting is one array.
    """
    room = max_chars - len(REQUEST_HEAD) - len(REQUEST_TAIL) + len(", ")
    sized = utterances.select("meeting_id", "utt_idx", (F.length(request_record(utterances)) + len(", ")).cast("bigint").alias("_size"))
    meetings = sized.groupBy("meeting_id").agg(
        F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("n"), F.min("utt_idx").alias("first_utt"), F.max("utt_idx").alias("last_utt"))
    none = F.lit(None).cast("string").alias("error")
    whole = meetings.filter(F.col("_total") <= room).select(
        "meeting_id", F.lit(1).cast("bigint").alias("chunk_no"), "first_utt", "last_utt", none)
    long = checkpointed(meetings.filter(F.col("_total") > room).select("meeting_id", "n"))
    if long.isEmpty():
        return whole
    large = checkpointed(ordered.scan(
        sized.join(long, "meeting_id"), ["meeting_id"], ["utt_idx"], ordered.bucket_of("utt_idx", 4096),
        [ordered.numbered("i"), ordered.running_sum("upto", F.col("_size"))]))
    # Sums and the room after each start on one line; a sum at the same place still fits.
    points = large.select("meeting_id", F.col("upto").alias("place"), F.lit(0).alias("asks"), "i", "utt_idx", "n")
    asks = large.select("meeting_id", (F.col("upto") - F.col("_size") + room).alias("place"), F.lit(1).alias("asks"), "i", "utt_idx", "n")
    ends = ordered.scan(
        points.unionByName(asks), ["meeting_id"], ["place", "asks", "i"], ordered.bucket_of("place", 1 << 20),
        [ordered.last_before("end", F.when(F.col("asks") == 0, F.struct("i", "utt_idx")))])
    steps = checkpointed(ends.filter("asks = 1").select(
        "meeting_id", "i", "n", F.col("utt_idx").alias("first_utt"), F.col("end.utt_idx").alias("last_utt"),
        F.coalesce("end.i", F.lit(0)).alias("end")).withColumn("stuck", F.col("end") < F.col("i")))
    onward = F.greatest(F.col("i") + 1, F.col("end") + 1 - overlap)
    jump = checkpointed(steps.filter(~F.col("stuck") & (F.col("end") < F.col("n"))).select("meeting_id", "i", onward.alias("to")))
    reached = steps.filter("i = 1").select("meeting_id", "i", F.lit(1).cast("bigint").alias("chunk_no"))
    length = 1
    while length <= max_chunks and not jump.isEmpty():
        further = reached.join(jump, ["meeting_id", "i"]).select(
            "meeting_id", F.col("to").alias("i"), (F.col("chunk_no") + length).alias("chunk_no"))
        reached = checkpointed(reached.unionByName(further))
        twice = jump.select("meeting_id", F.col("i").alias("to"), F.col("to").alias("_then"))
        jump = checkpointed(jump.join(twice, ["meeting_id", "to"]).select("meeting_id", "i", F.col("_then").alias("to")))
        length *= 2
    chunks = reached.join(steps, ["meeting_id", "i"])
    verdict = chunks.groupBy("meeting_id").agg((F.bool_or("stuck") | (F.max("chunk_no") > max_chunks)).alias("_refused"))
    good = chunks.join(verdict.filter(~F.col("_refused")), "meeting_id").select("meeting_id", "chunk_no", "first_utt", "last_utt", none)
    number = F.lit(None).cast("bigint")
    bad = verdict.filter("_refused").select(
        "meeting_id", number.alias("chunk_no"), number.alias("first_utt"), number.alias("last_utt"), F.lit("meeting_too_large").alias("error"))
    return whole.unionByName(good).unionByName(bad)


def resolve_evidence(items: DataFrame, utterances: DataFrame) -> DataFrame:
    """Every citation of every item with the cited utterance, in order of citation."""
    cited = items.select("meeting_id", "item_id", F.posexplode("evidence_ids").alias("_p", "utterance_id"))
    return cited.join(utterances, ["meeting_id", "utterance_id"]).select(
        "meeting_id", "item_id", F.col("_p").cast("bigint").alias("position"), "utterance_id", "utt_idx", "speaker_id",
        "start_ms", "end_ms", "text")


def claim_violations(items: DataFrame, utterances: DataFrame) -> DataFrame:
    """Unknown citations, and owners or deadlines no single cited utterance supports.

    A named owner (``owner_name``, where there is such a column) must stand in a cited text.
    """
    name = F.col("owner_name") if "owner_name" in items.columns else F.lit(None).cast("string").alias("owner_name")
    cited = items.select(
        "meeting_id", "item_id", "section", "owner_speaker", name, "deadline_text", F.explode_outer("evidence_ids").alias("utterance_id"))
    rows = cited.join(utterances.select("meeting_id", "utterance_id", "speaker_id", F.col("text").alias("_t")), ["meeting_id", "utterance_id"], "left")
    supported = F.coalesce(tx.literal_support(F.col("deadline_text"), F.col("_t")), F.lit(False))
    named = F.coalesce(tx.literal_support(F.col("owner_name"), F.col("_t")), F.lit(False))
    per_item = rows.groupBy("meeting_id", "item_id").agg(
        F.bool_or(F.col("_t").isNull()).alias("unknown"),
        F.bool_or((F.col("section") == "action_items") & F.col("owner_name").isNotNull()).alias("has_name"), F.bool_or(named).alias("name_cited"),
        F.bool_or((F.col("section") == "action_items") & F.col("owner_speaker").isNotNull()).alias("has_owner"),
        F.bool_or(F.coalesce(F.col("owner_speaker") == F.col("speaker_id"), F.lit(False))).alias("owner_cited"),
        F.bool_or((F.col("section") == "action_items") & F.col("deadline_text").isNotNull()).alias("has_deadline"),
        F.bool_or(supported).alias("deadline_cited"))
    rules = F.array_compact(F.array(
        F.when(F.col("unknown"), "unknown_evidence"),
        F.when(F.col("has_owner") & ~F.col("owner_cited"), "owner_not_cited"),
        F.when(F.col("has_name") & ~F.col("name_cited"), "named_owner_not_cited"),
        F.when(F.col("has_deadline") & ~F.col("deadline_cited"), "deadline_not_cited")))
    return per_item.select("meeting_id", F.col("item_id").alias("record_id"), F.explode(rules).alias("rule"))


def combine_partials(items: DataFrame) -> DataFrame:
    """Claims said alike in several chunks become one, with the evidence of all.

    ``items`` carry ``chunk_no, item_no``; the first occurrence keeps its id.
    """
    columns = [c for c in items.columns if c not in ("evidence_ids",)]
    key = ["meeting_id", "section", "identity"]
    said = items.withColumn("identity", identity()).select(
        *key, F.struct(*columns).alias("_i"), F.struct("chunk_no", "item_no").alias("_o"), F.explode_outer("evidence_ids").alias("_e"))
    # A claim said very often cites few utterances: each citation is collected once.
    once = said.groupBy(*key, "_e").agg(F.min_by("_i", "_o").alias("_i"), F.min("_o").alias("_o"))
    return once.groupBy(*key).agg(
        F.min_by("_i", "_o").alias("_i"), in_meeting_order(F.collect_list("_e")).alias("evidence_ids")).select("_i.*", "identity", "evidence_ids")


def finalize_items(items: DataFrame, width: int = 4096) -> DataFrame:
    """Final ids per section, by the earliest cited utterance and then by content.

    ``items`` carry ``identity``. An item without evidence comes first.
    """
    first = items.withColumn("evidence_ids", in_meeting_order(F.col("evidence_ids")))
    first = first.withColumn("_first", F.get("evidence_ids", F.lit(0))).withColumn("_place", cited_place(F.col("_first")))
    numbered = ordered.scan(
        first, ["meeting_id", "section"], ["_place", "_first", "identity", "item_id"], ordered.bucket_of("_place", width),
        [ordered.numbered("item_no")])
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("section"))
    return numbered.withColumn("final_id", F.concat(prefix, F.format_string("_%04d", "item_no"))).drop("_first", "_place")


def apply_consolidation(groups: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged claims that keep the primary item's words, and the groups that break a rule.

    ``groups``: ``meeting_id, section, group_id, primary_id, merge_ids``. Only selection is
    allowed: every id must exist, be used once, and agree on owner and deadline (actions)
    or kind (minutes).
    """
    members = groups.select(
        "meeting_id", "section", "group_id", "primary_id",
        F.posexplode(F.concat(F.array("primary_id"), "merge_ids")).alias("_p", "item_id"))
    rows = members.join(items, ["meeting_id", "section", "item_id"], "left")
    reused = members.groupBy("meeting_id", "item_id").agg(F.count(F.lit(1)).alias("_uses"))
    rows = rows.join(reused, ["meeting_id", "item_id"])
    said = F.struct(F.coalesce("owner_speaker", F.lit("")), F.coalesce("deadline_text", F.lit("")))
    summary = rows.groupBy("meeting_id", "section", "group_id", "primary_id").agg(
        F.bool_or(F.col("text").isNull()).alias("_unknown"), F.max("_uses").alias("_uses"),
        F.count_distinct(said).alias("_owners"), F.count_distinct("kind").alias("_kinds"),
        F.array_sort(F.collect_list(F.struct("_p", "evidence_ids"))).alias("_e"),
        F.min_by("text", "_p").alias("text"))
    rules = F.array_compact(F.array(
        F.when(F.col("_unknown"), "unknown_item"), F.when(F.col("_uses") > 1, "item_reused"),
        F.when((F.col("section") == "action_items") & ~F.col("_unknown") & (F.col("_owners") > 1), "conflicting_owner_or_deadline"),
        F.when((F.col("section") == "minutes") & ~F.col("_unknown") & (F.col("_kinds") > 1), "conflicting_kind")))
    judged = summary.withColumn("rules", rules)
    evidence = F.array_distinct(F.flatten(F.transform("_e", lambda e: e["evidence_ids"])))
    good = judged.filter(F.size("rules") == 0).select(
        "meeting_id", "section", F.col("primary_id").alias("item_id"), "text", evidence.alias("evidence_ids"))
    bad = judged.select("meeting_id", F.col("group_id").alias("record_id"), F.explode("rules").alias("rule"))
    return good, bad


def render_minutes(items: DataFrame, evidence: DataFrame, meetings: DataFrame) -> DataFrame:
    """Lines of the Markdown record in order; one row per line, not one text per meeting.

    ``items`` carry ``final_id``; ``evidence`` the resolved citations by ``final_id``.
    Write them with ``repartitionByRange("meeting_id", "section_no", ...)`` and a sort.
    """
    headings = {"summary": "Meeting summary", "minutes": "Meeting minutes", "decisions": "Decisions", "action_items": "Action items"}
    sections = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("section_no"), F.lit(s).alias("section"), F.lit(h).alias("heading"))
        for n, (s, h) in enumerate(headings.items(), 1)])
    grid = meetings.select("meeting_id", F.explode(sections).alias("_s")).select("meeting_id", "_s.*")
    filled = items.groupBy("meeting_id", "section").agg(F.count(F.lit(1)).alias("n"))
    order = lambda item, line: [F.lit(item).alias("final_id") if isinstance(item, str) else item, F.lit(line).cast("bigint").alias("line_no")]
    head = grid.select("meeting_id", "section_no", *order("", 0), F.concat(F.lit("## "), "heading").alias("line"))
    none = grid.join(filled, ["meeting_id", "section"], "left_anti").select(
        "meeting_id", "section_no", *order("", 1), F.lit("None recorded.").alias("line"))
    numbers = F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(headings, 1) for x in (s, n)]), F.col("section")).cast("bigint").alias("section_no")
    label = F.when(F.col("section") == "minutes", F.concat(F.lit("["), "topic", F.lit(" / "), "kind", F.lit("] "))).otherwise("")
    said = items.select(
        "meeting_id", numbers, *order(F.col("final_id"), 0),
        F.concat(F.lit("- "), "final_id", F.lit(": "), tx.escape_markdown(F.concat(label, "text"))).alias("line"))
    owned = items.filter(F.col("section") == "action_items").select(
        "meeting_id", numbers, *order(F.col("final_id"), 1),
        F.concat(F.lit("  Owner: "), tx.escape_markdown(F.coalesce("owner_speaker", F.lit("unspecified"))), F.lit("; deadline: "),
                 tx.escape_markdown(F.coalesce("deadline_text", F.lit("unspecified")))).alias("line"))
    where = evidence.join(items.select("meeting_id", "final_id", "section"), ["meeting_id", "final_id"])
    place = F.concat(
        F.lit("  Evidence: "), "utterance_id", F.lit(" / "), F.coalesce("speaker_id", F.lit("UNKNOWN_SPEAKER")), F.lit(" / "),
        tx.timestamp_text(F.col("start_ms")), F.lit("–"), tx.timestamp_text(F.col("end_ms")))
    lines = F.explode(F.array(
        F.struct((F.col("position") * 2 + 2).alias("line_no"), place.alias("line")),
        F.struct((F.col("position") * 2 + 3).alias("line_no"), F.concat(F.lit("  Source: "), tx.escape_markdown(F.col("text"))).alias("line"))))
    cited = where.select("meeting_id", numbers, "final_id", lines.alias("_l")).select("meeting_id", "section_no", "final_id", "_l.*")
    out = head
    for part in (none, said, owned, cited):
        out = out.unionByName(part)
    return out


def evidence_manifest(evidence: DataFrame) -> DataFrame:
    """One JSON text per item with its citations."""
    spans = F.array_sort(F.collect_list(F.struct("position", "utterance_id", "speaker_id", "start_ms", "end_ms")))
    return evidence.groupBy("meeting_id", "item_id").agg(
        F.count(F.lit(1)).alias("citations"), F.to_json(spans).alias("manifest"))


def topics_in_order(items: DataFrame) -> DataFrame:
    """Items per topic, topics numbered by first appearance in the meeting."""
    topics = items.groupBy("meeting_id", "topic").agg(F.count(F.lit(1)).alias("items"), F.min("utt_idx").alias("first_utt"))
    order = Window.partitionBy("meeting_id").orderBy("first_utt", "topic")
    return topics.withColumn("topic_no", F.row_number().over(order).cast("bigint"))


def extraction_shape(max_items: int = 128) -> strict.Shape:
    """What an answer to an extraction request must look like."""
    shape = strict.Shape().add("$", "object")
    fields = {"summary": ["text"], "minutes": ["text", "topic", "kind"], "decisions": ["text"], "action_items": ["task"]}
    for section, texts in fields.items():
        item = f"$.{section}[]"
        shape.add(f"$.{section}", "array", most=max_items).add(item, "object")
        for name in texts:
            shape.add(f"{item}.{name}", "string", filled=True, values=fixed.MINUTE_KINDS if name == "kind" else ())
        shape.add(f"{item}.evidence_utterance_ids", "array").add(f"{item}.evidence_utterance_ids[]", "string", filled=True)
    owner = "$.action_items[].owner"
    shape.add(owner, "object", "null").add(f"{owner}.kind", "string", values=("speaker", "named_entity"))
    shape.add(f"{owner}.speaker_id", "string", "null").add(f"{owner}.display_text", "string", "null")
    return shape.add("$.action_items[].deadline_text", "string", "null")


ANSWER = (
    "summary array<struct<text: string, evidence_utterance_ids: array<string>>>, "
    "minutes array<struct<text: string, topic: string, kind: string, evidence_utterance_ids: array<string>>>, "
    "decisions array<struct<text: string, evidence_utterance_ids: array<string>>>, "
    "action_items array<struct<task: string, owner: struct<kind: string, speaker_id: string, display_text: string>, "
    "deadline_text: string, evidence_utterance_ids: array<string>>>")


def parse_extraction(answers: DataFrame, keys: list[str], payload: str = "payload", max_items: int = 128) -> tuple[DataFrame, DataFrame]:
    """Items of the answers that are exactly of the shape, and every departure of the others.

    Items are numbered per section in the order of the answer. An owner is a speaker or a
    name, never both; either one alone of ``owner_speaker`` and ``owner_name`` is set.
    """
    found = checkpointed(strict.violations(answers, keys, payload, extraction_shape(max_items)))
    whole = answers.join(found.select(*keys).distinct(), keys, "left_anti").withColumn("_a", F.from_json(payload, ANSWER))
    # Which of its two fields an owner has to fill follows from its kind.
    mixed = F.transform("_a.action_items", lambda x: x["owner"].isNotNull() & ~F.when(
        x["owner"]["kind"] == "speaker", x["owner"]["speaker_id"].isNotNull() & x["owner"]["display_text"].isNull()).otherwise(
        x["owner"]["speaker_id"].isNull() & x["owner"]["display_text"].isNotNull()))
    wrong = whole.select(*keys, F.posexplode(mixed).alias("_n", "_w")).filter("_w").select(
        *keys, F.concat(F.lit("$.action_items["), F.col("_n").cast("string"), F.lit("].owner")).alias("path"), F.lit("owner_fields").alias("rule"))
    good = whole.join(wrong.select(*keys).distinct(), keys, "left_anti")
    out = None
    none = F.lit(None).cast("string")
    for section, prefix in PREFIX.items():
        part = good.select(*keys, F.posexplode(f"_a.{section}").alias("_n", "i"))
        action, minute = section == "action_items", section == "minutes"
        part = part.select(
            *keys, F.lit(section).alias("section"), F.concat(F.lit(prefix), F.format_string("_%04d", F.col("_n") + 1)).alias("item_id"),
            F.col("i.task" if action else "i.text").alias("text"), (F.col("i.topic") if minute else none).alias("topic"),
            (F.col("i.kind") if minute else none).alias("kind"), (F.col("i.owner.speaker_id") if action else none).alias("owner_speaker"),
            (F.col("i.owner.display_text") if action else none).alias("owner_name"), (F.col("i.deadline_text") if action else none).alias("deadline_text"),
            F.col("i.evidence_utterance_ids").alias("evidence_ids"))
        out = part if out is None else out.unionByName(part)
    return out, found.unionByName(wrong)

"""Edit, request and claim queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import claims as cl
from dialogue_lake.operators import edits as ed
from dialogue_lake.operators import ordered
from dialogue_lake.plans.catalog_terms import TS, fold_sql, meaning_sql, ranked, records, signature_sql, tokens_sql
from dialogue_lake.plans.registry import listed, query, view
from dialogue_lake.plans.sql_views import strings
from dialogue_lake.plans.views import Views

# --- grounded records, decisions and edits ---
view("v_rec", """SELECT meeting_id, utt_idx, s.char_start AS char_start, s.char_end AS char_end, s.entry_id AS entry_id,
    row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, s.char_start) AS record_no FROM v_gr""")
view("v_dec", """SELECT r.meeting_id, r.utt_idx, r.char_start, r.char_end, r.record_no, k.match_type, g.scope, g.category, k.score,
    'grnd_' || lpad(CAST(r.record_no AS VARCHAR), 6, '0') AS grounding_id, 'edit_' || lpad(CAST(r.record_no AS VARCHAR), 6, '0') AS edit_id,
    CASE WHEN r.record_no % 5 <= 2 THEN 'REPLACE' WHEN r.record_no % 5 = 3 THEN 'KEEP' ELSE 'UNCERTAIN' END AS action,
    r.entry_id, g.canonical AS replacement, u.text, substr(u.text, r.char_start + 1, r.char_end - r.char_start) AS observed
    FROM v_rec r JOIN v_rk k USING (meeting_id, utt_idx, char_start, char_end, entry_id) JOIN v_g g ON g.entry_id = r.entry_id
    JOIN v_u u ON u.meeting_id = r.meeting_id AND u.utt_idx = r.utt_idx""")
view("v_names", f"""SELECT r.meeting_id, r.utt_idx, r.char_start, r.char_end, list({fold_sql('g.canonical')}) AS names
    FROM v_rk r JOIN v_g g USING (entry_id) WHERE rank <= 5 GROUP BY ALL""")
_edited = "(text[1:char_start] || replacement || text[char_end + 1:])"
_cmp = lambda x: f"regexp_replace({fold_sql(x)}, '[\\s\\-–—]+', '', 'g')"
view("v_ed", f"""SELECT d.*, CASE WHEN action <> 'REPLACE' THEN NULL
    WHEN {signature_sql(meaning_sql('observed'))} <> {signature_sql(meaning_sql('replacement'))}
      OR {signature_sql(meaning_sql('text'))} <> {signature_sql(meaning_sql(_edited))} THEN 'protected_meaning'
    WHEN {_cmp('observed')} = {_cmp('replacement')} THEN 'formatting_only'
    WHEN list_contains(n.names, {_cmp('observed')}) THEN 'original_supported'
    WHEN category = 'organization' AND NOT (scope IN ('project', 'meeting') AND match_type IN ('asr_alias_exact', 'alias_exact', 'normalized_exact'))
      THEN 'unsupported_name' END AS rejection
    FROM v_dec d JOIN v_names n USING (meeting_id, utt_idx, char_start, char_end)""")
view("v_log", """SELECT *, CASE action WHEN 'REPLACE' THEN CASE WHEN rejection IS NULL THEN 'applied' ELSE 'rejected' END
    WHEN 'KEEP' THEN 'kept' ELSE 'uncertain' END AS status FROM v_ed""")


def numbered_records(v: Views):
    return ordered.scan(
        records(v), ["meeting_id"], ["utt_idx", "char_start"], ordered.bucket_of("utt_idx", 256), [ordered.numbered("record_no")])


def decided(v: Views):
    key = ["meeting_id", "utt_idx", "char_start", "char_end"]
    names = ranked(v).join(v.glossary.select("entry_id", "canonical"), "entry_id").groupBy(*key).agg(
        F.collect_list(tx.comparable(F.col("canonical"))).alias("candidate_names"))
    n = F.col("record_no")
    rows = (
        numbered_records(v).join(ranked(v).select(*key, "entry_id", "match_type", "score"), [*key, "entry_id"])
        .join(v.glossary.select("entry_id", "scope", "category", F.col("canonical").alias("replacement")), "entry_id")
        .join(names, key).join(v.utterances.select("meeting_id", "utt_idx", "utterance_id", "text", "start_ms", "end_ms"), ["meeting_id", "utt_idx"]))
    return rows.select(
        *key, "utterance_id", "record_no", "entry_id", "match_type", "scope", "category", "score", "replacement", "candidate_names", "text",
        "start_ms", "end_ms",
        F.format_string("grnd_%06d", n).alias("grounding_id"), F.format_string("edit_%06d", n).alias("edit_id"),
        F.when(n % 5 <= 2, "REPLACE").when(n % 5 == 3, "KEEP").otherwise("UNCERTAIN").alias("action"),
        F.substr("text", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")).alias("observed"),
        F.when(F.col("category") == "organization", "organizations").otherwise("technology").alias("domain"),
        *[F.lit(1.0).alias(c) for c in ("lexical", "phonetic", "semantic")])


def decisions(v: Views):
    return v.shared("decisions", lambda: decided(v))


def edit_log(v: Views):
    def build():
        judged = ed.edit_verdicts(decisions(v))
        rejection = F.when(F.col("action") == "REPLACE", F.col("rejection"))
        return judged.withColumn("rejection", rejection).withColumn("status", ed.edit_status(F.col("action"), F.col("rejection")))

    return v.shared("edit_log", build)


def candidates(v: Views):
    """One row per (record, candidate) with the record's id."""
    key = ["meeting_id", "utt_idx", "char_start", "char_end"]
    ids = numbered_records(v).select(*key, F.format_string("grnd_%06d", "record_no").alias("grounding_id"))
    return v.shared("candidates", lambda: ranked(v).join(ids, key).join(v.glossary.select("entry_id", "canonical"), "entry_id"))


view("v_cand", """SELECT r.*, k.entry_id AS cand_id, k.rank FROM v_dec r JOIN v_rk k USING (meeting_id, utt_idx, char_start, char_end) WHERE k.rank <= 5""")


@query("d09_neighbour_context", """SELECT meeting_id, utt_idx, md5(regexp_replace(own || ' ' || substr(around, 1, greatest(0, 599 - length(own))),
    '^\\s+|\\s+$', '', 'g')) AS hash FROM (SELECT meeting_id, utt_idx, substr(text, 1, 600) AS own, concat_ws(' ',
      CASE WHEN greatest(start_ms - lag(end_ms) OVER w, 0) <= 3000 THEN lag(text) OVER w END,
      CASE WHEN greatest(lead(start_ms) OVER w - end_ms, 0) <= 3000 THEN lead(text) OVER w END) AS around
    FROM v_u WINDOW w AS (PARTITION BY meeting_id ORDER BY utt_idx))""")
def _(v):
    return ed.neighbour_context(v.utterances).select("meeting_id", "utt_idx", F.md5("context").alias("hash"))


@query("j04_edit_verdict", "SELECT meeting_id, grounding_id, action, status, rejection FROM v_log")
def _(v):
    return edit_log(v).select("meeting_id", "grounding_id", "action", "status", "rejection")


view("v_ref", """SELECT u.meeting_id, u.utt_idx, u.utterance_id, u.speaker_id, u.start_ms, u.end_ms, u.text,
    coalesce(r.refined_text, u.text) AS refined_text, coalesce(r.applied, '') AS applied_edits, coalesce(r.uncertain, '') AS uncertain_records
    FROM v_u u LEFT JOIN (SELECT meeting_id, utt_idx,
        coalesce(string_agg(edit_id, ',' ORDER BY edit_id) FILTER (WHERE status = 'applied'), '') AS applied,
        coalesce(string_agg(grounding_id, ',' ORDER BY grounding_id) FILTER (WHERE status = 'uncertain'), '') AS uncertain,
        string_agg(before || CASE WHEN status = 'applied' THEN replacement ELSE observed END || CASE WHEN last THEN rest ELSE '' END, '' ORDER BY char_start) AS refined_text
      FROM (SELECT *, substr(text, 1 + coalesce(lag(char_end) OVER w, 0), char_start - coalesce(lag(char_end) OVER w, 0)) AS before,
          substr(text, char_end + 1) AS rest, lead(char_end) OVER w IS NULL AS last
        FROM v_log WINDOW w AS (PARTITION BY meeting_id, utt_idx ORDER BY char_start)) GROUP BY ALL) r USING (meeting_id, utt_idx)""")


def refined(v: Views):
    return v.shared("refined", lambda: ed.apply_edits(v.utterances, edit_log(v)))


@query("j03_apply_edits", "SELECT meeting_id, utt_idx, md5(refined_text) AS hash, applied_edits, uncertain_records FROM v_ref")
def _(v):
    return refined(v).select("meeting_id", "utt_idx", F.md5("refined_text").alias("hash"), listed("applied_edit_ids").alias("applied_edits"),
                             listed("uncertain_record_ids").alias("uncertain_records"))


@query("j05_refine_requests", """SELECT meeting_id, utt_idx, count(DISTINCT grounding_id) AS n_records, count(*) AS n_candidates,
    any_value(near) AS n_neighbours FROM v_cand JOIN (SELECT meeting_id, utt_idx,
      CASE WHEN start_ms - lag(end_ms) OVER w <= 5000 THEN 1 ELSE 0 END
      + CASE WHEN lead(start_ms) OVER w - end_ms <= 5000 THEN 1 ELSE 0 END AS near
      FROM v_u WINDOW w AS (PARTITION BY meeting_id ORDER BY utt_idx)) USING (meeting_id, utt_idx) WHERE rank <= 3 GROUP BY ALL""")
def _(v):
    return ed.refine_requests(v.utterances, candidates(v)).select("meeting_id", "utt_idx", "n_records", "n_candidates", "n_neighbours")


def answers(v: Views):
    """Saved answers; those of the third utterance name a candidate nobody listed."""
    pick = F.when(F.col("utt_idx") == 2, "term.unlisted").otherwise(F.col("entry_id"))
    return decisions(v).groupBy("meeting_id", "utt_idx", "utterance_id").agg(
        F.to_json(F.struct("utterance_id", F.collect_list(F.struct(
            F.col("grounding_id").alias("grounding_record_id"), "action", pick.alias("candidate_entry_id"),
            F.lit("term").alias("reason_code"))).alias("decisions"))).alias("payload"))


@query("j07_parse_decisions", """SELECT meeting_id, utt_idx, grounding_id, action FROM v_dec d WHERE NOT (utt_idx = 2 AND EXISTS (
    SELECT 1 FROM v_dec x WHERE x.meeting_id = d.meeting_id AND x.utt_idx = 2 AND x.action = 'REPLACE'))""")
def _(v):
    return ed.parse_decisions(answers(v), candidates(v))[0].select("meeting_id", "utt_idx", "grounding_id", "action")


@query("c06_decision_coverage", "SELECT DISTINCT meeting_id, utt_idx FROM v_dec WHERE utt_idx = 2 AND action = 'REPLACE'")
def _(v):
    return ed.parse_decisions(answers(v), candidates(v))[1]


@query("c05_grounding_checks", """SELECT meeting_id, count(*) AS records, count(*) FILTER (WHERE char_start < prev) AS overlapping,
    count(*) FILTER (WHERE char_end > length(text)) AS outside FROM (SELECT *, lag(char_end) OVER (
      PARTITION BY meeting_id, utt_idx ORDER BY char_start) AS prev FROM v_dec) GROUP BY 1""")
def _(v):
    from dialogue_lake.operators import validate

    return validate.grounding_checks(decisions(v))


@query("c07_edit_replay", """SELECT meeting_id, count(*) AS utterances, count(*) AS replayed,
    CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS signature_kept FROM (SELECT meeting_id,
      """ + signature_sql(meaning_sql("text")) + " = " + signature_sql(meaning_sql("refined_text")) + """ AS kept FROM v_ref) GROUP BY 1""")
def _(v):
    from dialogue_lake.operators import validate

    return validate.edit_replay(refined(v), edit_log(v))


# --- claims ---
ROOM = 18_000 - len(cl.REQUEST_HEAD) - len(cl.REQUEST_TAIL) + 2
LONG_CHARS = 6_000


def record_view(utterances: str) -> str:
    """Utterances with their text in a request."""
    quoted = lambda c: f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
    return f"""SELECT *, '{{"applied_edit_ids": [], "raw_text": ' || {quoted("text")} || ', "refined_text": ' || {quoted("text")} ||
        ', "speaker_id": ' || {quoted("speaker_id")} || ', "utterance_id": ' || {quoted("utterance_id")} || '}}' AS record FROM {utterances}"""


def chunk_sql(records: str, room: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT meeting_id, utt_idx, length(record) + 2 AS size,
      sum(length(record) + 2) OVER (PARTITION BY meeting_id ORDER BY utt_idx) AS upto, count(*) OVER (PARTITION BY meeting_id) AS n FROM {records}),
    j AS (SELECT a.meeting_id, a.utt_idx AS first_utt, any_value(a.n) AS n, max(b.utt_idx) AS last_utt FROM s a JOIN s b
      ON b.meeting_id = a.meeting_id AND b.utt_idx >= a.utt_idx AND b.upto - a.upto + a.size <= {room} GROUP BY 1, 2),
    c AS (SELECT meeting_id, 1::BIGINT AS chunk_no, first_utt, last_utt, n FROM j WHERE first_utt = 0
      UNION ALL SELECT c.meeting_id, c.chunk_no + 1, j.first_utt, j.last_utt, j.n FROM c JOIN j ON j.meeting_id = c.meeting_id
        AND j.first_utt = greatest(c.first_utt + 1, c.last_utt + 1 - 2) WHERE c.last_utt < c.n - 1)
    SELECT meeting_id, chunk_no, first_utt, last_utt, NULL::VARCHAR AS error FROM c"""


view("v_said", record_view("v_u"))
view("v_lu", """SELECT conv_id // 64 AS meeting_id, row_number() OVER w - 1 AS utt_idx,
    'utt_' || lpad(CAST(row_number() OVER w AS VARCHAR), 6, '0') AS utterance_id, role AS speaker_id, text FROM conversations
    WINDOW w AS (PARTITION BY conv_id // 64 ORDER BY conv_id, turn)""")
view("v_lsaid", record_view("v_lu"))
CHUNKS = chunk_sql("v_said", ROOM)
LONG_CHUNKS = chunk_sql("v_lsaid", LONG_CHARS - 18_000 + ROOM)


def long_chunks(v):
    return v.shared("long_chunks", lambda: cl.build_chunks(v.long_utterances, LONG_CHARS, max_chunks=10_000))


@query("j02_build_chunks", CHUNKS)
def _(v):
    return cl.build_chunks(v.utterances)


@query("j02_long_meetings", LONG_CHUNKS)
def _(v):
    return long_chunks(v)


@query("d08_resolve_evidence", """SELECT i.meeting_id, i.item_id, i.position, u.utterance_id, u.speaker_id, u.start_ms, u.end_ms FROM (
    SELECT meeting_id, item_id, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) - 1 AS position FROM v_it) i
    JOIN v_u u ON u.meeting_id = i.meeting_id AND u.utterance_id = i.e""")
def _(v):
    return cl.resolve_evidence(v.items, v.utterances).drop("text", "utt_idx")


@query("c08_claim_rules", f"""WITH e AS (SELECT i.*, u.text AS src, u.speaker_id AS spk FROM (SELECT *, unnest(evidence_ids) AS cited FROM v_it) i
      LEFT JOIN v_u u ON u.meeting_id = i.meeting_id AND u.utterance_id = i.cited)
    SELECT meeting_id, item_id AS record_id, 'unknown_evidence' AS rule FROM e WHERE src IS NULL GROUP BY ALL
    UNION ALL SELECT meeting_id, item_id, 'owner_not_cited' FROM e WHERE section = 'action_items' AND owner_speaker IS NOT NULL
      GROUP BY ALL HAVING NOT bool_or(coalesce(owner_speaker = spk, false))
    UNION ALL SELECT meeting_id, item_id, 'deadline_not_cited' FROM e WHERE section = 'action_items' AND deadline_text IS NOT NULL
      GROUP BY ALL HAVING NOT bool_or(coalesce(contains(' ' || array_to_string({tokens_sql('src')}, ' ') || ' ',
        ' ' || array_to_string({tokens_sql('deadline_text')}, ' ') || ' '), false))""")
def _(v):
    return cl.claim_violations(v.items, v.utterances)


@query("c18_evidence_review", """SELECT DISTINCT meeting_id, item_id FROM (SELECT meeting_id, item_id, unnest(evidence_ids) AS e FROM v_it)
    WHERE (meeting_id, e) NOT IN (SELECT (meeting_id, utterance_id) FROM v_u)""")
def _(v):
    from dialogue_lake.operators import validate

    return validate.items_without_evidence(v.items, v.utterances)


@query("i02_all_items", "SELECT meeting_id, section, item_id FROM v_it")
def _(v):
    out = None
    for section in cl.PREFIX:
        part = v.items.filter(F.col("section") == section).drop("section").withColumn("section", F.lit(section))
        out = part if out is None else out.unionByName(part)
    return out.select("meeting_id", "section", "item_id")


def partials(v: Views):
    """Each claim as found in two overlapping chunks, the second citing one more turn."""
    first = v.items.withColumns({"chunk_no": F.lit(1).cast("bigint"), "item_no": F.col("utt_idx")})
    again = v.items.withColumns({
        "chunk_no": F.lit(2).cast("bigint"), "item_no": F.col("utt_idx"), "item_id": F.concat("item_id", F.lit("_b")),
        "evidence_ids": F.array_append("evidence_ids", F.lit("utt_000001"))})
    return first.unionByName(again)


view("v_comb", """SELECT meeting_id, section, min_by(item_id, utt_idx) AS item_id, text, topic, kind, owner_speaker, deadline_text,
    list_sort(list_distinct(list_append(flatten(list(evidence_ids)), 'utt_000001'))) AS evidence_ids
    FROM v_it GROUP BY meeting_id, section, text, topic, kind, owner_speaker, deadline_text""")


@query("i04_combine_partials", "SELECT meeting_id, section, item_id, array_to_string(evidence_ids, ',') AS evidence FROM v_comb")
def _(v):
    return cl.combine_partials(partials(v)).select("meeting_id", "section", "item_id", listed("evidence_ids").alias("evidence"))


def final_items(v: Views):
    return v.shared("final_items", lambda: cl.finalize_items(v.items.withColumn("identity", F.concat("text", F.lit("|"), "item_id"))))


view("v_fin", """SELECT *, CASE section WHEN 'summary' THEN 'sum' WHEN 'minutes' THEN 'min' WHEN 'decisions' THEN 'dec' ELSE 'act' END
    || '_' || lpad(CAST(row_number() OVER (PARTITION BY meeting_id, section ORDER BY list_min(evidence_ids), text, item_id) AS VARCHAR), 4, '0')
    AS final_id FROM v_it""")


@query("f07_finalize_items", "SELECT meeting_id, section, item_id, final_id FROM v_fin")
def _(v):
    return final_items(v).select("meeting_id", "section", "item_id", "final_id")


view("v_cg0", """SELECT meeting_id, section, item_id, row_number() OVER (PARTITION BY meeting_id, section ORDER BY utt_idx) AS n,
    lead(item_id) OVER (PARTITION BY meeting_id, section ORDER BY utt_idx) AS nxt FROM v_it""")
view("v_cg", """SELECT meeting_id, section, 'grp_' || section || '_' || n AS group_id, item_id AS primary_id,
    CASE WHEN meeting_id % 20 = 3 THEN ['item_999999'] WHEN nxt IS NULL THEN [] ELSE [nxt] END AS merge_ids FROM v_cg0 WHERE n % 2 = 1""")
view("v_cgm", """SELECT g.meeting_id, g.section, g.group_id, g.primary_id, g.p, g.m, i.text, i.owner_speaker, i.deadline_text, i.kind, i.evidence_ids FROM (
    SELECT *, unnest(list_prepend(primary_id, merge_ids)) AS m, generate_subscripts(list_prepend(primary_id, merge_ids), 1) AS p FROM v_cg) g
    LEFT JOIN v_it i ON i.meeting_id = g.meeting_id AND i.section = g.section AND i.item_id = g.m""")
view("v_cgr", """SELECT meeting_id, group_id, 'unknown_item' AS rule FROM v_cgm WHERE text IS NULL GROUP BY ALL
    UNION ALL SELECT meeting_id, group_id, 'item_reused' FROM v_cgm WHERE (meeting_id, m) IN (SELECT (meeting_id, m) FROM v_cgm GROUP BY meeting_id, m HAVING count(*) > 1) GROUP BY ALL
    UNION ALL SELECT meeting_id, group_id, 'conflicting_owner_or_deadline' FROM v_cgm WHERE section = 'action_items' GROUP BY ALL
      HAVING count(DISTINCT coalesce(owner_speaker, '') || '|' || coalesce(deadline_text, '')) > 1 AND count(*) = count(text)
    UNION ALL SELECT meeting_id, group_id, 'conflicting_kind' FROM v_cgm WHERE section = 'minutes' GROUP BY ALL
      HAVING count(DISTINCT kind) > 1 AND count(*) = count(text)""")


def consolidation_groups(v: Views):
    """Neighbouring items of a section merged in pairs; some meetings name an unknown item."""
    key = ["meeting_id", "section"]
    rows = ordered.scan(v.items.select(*key, "utt_idx", "item_id"), key, ["utt_idx"], ordered.bucket_of("utt_idx", 4096),
                        [ordered.numbered("n"), ordered.following("nxt", F.col("item_id"))])
    wrong = F.col("meeting_id") % 20 == 3
    return rows.filter(F.col("n") % 2 == 1).select(
        *key, F.concat(F.lit("grp_"), "section", F.lit("_"), "n").alias("group_id"), F.col("item_id").alias("primary_id"),
        F.when(wrong, F.array(F.lit("item_999999"))).when(F.col("nxt").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("nxt")).alias("merge_ids"))


@query("i05_apply_consolidation", """SELECT meeting_id, section, primary_id AS item_id, array_to_string(list_distinct_ordered, ',') AS evidence FROM (
    SELECT meeting_id, section, primary_id, group_id, list_reduce(list_prepend([]::VARCHAR[], list([x] ORDER BY p, q)),
      lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered
    FROM (SELECT *, unnest(evidence_ids) AS x, generate_subscripts(evidence_ids, 1) AS q FROM v_cgm) GROUP BY ALL)
    WHERE (meeting_id, group_id) NOT IN (SELECT (meeting_id, group_id) FROM v_cgr)""")
def _(v):
    return cl.apply_consolidation(consolidation_groups(v), v.items)[0].select(
        "meeting_id", "section", "item_id", listed("evidence_ids").alias("evidence"))


@query("c09_consolidation_rules", "SELECT meeting_id, group_id AS record_id, rule FROM v_cgr")
def _(v):
    return cl.apply_consolidation(consolidation_groups(v), v.items)[1]


ESC = (r"replace(replace(regexp_replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
       r"'([\\`*_\[\]()#!|])', '\\\1', 'g'), chr(13), ' '), chr(10), ' ')")
view("v_sec", "SELECT * FROM (VALUES (1::BIGINT, 'summary', 'Meeting summary'), (2, 'minutes', 'Meeting minutes'), (3, 'decisions', 'Decisions'), (4, 'action_items', 'Action items')) AS s(section_no, section, heading)")


@query("a12_render_minutes", f"""SELECT meeting_id, section_no, '' AS final_id, 0::BIGINT AS line_no, md5('## ' || heading) AS hash FROM v_dur, v_sec
    UNION ALL SELECT meeting_id, section_no, '', 1, md5('None recorded.') FROM v_dur, v_sec WHERE (meeting_id, section) NOT IN (SELECT (meeting_id, section) FROM v_it)
    UNION ALL SELECT meeting_id, section_no, final_id, 0, md5('- ' || final_id || ': ' || {ESC.format("(CASE section WHEN 'minutes' THEN '[' || topic || ' / ' || kind || '] ' ELSE '' END || text)")}) FROM v_fin JOIN v_sec USING (section)
    UNION ALL SELECT meeting_id, 4, final_id, 1, md5('  Owner: ' || {ESC.format("coalesce(owner_speaker, 'unspecified')")} || '; deadline: ' || {ESC.format("coalesce(deadline_text, 'unspecified')")}) FROM v_fin WHERE section = 'action_items'
    UNION ALL SELECT i.meeting_id, s.section_no, i.final_id, i.p * 2 + k, md5(CASE k WHEN 0 THEN '  Evidence: ' || u.utterance_id || ' / ' || u.speaker_id || ' / ' || {TS.format('u.start_ms')} || '–' || {TS.format('u.end_ms')}
        ELSE '  Source: ' || {ESC.format('u.text')} END) FROM (SELECT *, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS p FROM v_fin) i
      JOIN v_u u ON u.meeting_id = i.meeting_id AND u.utterance_id = i.e JOIN v_sec s ON s.section = i.section, (VALUES (0), (1)) AS kk(k)""")
def _(v):
    items = final_items(v)
    ids = items.select("meeting_id", "item_id", "final_id")
    evidence = cl.resolve_evidence(items, v.utterances).join(ids, ["meeting_id", "item_id"])
    return cl.render_minutes(items, evidence, v.durations).select(
        "meeting_id", "section_no", "final_id", "line_no", F.md5("line").alias("hash"))


@query("a11_render_transcript", f"""SELECT meeting_id, utt_idx, md5('[' || {TS.format('start_ms')} || ' --> ' || {TS.format('end_ms')} || '] ' || speaker_id || ': ' || text) AS hash FROM v_u""")
def _(v):
    from dialogue_lake.sources import sinks

    return sinks.transcript_lines(v.utterances).select("meeting_id", "utt_idx", F.md5("line").alias("hash"))


@query("a13_evidence_manifest", """SELECT i.meeting_id, i.item_id, count(*) AS citations FROM (SELECT *, unnest(evidence_ids) AS e FROM v_it) i
    JOIN v_u u ON u.meeting_id = i.meeting_id AND u.utterance_id = i.e GROUP BY ALL""")
def _(v):
    return cl.evidence_manifest(cl.resolve_evidence(v.items, v.utterances)).drop("manifest")


def request_sql(chunks: str, records: str) -> str:
    """Each chunk's request and the schema of its answer, as digests."""
    one = lambda **fields: {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    text, none = {"type": "string"}, {"type": "null"}
    evidence = {"type": "array", "items": {"type": "string", "enum": "@ids"}}
    owner = {"anyOf": ["@speaker", one(kind={"type": "string", "enum": ["named_entity"]}, speaker_id=none, display_text=text), none]}
    said = one(text=text, evidence_utterance_ids=evidence)
    minute = one(text=text, evidence_utterance_ids=evidence, topic=text, kind={"type": "string", "enum": list(fixed.MINUTE_KINDS)})
    action = one(task=text, owner=owner, deadline_text={"type": ["string", "null"]}, evidence_utterance_ids=evidence)
    array = lambda items: {"type": "array", "items": items}
    schema = json.dumps(one(summary=array(said), minutes=array(minute), decisions=array(said), action_items=array(action)))
    speaker = json.dumps(one(kind={"type": "string", "enum": ["speaker"]}, speaker_id={"type": "string", "enum": "@speakers"}, display_text=none))
    schema = schema.replace('"@speaker"', speaker).replace('"@ids"', "[' || ids || ']").replace('"@speakers"', "[' || names || ']")
    return f"""SELECT meeting_id, chunk_no, n_utterances, speakers, sha256('{cl.REQUEST_HEAD}' || records || '{cl.REQUEST_TAIL}') AS request,
        sha256('{schema}') AS response_schema FROM (
      SELECT c.meeting_id, c.chunk_no, count(*) AS n_utterances, string_agg(DISTINCT u.speaker_id, ',' ORDER BY u.speaker_id) AS speakers,
        string_agg(DISTINCT CAST(to_json(u.speaker_id) AS VARCHAR), ', ' ORDER BY CAST(to_json(u.speaker_id) AS VARCHAR)) AS names,
        string_agg('"' || u.utterance_id || '"', ', ' ORDER BY u.utt_idx) AS ids, string_agg(u.record, ', ' ORDER BY u.utt_idx) AS records
      FROM ({chunks}) c JOIN {records} u ON u.meeting_id = c.meeting_id AND u.utt_idx BETWEEN c.first_utt AND c.last_utt GROUP BY ALL)"""


def requests(chunks, utterances):
    from dialogue_lake.operators import audit

    return audit.extraction_requests(chunks, utterances).select(
        "meeting_id", "chunk_no", "n_utterances", listed("speakers").alias("speakers"), F.sha2("request", 256).alias("request"),
        F.sha2("response_schema", 256).alias("response_schema"))


@query("j06_extraction_requests", request_sql(CHUNKS, "v_said"))
def _(v):
    return requests(cl.build_chunks(v.utterances), v.utterances)


@query("j06_long_meetings", request_sql(LONG_CHUNKS, "v_lsaid"))
def _(v):
    return requests(long_chunks(v), v.long_utterances)


@query("e26_meeting_overview", """SELECT u.meeting_id, speakers, duration_ms, coalesce(refs, 0) AS evidence_refs, coalesce(items, 0) AS items
    FROM (SELECT meeting_id, count(DISTINCT speaker_id) AS speakers, max(end_ms) AS duration_ms FROM v_u GROUP BY 1) u
    LEFT JOIN (SELECT meeting_id, CAST(sum(len(evidence_ids)) AS BIGINT) AS refs, count(*) AS items FROM v_it GROUP BY 1) i USING (meeting_id)""")
def _(v):
    from dialogue_lake.operators import review

    return review.meeting_overview(v.utterances, v.items)


@query("e26_topics", """SELECT meeting_id, topic, items, row_number() OVER (PARTITION BY meeting_id ORDER BY f, topic) AS topic_no FROM (
    SELECT meeting_id, topic, count(*) AS items, min(utt_idx) AS f FROM v_it GROUP BY ALL)""")
def _(v):
    return cl.topics_in_order(v.items).drop("first_utt")


# --- answers to extraction requests, some of them not of the form ---
KIND_NAMES = {"concern": "concern", "fact": "information", "question": "discussion"}


def extraction_answers(v: Views):
    """One answer a meeting; every eighth has an unknown kind, a null, a name that is not asked for, ..."""
    kind = F.when(F.col("meeting_id") % 8 == 4, F.col("kind")).otherwise(
        F.element_at(F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv]), F.col("kind")))
    evidence = F.col("evidence_ids").alias("evidence_utterance_ids")
    owner = F.when(F.col("owner_speaker").isNotNull(), F.struct(
        F.lit("speaker").alias("kind"), F.col("owner_speaker").alias("speaker_id"), F.lit(None).cast("string").alias("display_text")))
    said = {
        "summary": F.struct("text", evidence), "minutes": F.struct("text", "topic", kind.alias("kind"), evidence), "decisions": F.struct("text", evidence),
        "action_items": F.struct(F.col("text").alias("task"), owner.alias("owner"), "deadline_text", evidence)}
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == n, F.struct("utt_idx", x.alias("x"))))), lambda e: e["x"]).alias(n) for n, x in said.items()]
    whole = v.items.groupBy("meeting_id").agg(*lists).select("meeting_id", F.to_json(F.struct(*said), {"ignoreNullFields": "false"}).alias("p"))
    text, turn = F.col("p"), F.col("meeting_id") % 8
    return whole.select("meeting_id", F.when(turn == 1, F.replace(text, F.lit('"decisions":'), F.lit('"decision":'))).when(turn == 2, F.concat(text, F.lit(" x")))
                        .when(turn == 3, F.concat(F.lit('{"summary":[],'), F.substring(text, F.lit(2), F.length(text))))
                        .when(turn == 5, F.replace(text, F.lit('"topic":"topic_0"'), F.lit('"topic":null'))).otherwise(text).alias("payload"))


_cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_NAMES.items())
_lists = ", ".join(
    f"coalesce(list({x} ORDER BY utt_idx) FILTER (WHERE section = '{n}'), []) AS {n}" for n, x in {
        "summary": "{'text': text, 'evidence_utterance_ids': evidence_ids}",
        "minutes": "{'text': text, 'topic': topic, 'kind': CASE WHEN meeting_id % 8 = 4 THEN kind ELSE CASE kind " + _cases + " END END, 'evidence_utterance_ids': evidence_ids}",
        "decisions": "{'text': text, 'evidence_utterance_ids': evidence_ids}",
        "action_items": "{'task': text, 'owner': CASE WHEN owner_speaker IS NOT NULL THEN {'kind': 'speaker', 'speaker_id': owner_speaker, 'display_text': NULL::VARCHAR} END, "
                        "'deadline_text': deadline_text, 'evidence_utterance_ids': evidence_ids}"}.items())
view("v_ans", f"""SELECT meeting_id, CASE meeting_id % 8 WHEN 1 THEN replace(p, '"decisions":', '"decision":') WHEN 2 THEN p || ' x' WHEN 3 THEN '{{"summary":[],' || p[2:]
    WHEN 5 THEN replace(p, '"topic":"topic_0"', '"topic":null') ELSE p END AS payload FROM (
    SELECT meeting_id, CAST(to_json({{'summary': summary, 'minutes': minutes, 'decisions': decisions, 'action_items': action_items}}) AS VARCHAR) AS p
    FROM (SELECT meeting_id, {_lists} FROM v_it GROUP BY 1))""")
_shape = cl.extraction_shape()
_places = ", ".join(
    f"('{path}', {strings(x.types)}, {x.most if x.most is not None else 'NULL::INT'}, {strings(x.values) if x.values else 'NULL::VARCHAR[]'}, {x.filled})" for path, x in _shape.places.items())
_children = ", ".join(f"('{path}', {strings(names)})" for path, names in _shape.children().items())
view("v_place", f"SELECT * FROM (VALUES {_places}) AS p(pattern, types, most, allowed, filled)")
view("v_child", f"SELECT * FROM (VALUES {_children}) AS p(pattern, names)")
view("v_tree", """SELECT a.meeting_id, t.fullkey AS path, regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS pattern, t.value, t.atom,
    CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean'
      WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind
    FROM (SELECT * FROM v_ans WHERE json_valid(payload) AND len(json_keys(payload)) = len(list_distinct(json_keys(payload)))) a, json_tree(a.payload) t""")
view("v_bad", """SELECT meeting_id, '$' AS path, CASE WHEN json_valid(payload) THEN 'repeated_field' ELSE 'invalid_json' END AS rule FROM v_ans
      WHERE NOT json_valid(payload) OR len(json_keys(payload)) > len(list_distinct(json_keys(payload)))
    UNION ALL SELECT t.meeting_id, t.path, 'unknown_field' FROM v_tree t WHERE t.pattern NOT IN (SELECT pattern FROM v_place)
      AND regexp_extract(t.pattern, '^(.*)\\.[^.\\[\\]]*$', 1) IN (SELECT pattern FROM v_place WHERE list_contains(types, 'object'))
    UNION ALL SELECT t.meeting_id, t.path, unnest(list_filter([CASE WHEN NOT list_contains(p.types, t.kind) THEN 'wrong_type' END,
        CASE WHEN t.kind = 'array' AND json_array_length(t.value) > p.most THEN 'too_many_items' END,
        CASE WHEN t.kind = 'string' AND NOT list_contains(p.allowed, t.value ->> '$') THEN 'not_allowed' END,
        CASE WHEN t.kind = 'string' AND p.filled AND trim(t.value ->> '$') = '' THEN 'blank_text' END], lambda x: x IS NOT NULL)) FROM v_tree t JOIN v_place p USING (pattern)
    UNION ALL SELECT meeting_id, path || '.' || name, 'missing_field' FROM (
      SELECT t.meeting_id, t.path, unnest(list_filter(c.names, lambda n: NOT list_contains(json_keys(t.value), n))) AS name
      FROM v_tree t JOIN v_child c USING (pattern) WHERE t.kind = 'object')""")


@query("j07_extraction_violations", "SELECT meeting_id, path, rule FROM v_bad")
def _(v):
    return cl.parse_extraction(extraction_answers(v), ["meeting_id"])[1]


_prefixes = " ".join(f"WHEN '{n}' THEN '{p}'" for n, p in cl.PREFIX.items())


@query("j07_extraction_items", f"""SELECT meeting_id, section, CASE section {_prefixes} END || '_' || lpad(CAST(row_number() OVER (
      PARTITION BY meeting_id, section ORDER BY utt_idx) AS VARCHAR), 4, '0') AS item_id, text,
    CASE WHEN section = 'action_items' THEN owner_speaker END AS owner_speaker, CASE WHEN section = 'action_items' THEN deadline_text END AS deadline_text,
    array_to_string(evidence_ids, ',') AS evidence FROM v_it WHERE meeting_id NOT IN (SELECT meeting_id FROM v_bad)""")
def _(v):
    return cl.parse_extraction(extraction_answers(v), ["meeting_id"])[0].select(
        "meeting_id", "section", "item_id", "text", "owner_speaker", "deadline_text", listed("evidence_ids").alias("evidence"))

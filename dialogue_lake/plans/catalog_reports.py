"""Evaluation metric, validation and read-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import agreement as ag
from dialogue_lake.operators import attribution as at
from dialogue_lake.operators import intervals as iv
from dialogue_lake.operators import metrics as me
from dialogue_lake.operators import review as rv
from dialogue_lake.operators import terms as tm
from dialogue_lake.operators import validate as va
from dialogue_lake.plans.catalog_audit import coverage_result, evolution, typed
from dialogue_lake.plans.catalog_claims import edit_log
from dialogue_lake.plans.catalog_speech import (
    attributed,
    flagged,
    mapping,
    utterance_reliability,
    utterances,
    word_reliability,
)
from dialogue_lake.plans.catalog_terms import EDITED, FLAGS, context_terms, edited, meaning_sql, signature_sql, tokens_sql
from dialogue_lake.plans.registry import listed, query, view
from dialogue_lake.plans.sql_views import strings
from dialogue_lake.plans.views import Views
from dialogue_lake.sources import readers, sinks

# --- metrics ---


def wer_sql(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\S+')"


def edits_view(pairs: str) -> str:
    """Token errors of (id..., r, h) rows by the dynamic programme, one token of ``r`` a step."""
    return f"""WITH RECURSIVE walk AS (
      SELECT *, 0 AS i, range(0, len(h) + 1) AS cost FROM ({pairs})
      UNION ALL SELECT * EXCLUDE (step, i, cost), i + 1 AS i, [list_min(step[1:j]) + j for j in range(1, len(h) + 2)] AS cost FROM (
        SELECT *, [least(cost[j] + 1, CASE WHEN j > 1 THEN cost[j - 1] + CASE WHEN h[j - 1] = r[i + 1] THEN 0 ELSE 1 END ELSE 1000000000 END) - j
          for j in range(1, len(h) + 2)] AS step FROM walk WHERE i < len(r)))
    SELECT * EXCLUDE (i, cost, r, h), CAST(cost[len(h) + 1] AS BIGINT) AS word_errors, CAST(len(r) AS BIGINT) AS reference_words,
      CAST(len(h) AS BIGINT) AS hypothesis_words FROM walk WHERE i = len(r)"""


view("v_wer", edits_view(f"SELECT meeting_id, utt_idx, {wer_sql('text')} AS r, {wer_sql(EDITED)} AS h FROM v_u"))


def word_pairs(v: Views):
    return v.utterances.select("meeting_id", "utt_idx", F.col("text").alias("reference"), edited(F.col("text")).alias("hypothesis"))


@query("e11_word_error_rate", """SELECT *, CASE WHEN reference_words > 0 THEN round(word_errors / reference_words, 6)
    WHEN hypothesis_words = 0 THEN 0 END AS wer FROM v_wer""")
def _(v):
    return me.word_error_rate(word_pairs(v)).drop("reference", "hypothesis")


@query("e11_corpus_error_rate", """SELECT meeting_id, count(*) AS texts, CAST(sum(word_errors) AS BIGINT) AS word_errors,
    CAST(sum(reference_words) AS BIGINT) AS reference_words, CAST(sum(hypothesis_words) AS BIGINT) AS hypothesis_words,
    round(sum(word_errors) / nullif(sum(reference_words), 0), 6) AS wer FROM v_wer GROUP BY meeting_id""")
def _(v):
    return me.corpus_error_rate(word_pairs(v), ["meeting_id"])


# Three versions of a heard text: as heard, one kind of mistake mended, two mended.
view("v_ct", f"""SELECT meeting_id || '-' || utt_idx AS case_id, condition, text AS reference, {EDITED} AS raw_text, CASE condition WHEN 'baseline' THEN {EDITED}
    WHEN 'context_only' THEN replace({EDITED}, ' 7 ', ' to ') ELSE replace(replace({EDITED}, ' 7 ', ' to '), ' not ', ' and ') END AS version
    FROM v_u, (SELECT unnest(['baseline', 'context_only', 'closed_loop']) AS condition)""")
view("v_ctw", edits_view(f"SELECT case_id, condition, {wer_sql('reference')} AS r, {wer_sql('version')} AS h FROM v_ct"))
view("v_ctt", f"""SELECT case_id, condition, CAST(sum(least(e, f)) AS BIGINT) AS true_terms, CAST(sum(e) AS BIGINT) AS reference_terms, CAST(sum(f) AS BIGINT) AS predicted_terms
    FROM (SELECT case_id, condition, w, sum(e) AS e, sum(f) AS f FROM (
      SELECT case_id, condition, unnest({tokens_sql('reference')}) AS w, 1 AS e, 0 AS f FROM v_ct UNION ALL
      SELECT case_id, condition, unnest({tokens_sql('version')}), 0, 1 FROM v_ct) WHERE w IN (SELECT canonical FROM v_g) GROUP BY ALL) GROUP BY ALL""")
_kinds = " + ".join(
    f"CAST(list_filter(a, lambda t: {test}) <> list_filter(b, lambda t: {test}) AS BIGINT)" for test in FLAGS.values())
view("v_ctc", f"""SELECT case_id, condition, {_kinds} + CAST({signature_sql('a')} <> {signature_sql('b')} AS BIGINT) AS changes
    FROM (SELECT case_id, condition, {meaning_sql('raw_text')} AS a, {meaning_sql('version')} AS b FROM v_ct)""")
view("v_ctj", """SELECT c.case_id, c.condition, c.changes, w.word_errors, w.reference_words, coalesce(t.true_terms, 0) AS true_terms,
    coalesce(t.reference_terms, 0) AS reference_terms, coalesce(t.predicted_terms, 0) AS predicted_terms FROM v_ctc c JOIN v_ctw w USING (case_id, condition)
    LEFT JOIN v_ctt t USING (case_id, condition)""")
_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
    "word_errors", "reference_words", "true_terms", "reference_terms", "predicted_terms", "changes", "error_difference", "term_difference", "change_difference"))


@query("e14_compare_conditions", f"""SELECT *, round(word_errors / nullif(reference_words, 0), 6) AS wer, round(true_terms / nullif(predicted_terms, 0), 6) AS precision,
    round(true_terms / nullif(reference_terms, 0), 6) AS recall,
    round(CASE WHEN true_terms > 0 THEN 2.0 * true_terms / (predicted_terms + reference_terms) END, 6) AS f1 FROM (
    SELECT condition, case_id, CAST(grouping(case_id) AS INT) AS total, count(*) AS cases, {_sums} FROM (
      SELECT j.*, j.word_errors - b.word_errors AS error_difference, j.true_terms - b.true_terms AS term_difference, j.changes - b.changes AS change_difference
      FROM v_ctj j JOIN v_ctj b ON b.case_id = j.case_id AND b.condition = 'baseline') GROUP BY GROUPING SETS ((condition, case_id), (condition)))""")
def _(v):
    heard = edited(F.col("text"))
    mended = F.replace(heard, F.lit(" 7 "), F.lit(" to "))
    versions = F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("baseline", "context_only", "closed_loop")]), F.array(heard, mended, F.replace(mended, F.lit(" not "), F.lit(" and ")))))
    case = F.concat_ws("-", "meeting_id", "utt_idx").alias("case_id")
    texts = v.utterances.select(case, versions.alias("condition", "text"))
    cases = v.utterances.select(case, heard.alias("raw_text"), F.col("text").alias("reference"))
    return me.compare_conditions(texts, cases, v.glossary.select(F.col("canonical").alias("term")), "baseline")


@query("e13_term_metrics", f"""SELECT term, true_terms, false_terms, reference_terms, predicted_terms, round(true_terms / predicted_terms, 6) AS precision,
    round(true_terms / nullif(reference_terms, 0), 6) AS recall, round(CASE WHEN true_terms > 0 THEN 2.0 * true_terms / (predicted_terms + reference_terms) END, 6) AS f1
    FROM (SELECT term, CAST(sum(least(e, f)) AS BIGINT) AS true_terms, CAST(sum(greatest(0, f - e)) AS BIGINT) AS false_terms,
      CAST(sum(e) AS BIGINT) AS reference_terms, CAST(sum(f) AS BIGINT) AS predicted_terms FROM (
      SELECT term, len(list_filter({tokens_sql('text')}, lambda t: t = term)) AS e, len(list_filter({tokens_sql(EDITED)}, lambda t: t = term)) AS f
      FROM v_u, (SELECT unnest(['and', 'the', 'of', 'der']) AS term)) GROUP BY 1)""")
def _(v):
    term = F.explode(F.array(*[F.lit(t) for t in ("and", "the", "of", "der")]))
    rows = v.utterances.select("text", term.alias("term")).select(
        "term", tx.count_term(F.col("text"), F.col("term")).cast("bigint").alias("expected"),
        tx.count_term(edited(F.col("text")), F.col("term")).cast("bigint").alias("found"))
    return me.term_metrics(rows, ["term"])


@query("e16_edit_metrics", """SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'applied') AS applied FROM v_log""".replace(
    "SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'applied') AS applied FROM v_log",
    """SELECT cases, round(tp / nullif(predicted, 0), 6) AS precision, round(tp / nullif(positives, 0), 6) AS recall,
    round(coalesce(2.0 * tp / nullif(predicted + positives, 0), 0), 6) AS f1, round(wrong / nullif(cases - positives, 0), 6) AS false_correction_rate,
    round(keep_ok / nullif(cases - positives, 0), 6) AS keep_rate, round(replace_ok / nullif(positives, 0), 6) AS replace_rate, NULL::DOUBLE AS uncertain_rate,
    0::BIGINT AS protected_changes, round(coalesce(wrong / nullif(predicted, 0), 0), 6) AS meaning_changing_rate FROM (
    SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'applied' AND x = 'REPLACE') AS tp, count(*) FILTER (WHERE status = 'applied') AS predicted,
      count(*) FILTER (WHERE x = 'REPLACE') AS positives, count(*) FILTER (WHERE status = 'applied' AND x <> 'REPLACE') AS wrong,
      count(*) FILTER (WHERE x = 'KEEP' AND action = 'KEEP') AS keep_ok, count(*) FILTER (WHERE x = 'REPLACE' AND action = 'REPLACE') AS replace_ok
    FROM (SELECT *, CASE WHEN record_no % 3 <> 0 THEN 'REPLACE' ELSE 'KEEP' END AS x FROM v_log))"""))
def _(v):
    expected = F.when(F.col("record_no") % 3 != 0, "REPLACE").otherwise("KEEP")
    applied = F.col("status") == "applied"
    return me.edit_metrics(edit_log(v).select(
        expected.alias("expected_action"), "action", applied.alias("applied"), (applied & (expected == "REPLACE")).alias("correct"),
        F.lit(False).alias("protected_changed")))


def gold_matches(v: Views):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    base = v.items.withColumn("tokens", tokens).withColumn("case_id", F.col("meeting_id"))
    owner, deadline, turn = F.col("owner_speaker"), F.col("deadline_text"), F.col("utt_idx")
    outputs = base.filter(F.col("section") != "summary").select(
        "case_id", turn.alias("item_no"), "tokens", "section", "evidence_ids", owner.alias("owner"), deadline.alias("deadline"))
    words = F.transform(F.slice("tokens", 1, 2), lambda t: F.array(t))
    gold = base.filter(F.size("tokens") > 1).select(
        "case_id", turn.alias("gold_no"), words.alias("keywords"), "section", "evidence_ids",
        F.when(turn % 9 == 3, "assistant").otherwise(owner).alias("owner"), F.when(turn % 2 == 0, deadline).alias("deadline"))
    return outputs, gold, me.match_gold(outputs, gold)


_itk = f"SELECT *, {tokens_sql('text')} AS tokens FROM v_it"
view("v_out", f"""SELECT meeting_id AS case_id, utt_idx AS item_no, tokens, section, evidence_ids, owner_speaker AS owner, deadline_text AS deadline
    FROM ({_itk}) WHERE section <> 'summary'""")
view("v_gold", f"""SELECT meeting_id AS case_id, utt_idx AS gold_no, tokens, section, evidence_ids, CASE WHEN utt_idx % 9 = 3 THEN 'assistant' ELSE owner_speaker END AS owner,
    CASE WHEN utt_idx % 2 = 0 THEN deadline_text END AS deadline FROM ({_itk}) WHERE len(tokens) > 1""")
view("v_fit", """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY item_no) AS k FROM (
    SELECT o.case_id, o.item_no, list(g.gold_no ORDER BY g.gold_no) AS golds FROM v_out o JOIN v_gold g ON g.case_id = o.case_id
      AND list_contains(o.tokens, g.tokens[1]) AND list_contains(o.tokens, g.tokens[2]) GROUP BY ALL)""")
view("v_match", """WITH RECURSIVE walk AS (
      SELECT DISTINCT case_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS item_no, NULL::BIGINT AS gold_no FROM v_fit
      UNION ALL SELECT case_id, k, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, item_no, x FROM (
        SELECT w.case_id, f.k, w.used, f.item_no, [g for g in f.golds if NOT list_contains(w.used, g)][1] AS x
        FROM walk w JOIN v_fit f ON f.case_id = w.case_id AND f.k = w.k + 1))
    SELECT case_id, item_no, gold_no FROM walk WHERE gold_no IS NOT NULL""")


@query("d25_match_gold", "SELECT case_id, item_no, gold_no FROM v_match")
def _(v):
    return gold_matches(v)[2]


@query("e17_extraction_metrics", """SELECT section, tp, outputs - tp AS fp, gold - tp AS fn, round(tp / nullif(outputs, 0), 6) AS precision, round(tp / nullif(gold, 0), 6) AS recall,
    round(2 * tp / nullif(outputs + gold, 0), 6) AS f1, round(owner_ok / nullif(tp, 0), 6) AS owner_accuracy, round(deadline_ok / nullif(tp, 0), 6) AS deadline_accuracy,
    false_owners, false_deadlines, refs - valid AS unknown_evidence, round(valid / nullif(refs, 0), 6) AS evidence_validity,
    round(citing / nullif(outputs, 0), 6) AS evidence_coverage, round(shared / nullif(cited, 0), 6) AS support_precision, round(shared / nullif(expected, 0), 6) AS support_recall
    FROM (SELECT section, gold, coalesce(outputs, 0) AS outputs, coalesce(tp, 0) AS tp, coalesce(owner_ok, 0) AS owner_ok, coalesce(deadline_ok, 0) AS deadline_ok, coalesce(false_owners, 0) AS false_owners, coalesce(false_deadlines, 0) AS false_deadlines, coalesce(refs, 0) AS refs, coalesce(citing, 0) AS citing, coalesce(valid, 0) AS valid, coalesce(cited, 0) AS cited, coalesce(expected, 0) AS expected, coalesce(shared, 0) AS shared
    FROM (SELECT section, count(*) AS gold FROM v_gold GROUP BY 1) LEFT JOIN (
      SELECT section, count(*) AS outputs, count(gold_no) AS tp, count(*) FILTER (WHERE gold_no IS NOT NULL AND owner IS NOT DISTINCT FROM g_owner) AS owner_ok,
        count(*) FILTER (WHERE gold_no IS NOT NULL AND deadline IS NOT DISTINCT FROM g_deadline) AS deadline_ok,
        count(*) FILTER (WHERE owner IS NOT NULL AND (gold_no IS NULL OR owner IS DISTINCT FROM g_owner)) AS false_owners,
        count(*) FILTER (WHERE deadline IS NOT NULL AND (gold_no IS NULL OR deadline IS DISTINCT FROM g_deadline)) AS false_deadlines,
        CAST(sum(len(evidence_ids)) AS BIGINT) AS refs, count(*) FILTER (WHERE len(evidence_ids) > 0) AS citing,
        CAST(sum(len([e for e in evidence_ids if list_contains(known, e)])) AS BIGINT) AS valid,
        coalesce(sum(len(list_distinct(evidence_ids))) FILTER (WHERE gold_no IS NOT NULL), 0) AS cited,
        coalesce(sum(len(list_distinct(g_evidence))) FILTER (WHERE gold_no IS NOT NULL), 0) AS expected,
        coalesce(sum(len(list_intersect(evidence_ids, g_evidence))) FILTER (WHERE gold_no IS NOT NULL), 0) AS shared
      FROM (SELECT o.*, m.gold_no, g.owner AS g_owner, g.deadline AS g_deadline, g.evidence_ids AS g_evidence, u.known FROM v_out o
        LEFT JOIN v_match m USING (case_id, item_no) LEFT JOIN v_gold g ON g.case_id = o.case_id AND g.gold_no = m.gold_no
        JOIN (SELECT meeting_id, list(utterance_id) AS known FROM v_u GROUP BY 1) u ON u.meeting_id = o.case_id) GROUP BY 1) USING (section))""")
def _(v):
    return me.extraction_metrics(*gold_matches(v), v.utterances.select(F.col("meeting_id").alias("case_id"), "utterance_id"))


_gold_event = f"{strings(fixed.EVENT_TYPES)}[(meeting_id * 5 + utt_idx) % 14 + 1]"


def gold_events(v: Views):
    labels = F.array(*[F.lit(t) for t in fixed.EVENT_TYPES])
    return v.utterances.select("meeting_id", "utt_idx", F.element_at(labels, ((F.col("meeting_id") * 5 + F.col("utt_idx")) % 14 + 1).cast("int")).alias("label"))


@query("e18_event_scores", f"""SELECT class, expected, observed, correct, round(p, 6) AS precision, round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *,
      CASE WHEN observed > 0 THEN correct / observed ELSE CAST(expected = 0 AS DOUBLE) END AS p, CASE WHEN expected > 0 THEN correct / expected ELSE CAST(observed = 0 AS DOUBLE) END AS r FROM (
      SELECT class, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(o) AS BIGINT) AS observed, CAST(sum(e * o) AS BIGINT) AS correct FROM (
        SELECT unnest([label, '(micro)']) AS class, e, o FROM (SELECT label, max(e) AS e, max(o) AS o FROM (
          SELECT meeting_id, utt_idx, {_gold_event} AS label, 1 AS e, 0 AS o FROM v_u UNION ALL SELECT meeting_id, utt_idx, choice, 0, 1 FROM v_acc)
          WHERE label NOT IN ('NONE', 'AMBIGUOUS') GROUP BY meeting_id, utt_idx, label)) GROUP BY 1))""")
def _(v):
    wanted = gold_events(v).filter(~F.col("label").isin("NONE", "AMBIGUOUS"))
    seen = typed(v).filter(F.col("outcome") == "accepted").select("meeting_id", "utt_idx", F.col("choice").alias("label"))
    return me.set_scores(wanted, seen, ["meeting_id", "utt_idx"], "label")


@query("e19_confusion_matrix", f"""SELECT {_gold_event} AS reference, CASE WHEN choice NOT IN ('NONE', 'AMBIGUOUS') AND p >= 0.85 THEN choice
    WHEN p >= 0.6 AND choice <> 'NONE' THEN 'AMBIGUOUS' ELSE 'NONE' END AS observed, count(*) AS count FROM v_ev GROUP BY 1, 2""")
def _(v):
    output = F.when(F.col("outcome") == "accepted", F.col("choice")).when(F.col("outcome") == "ambiguous", "AMBIGUOUS").otherwise("NONE")
    return typed(v).join(gold_events(v), ["meeting_id", "utt_idx"]).groupBy(F.col("label").alias("reference"), output.alias("observed")).count()


view("v_pr", """SELECT d.doc_id, l.quality AS gold, (d.n_chars % 101) / 100.0::DOUBLE AS q FROM documents d JOIN labels l USING (doc_id)""")
view("v_pc", "SELECT doc_id, CAST(gold AS VARCHAR) AS gold, q, CASE WHEN q >= 0.5 THEN '1' ELSE '0' END AS choice, greatest(q, 1 - q) AS p FROM v_pr")


def predictions(v: Views):
    q = (F.col("n_chars") % 101) / 100
    return v.table("documents").select("doc_id", "n_chars").join(v.table("labels"), "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("gold"), F.when(q >= 0.5, "1").otherwise("0").alias("choice"),
        F.greatest(q, 1 - q).alias("p"), F.create_map(F.lit("0"), 1 - q, F.lit("1"), q).alias("probabilities"))


@query("e20_calibration", """SELECT CAST(sum(n) AS BIGINT) AS samples, round(sum(b) / sum(n), 6) AS brier, round(sum(n * abs(mp - acc)) / sum(n), 6) AS ece,
    round(sum(ok) / sum(n), 6) AS argmax_accuracy FROM (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS mp,
      avg(CAST(choice = gold AS DOUBLE)) AS acc, count(*) FILTER (WHERE choice = gold) AS ok,
      sum(power((1 - q) - CAST(gold = '0' AS DOUBLE), 2) + power(q - CAST(gold = '1' AS DOUBLE), 2)) AS b FROM v_pc GROUP BY 1)""")
def _(v):
    return me.calibration(predictions(v))


@query("e20_calibration_bins", """SELECT CAST(least(9, floor(p * 10)) AS BIGINT) AS bin, count(*) AS count, round(avg(p), 6) AS mean_probability,
    round(avg(CAST(choice = gold AS DOUBLE)), 6) AS accuracy FROM v_pc GROUP BY 1""")
def _(v):
    return me.calibration_bins(predictions(v).withColumn("right", F.col("choice") == F.col("gold")))


@query("e21_verification_accuracy", """SELECT question_id, count(*) AS count, count(*) FILTER (WHERE choice = gold) AS correct,
    round(count(*) FILTER (WHERE choice = gold) / count(*), 6) AS accuracy FROM v_vq GROUP BY 1""")
def _(v):
    right = F.count_if(F.col("choice") == F.col("gold"))
    n = F.count(F.lit(1))
    return v.answers.groupBy("question_id").agg(n.alias("count"), right.alias("correct"), F.round(right / n, 6).alias("accuracy"))


@query("e22_evolution_scores", """SELECT meeting_id AS case_id, count(*) FILTER (WHERE event_type = 'DECISION' AND state = 'historical') = 0 AS final_correct,
    count(*) FILTER (WHERE state = 'historical') = 0 AS supersession_correct FROM v_evo WHERE event_type = 'DECISION' GROUP BY 1""")
def _(v):
    decided = evolution(v).filter(F.col("event_type") == "DECISION").select(F.col("meeting_id").alias("case_id"), F.col("event_id").alias("unit_id"), "state")
    return me.evolution_scores(decided, decided.withColumn("state", F.lit("current_decision")))


@query("e23_coverage_accuracy", """SELECT event_type, count(*) AS annotated_events, count(*) FILTER (WHERE matched = expected) AS correct,
    round(count(*) FILTER (WHERE matched = expected) / count(*), 6) AS accuracy FROM (SELECT v.*, coalesce(x.expected, '') AS expected FROM v_cov v
    LEFT JOIN (SELECT meeting_id, event_id, string_agg(item_id, ',' ORDER BY item_id) AS expected FROM v_cc0 WHERE shared AND NOT wrong_type GROUP BY ALL) x
    USING (meeting_id, event_id)) GROUP BY 1""")
def _(v):
    wanted = typed(v).select("meeting_id", "event_id", "utterance_id", "choice").join(
        v.items.select("meeting_id", "item_id", "section", "kind", F.explode("evidence_ids").alias("utterance_id")), ["meeting_id", "utterance_id"])
    from dialogue_lake.operators.audit import _expected

    good = wanted.filter(_expected(F.col("choice"), F.col("section"), F.col("kind"))).groupBy("meeting_id", "event_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("expected"))
    rows = coverage_result(v).join(good, ["meeting_id", "event_id"], "left")
    same = F.count_if(F.col("matched") == F.coalesce("expected", F.array().cast("array<string>")))
    n = F.count(F.lit(1))
    return rows.groupBy("event_type").agg(n.alias("annotated_events"), same.alias("correct"), F.round(same / n, 6).alias("accuracy"))


@query("e25_call_usage", """SELECT meeting_id, stage, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(*) FILTER (WHERE retry) AS retries,
    CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS tokens FROM v_ca GROUP BY ALL""")
def _(v):
    return me.call_usage(v.calls, ["meeting_id", "stage"])


@query("e12_diagnostics_report", """SELECT meeting_id, duration_ms, detected_speakers, regular_turns, exclusive_turns, coalesce(overlap_regions, 0) AS overlap_regions,
    total_words, utterances FROM v_dur JOIN (SELECT meeting_id, count(DISTINCT speaker_id) AS detected_speakers, count(*) AS regular_turns FROM v_tr GROUP BY 1) USING (meeting_id)
    JOIN (SELECT meeting_id, count(*) AS exclusive_turns FROM v_tx GROUP BY 1) USING (meeting_id)
    LEFT JOIN (SELECT meeting_id, count(*) AS overlap_regions FROM v_regions GROUP BY 1) USING (meeting_id)
    JOIN (SELECT meeting_id, count(*) AS total_words FROM v_wd GROUP BY 1) USING (meeting_id) JOIN (SELECT meeting_id, count(*) AS utterances FROM v_utt GROUP BY 1) USING (meeting_id)""")
def _(v):
    info = at.reconciliation_info(flagged(v), utterances(v))
    return me.diagnostics_report(v.regular_turns, v.exclusive_turns, info, iv.overlap_regions(v.regular_turns), v.durations).select(
        "meeting_id", "duration_ms", "detected_speakers", "regular_turns", "exclusive_turns", "overlap_regions", "total_words", "utterances")


@query("e28_job_history", """SELECT meeting_id, count(DISTINCT event_id % 6) FILTER (WHERE stage <> 'error') AS completed,
    count(DISTINCT event_id % 6) FILTER (WHERE stage <> 'error') < 6 AS unfinished FROM v_ca GROUP BY 1""")
def _(v):
    rows = v.calls.select("meeting_id", (F.col("event_id") % 6).alias("stage"), F.when(F.col("stage") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
                          F.col("ts").alias("created_at"))
    return rv.job_history(rows).drop("newest")


# --- truth ---
view("v_tmx", """SELECT a.meeting_id, a.speaker_id AS row_id, b.speaker_id AS col_id, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS ov FROM v_union a
    JOIN v_tt b ON b.meeting_id = a.meeting_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms GROUP BY ALL""")
view("v_topt", """SELECT r.meeting_id, r.r, r.secondary_id AS row_id, c.c, c.col_id, coalesce(m.ov, 0) AS ov FROM v_rows r JOIN (
      SELECT meeting_id, col_id, row_number() OVER (PARTITION BY meeting_id ORDER BY col_id) AS c FROM (SELECT DISTINCT meeting_id, speaker_id AS col_id FROM v_tt)
      UNION ALL SELECT DISTINCT meeting_id, NULL, 99 FROM v_ts) c USING (meeting_id)
    LEFT JOIN v_tmx m ON m.meeting_id = r.meeting_id AND m.row_id = r.secondary_id AND m.col_id = c.col_id""")
view("v_tperm", """SELECT a.meeting_id, a.c AS c1, b.c AS c2, a.ov + coalesce(b.ov, 0) AS total FROM (SELECT * FROM v_topt WHERE r = 1) a
    LEFT JOIN (SELECT * FROM v_topt WHERE r = 2) b ON b.meeting_id = a.meeting_id AND (b.c = 99 OR b.c <> a.c)
    QUALIFY row_number() OVER (PARTITION BY a.meeting_id ORDER BY total DESC, c1, c2) = 1""")
view("v_smap", """SELECT o.meeting_id, o.row_id AS model_id, CASE WHEN o.ov > 0 THEN o.col_id END AS truth_id, CAST(CASE WHEN o.ov > 0 THEN o.ov ELSE 0 END AS BIGINT) AS overlap_ms
    FROM v_topt o JOIN v_tperm p USING (meeting_id) WHERE o.c = CASE o.r WHEN 1 THEN p.c1 ELSE p.c2 END""")


@query("e09_reference_mapping", "SELECT meeting_id, model_id, truth_id, overlap_ms FROM v_smap")
def _(v):
    return ag.reference_mapping(v.secondary_turns, v.truth_turns)


@query("d19_probe_truth", """SELECT w.meeting_id, w.segment_id, w.word_index, count(DISTINCT t.speaker_id) AS speakers_here,
    CASE WHEN count(DISTINCT t.speaker_id) = 1 THEN min(t.speaker_id) END AS truth_id FROM v_wd w LEFT JOIN v_tt t ON t.meeting_id = w.meeting_id
      AND 2 * t.start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * t.end_ms GROUP BY ALL""")
def _(v):
    probes = v.words.select("meeting_id", "segment_id", "word_index", (F.col("start_ms") + F.col("end_ms")).alias("at2"))
    return ag.truth_at(probes, v.truth_turns, ["segment_id", "word_index"]).drop("at2")


def strata(v: Views):
    words = word_reliability(v).select(
        "meeting_id", "segment_id", "word_index", "text", F.col("speaker_id").alias("primary_id"), F.col("agreement_fraction").alias("agreement"),
        (F.col("start_ms") + F.col("end_ms")).alias("at2"))
    ids = ["segment_id", "word_index"]
    told = ag.truth_at(words, v.truth_turns, ids).drop("speakers_here")
    heard = ag.truth_at(told.withColumnRenamed("truth_id", "_truth"), v.secondary_turns, ids).drop("speakers_here").withColumnRenamed(
        "truth_id", "secondary_id").withColumnRenamed("_truth", "truth_id")
    primary = ag.reference_mapping(v.regular_turns, v.truth_turns).select("meeting_id", F.col("model_id").alias("primary_id"), F.col("truth_id").alias("primary_truth"))
    secondary = ag.reference_mapping(v.secondary_turns, v.truth_turns).select("meeting_id", F.col("model_id").alias("secondary_id"), F.col("truth_id").alias("secondary_truth"))
    pairs = mapping(v).select("meeting_id", "secondary_id", F.col("primary_id").alias("mapped_secondary"))
    from dialogue_lake.operators.lookup import spread_join

    out = heard
    for side, key in ((primary, "primary_id"), (secondary, "secondary_id"), (pairs, "secondary_id")):
        out = spread_join(out, side, ["meeting_id", key], F.col("at2"))
    return out


@query("e07_stratified_accuracy")
def _(v):
    return me.stratified_accuracy(strata(v))


def error_cells(v: Views):
    turns = v.truth_turns.withColumn("layer", F.lit("truth")).unionByName(
        v.secondary_turns.select("meeting_id", "speaker_id", "start_ms", "end_ms").withColumn("layer", F.lit("model")))
    cells = iv.elementary_intervals(iv.boundaries(turns, ["meeting_id"]), ["meeting_id"])
    return iv.active_sets(cells, turns, {"truth": "truth", "model": "model"})


view("v_dp", """SELECT meeting_id, start_ms AS t FROM v_tt UNION SELECT meeting_id, end_ms FROM v_tt UNION SELECT meeting_id, start_ms FROM v_ts UNION SELECT meeting_id, end_ms FROM v_ts""")
view("v_dc", """SELECT * FROM (SELECT meeting_id, t AS s, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS e FROM v_dp) WHERE e IS NOT NULL""")
view("v_dn", """SELECT c.meeting_id, c.s, c.e, (SELECT count(DISTINCT t.speaker_id) FROM v_tt t WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nr,
    (SELECT count(DISTINCT t.speaker_id) FROM v_ts t WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nh,
    (SELECT count(DISTINCT t.speaker_id) FROM v_ts t JOIN v_smap m ON m.meeting_id = t.meeting_id AND m.model_id = t.speaker_id JOIN v_tt r ON r.meeting_id = t.meeting_id
      AND r.speaker_id = m.truth_id AND r.start_ms < c.e AND r.end_ms > c.s WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nc FROM v_dc c""")


@query("e10_diarization_error", """SELECT meeting_id, CAST(sum((e - s) * nr) AS BIGINT) AS truth_ms, CAST(sum((e - s) * greatest(0, nr - nh)) AS BIGINT) AS miss_ms,
    CAST(sum((e - s) * greatest(0, nh - nr)) AS BIGINT) AS false_ms, CAST(sum((e - s) * (least(nr, nh) - nc)) AS BIGINT) AS confusion_ms,
    CASE WHEN meeting_id % 2 = 0 THEN round(sum((e - s) * (greatest(nr, nh) - nc)) / nullif(sum((e - s) * nr), 0), 6) END AS der FROM v_dn GROUP BY 1""")
def _(v):
    verified = v.durations.select("meeting_id", (F.col("meeting_id") % 2 == 0).alias("verified"))
    return me.diarization_error(error_cells(v), ag.reference_mapping(v.secondary_turns, v.truth_turns), verified).drop("verified", "reason")


view("v_rt", "SELECT meeting_id, 'T_' || speaker_id AS speaker_id, start_ms, end_ms FROM v_tr")
view("v_edge", "SELECT meeting_id, start_ms AS t FROM v_rt UNION SELECT meeting_id, end_ms FROM v_rt")
view("v_kc", """SELECT * FROM (SELECT meeting_id, t AS s, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS e FROM (
      SELECT * FROM v_edge UNION SELECT meeting_id, t - 250 FROM v_edge UNION SELECT meeting_id, t + 250 FROM v_edge
      UNION SELECT meeting_id, start_ms FROM v_ts UNION SELECT meeting_id, end_ms FROM v_ts)) c
    WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_edge k WHERE k.meeting_id = c.meeting_id AND k.t - 250 < c.e AND k.t + 250 > c.s)""")
view("v_kn", """SELECT c.meeting_id, c.s, c.e, (SELECT count(DISTINCT t.speaker_id) FROM v_rt t WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nr,
    (SELECT count(DISTINCT t.speaker_id) FROM v_ts t WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nh,
    (SELECT count(DISTINCT t.speaker_id) FROM v_ts t JOIN v_smap m ON m.meeting_id = t.meeting_id AND m.model_id = t.speaker_id JOIN v_rt r ON r.meeting_id = t.meeting_id
      AND r.speaker_id = m.truth_id AND r.start_ms < c.e AND r.end_ms > c.s WHERE t.meeting_id = c.meeting_id AND t.start_ms < c.e AND t.end_ms > c.s) AS nc FROM v_kc c""")
_der = """SELECT meeting_id, CAST(sum((e - s) * nr) AS BIGINT) AS truth_ms, CAST(sum((e - s) * greatest(0, nr - nh)) AS BIGINT) AS miss_ms,
    CAST(sum((e - s) * greatest(0, nh - nr)) AS BIGINT) AS false_ms, CAST(sum((e - s) * (least(nr, nh) - nc)) AS BIGINT) AS confusion_ms,
    round(sum((e - s) * (greatest(nr, nh) - nc)) / nullif(sum((e - s) * nr), 0), 6) AS der FROM v_kn WHERE nr < {most} GROUP BY 1"""


def der_with(v: Views, skip_overlap: bool):
    truth = v.regular_turns.withColumn("speaker_id", F.concat(F.lit("T_"), "speaker_id"))
    cells = me.scored_cells(truth, v.secondary_turns, 500, skip_overlap)
    verified = v.durations.select("meeting_id", F.lit(True).alias("verified"))
    return me.diarization_error(cells, ag.reference_mapping(v.secondary_turns, v.truth_turns), verified).drop("verified", "reason")


@query("e10_collar", _der.format(most=1_000_000))
def _(v):
    return der_with(v, False)


@query("e10_skip_overlap", _der.format(most=2))
def _(v):
    return der_with(v, True)


@query("e10_jaccard_error")
def _(v):
    verified = v.durations.select("meeting_id", (F.col("meeting_id") % 2 == 0).alias("verified"))
    return me.jaccard_error(error_cells(v), ag.reference_mapping(v.secondary_turns, v.truth_turns), verified)


# --- validation ---
@query("c01_transcript_rules", """SELECT w.meeting_id, w.segment_id || '/' || w.word_index AS record_id, 'outside_segment' AS rule FROM v_wd w JOIN v_sg s USING (meeting_id, segment_id)
    WHERE w.start_ms < s.start_ms - 500 OR w.end_ms > s.end_ms + 500""")
def _(v):
    return va.transcript_violations(v.segments, v.words, v.durations)


@query("c02_turn_rules", """SELECT meeting_id, turn_id AS record_id, unnest(list_filter([CASE WHEN end_ms > duration_ms + 500 THEN 'outside_recording' END,
    CASE WHEN start_ms < prev THEN 'overlap' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY turn_idx) AS prev
    FROM v_tr JOIN v_dur USING (meeting_id))""")
def _(v):
    return va.turn_violations(v.regular_turns, v.durations, exclusive=True)


@query("c03_speaker_transcript_rules", """SELECT meeting_id, 0::BIGINT AS not_once, 0::BIGINT AS invented, 0::BIGINT AS inconsistent, 0::BIGINT AS reversed, 0::BIGINT AS id_gaps
    FROM v_utt GROUP BY 1""")
def _(v):
    return va.speaker_transcript_checks(v.words, attributed(v), utterances(v))


@query("c13_probability_rules", """SELECT 0::BIGINT AS meeting_id, CAST(doc_id AS VARCHAR) AS record_id, 'choice_not_maximum' AS rule FROM v_pc WHERE gold <> choice AND abs(q - 0.5) > 0.000001""")
def _(v):
    rows = predictions(v).withColumn("choice", F.col("gold")).withColumn("meeting_id", F.lit(0).cast("bigint"))
    return va.probability_violations(rows, F.col("doc_id").cast("string"))


@query("c16_reliability_rules", "SELECT meeting_id, utterance_id AS record_id, 'unknown_status' AS rule FROM v_ur WHERE status = 'MIXED' AND agreement_fraction < 0.8")
def _(v):
    rows = utterance_reliability(v).withColumn(
        "status", F.when((F.col("status") == "MIXED") & (F.col("agreement_fraction") < 0.8), "LOW").otherwise(F.col("status")))
    return va.reliability_violations(rows, F.col("utterance_id"))


# --- records with planted faults; the SQL looks for them by the rules ---
def rules_sql(source: str, record: str, rules: dict[str, str]) -> str:
    """A row for each broken rule of each row."""
    return " UNION ALL ".join(f"SELECT meeting_id, {record} AS record_id, '{name}' AS rule FROM {source} WHERE {test}" for name, test in rules.items())


view("v_bseg", """SELECT meeting_id, seg_idx, CASE WHEN (meeting_id + seg_idx) % 7 = 0 THEN 'seg_x' || seg_idx ELSE segment_id END AS segment_id,
    start_ms + CASE WHEN (meeting_id + seg_idx) % 5 = 0 THEN 40000 ELSE 0 END AS start_ms, CASE WHEN (meeting_id + seg_idx) % 11 <> 0 THEN end_ms END AS end_ms FROM v_sg""")
view("v_bsegn", """SELECT *, lag(start_ms) OVER w AS before, row_number() OVER w AS n FROM v_bseg WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx)""")
view("v_bword", """SELECT w.meeting_id, w.segment_id, w.word_index, w.start_ms, w.end_ms, s.start_ms AS s, s.end_ms AS e, s.segment_id AS there, d.duration_ms FROM (
    SELECT * REPLACE (CASE WHEN (word_index + seg_idx) % 50 = 49 THEN NULL ELSE start_ms END AS start_ms,
      end_ms + CASE WHEN (word_index + seg_idx) % 60 = 59 THEN 100000000 ELSE 0 END AS end_ms) FROM v_wd) w
    LEFT JOIN v_bseg s ON s.meeting_id = w.meeting_id AND s.segment_id = w.segment_id JOIN v_dur d ON d.meeting_id = w.meeting_id""")


@query("c01_broken_transcripts", rules_sql("v_bsegn", "segment_id", {
    "misnumbered": "segment_id <> 'seg_' || lpad(CAST(n AS VARCHAR), 6, '0')", "missing_time": "end_ms IS NULL", "unordered_start": "start_ms < before",
    "negative_length": "end_ms < start_ms"}) + " UNION ALL " + rules_sql("v_bword", "segment_id || '/' || word_index", {
        "unknown_segment": "there IS NULL", "missing_time": "start_ms IS NULL", "negative_length": "end_ms < start_ms",
        "outside_segment": "start_ms < s - 500 OR end_ms > e + 500", "outside_recording": "end_ms > duration_ms + 1000"}))
def _(v):
    k = F.col("meeting_id") + F.col("seg_idx")
    segments = v.segments.select(
        "meeting_id", "seg_idx", F.when(k % 7 == 0, F.concat(F.lit("seg_x"), "seg_idx")).otherwise(F.col("segment_id")).alias("segment_id"),
        (F.col("start_ms") + F.when(k % 5 == 0, 40_000).otherwise(0)).alias("start_ms"), F.when(k % 11 != 0, F.col("end_ms")).alias("end_ms"))
    place = F.col("word_index") + F.col("seg_idx")
    words = v.words.withColumns({
        "start_ms": F.when(place % 50 != 49, F.col("start_ms")), "end_ms": F.col("end_ms") + F.when(place % 60 == 59, 100_000_000).otherwise(0)})
    return va.transcript_violations(segments, words, v.durations)


view("v_uw", """SELECT meeting_id, seg_idx, word_index, CAST(sum(f) OVER (PARTITION BY meeting_id ORDER BY seg_idx, word_index) AS BIGINT) AS utterance_no,
    CASE WHEN word_index % 40 = 39 THEN 'nobody' ELSE speaker_id END AS speaker_id, CASE WHEN word_index % 45 = 44 THEN 'seg_x' ELSE segment_id END AS segment_id,
    start_ms, end_ms + CASE WHEN word_index % 50 = 49 THEN 99999 ELSE 0 END AS end_ms FROM (
      SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker_id) OVER w IS NOT DISTINCT FROM speaker_id AND start_ms - lag(end_ms) OVER w <= 1000 THEN 0 ELSE 1 END AS f
      FROM v_atf WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx, word_index))""")
view("v_said_by", "SELECT DISTINCT meeting_id, speaker_id FROM v_u WHERE meeting_id % 5 <> 0 OR speaker_id <> 'assistant'")
view("v_short", "SELECT meeting_id, duration_ms - CASE WHEN meeting_id % 7 = 0 THEN 20000 ELSE 0 END AS duration_ms FROM v_dur")
view("v_butt", """SELECT u.*, CASE WHEN utterance_no % 6 = 0 THEN 'utt_x' || utterance_no ELSE utterance_id END AS uid, d.duration_ms, s.speaker_id AS declared FROM v_utt u
    JOIN v_short d USING (meeting_id) LEFT JOIN v_said_by s ON s.meeting_id = u.meeting_id AND s.speaker_id = u.speaker_id""")
view("v_buw", """SELECT w.*, u.speaker_id AS who, u.segments, u.start_ms AS s, u.end_ms AS e FROM v_uw w JOIN v_utt u USING (meeting_id, utterance_no)""")


@query("c03_broken_speaker_transcripts", rules_sql("v_butt", "uid", {
    "misnumbered": "uid <> 'utt_' || lpad(CAST(utterance_no AS VARCHAR), 6, '0')", "undeclared_speaker": "speaker_id IS NOT NULL AND declared IS NULL",
    "reversed": "end_ms < start_ms", "outside_recording": "end_ms > duration_ms + 1000"}) + " UNION ALL " + rules_sql("v_buw", "segment_id || '/' || word_index", {
        "other_speaker": "speaker_id IS DISTINCT FROM who", "foreign_segment": "NOT list_contains(string_split(segments, ','), segment_id)",
        "outside_utterance": "start_ms < s OR end_ms > e"}) + """
    UNION ALL SELECT DISTINCT r.meeting_id, CAST(r.start_ms AS VARCHAR), 'undeclared_speaker' FROM (SELECT *, unnest(string_split(speakers, ',')) AS who FROM v_regions) r
      WHERE (r.meeting_id, r.who) NOT IN (SELECT (meeting_id, speaker_id) FROM v_said_by)
    UNION ALL SELECT meeting_id, CAST(start_ms AS VARCHAR), 'outside_recording' FROM v_regions JOIN v_short USING (meeting_id) WHERE end_ms > duration_ms + 500
    UNION ALL SELECT meeting_id, CAST(start_ms AS VARCHAR), 'overlapping_regions' FROM (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_regions) WHERE start_ms < reach""")
def _(v):
    n, w = F.col("utterance_no"), F.col("word_index")
    said = utterances(v).withColumn("utterance_id", F.when(n % 6 == 0, F.concat(F.lit("utt_x"), n)).otherwise(F.col("utterance_id")))
    words = at.utterance_words(flagged(v)).withColumns({
        "speaker_id": F.when(w % 40 == 39, "nobody").otherwise(F.col("speaker_id")), "segment_id": F.when(w % 45 == 44, "seg_x").otherwise(F.col("segment_id")),
        "end_ms": F.col("end_ms") + F.when(w % 50 == 49, 99_999).otherwise(0)})
    known = v.utterances.filter((F.col("meeting_id") % 5 != 0) | (F.col("speaker_id") != "assistant"))
    short = v.durations.withColumn("duration_ms", F.col("duration_ms") - F.when(F.col("meeting_id") % 7 == 0, 20_000).otherwise(0))
    return va.speaker_transcript_violations(said, words, iv.overlap_regions(v.regular_turns), known, short)


@query("c02_undeclared_speakers", """SELECT meeting_id, turn_id AS record_id, 'undeclared_speaker' AS rule FROM v_tr t WHERE NOT EXISTS (
    SELECT 1 FROM v_u u WHERE u.meeting_id = t.meeting_id AND u.speaker_id = t.speaker_id AND (u.meeting_id % 5 <> 0 OR u.speaker_id <> 'assistant'))""")
def _(v):
    known = v.utterances.filter((F.col("meeting_id") % 5 != 0) | (F.col("speaker_id") != "assistant"))
    return va.turn_violations(v.regular_turns, v.durations, False, known).filter(F.col("rule") == "undeclared_speaker")


_log = """SELECT meeting_id, edit_id, action, CASE WHEN record_no % 7 = 1 THEN 'applied' ELSE status END AS status, CASE WHEN record_no % 6 = 2 OR
    (action <> 'REPLACE' AND record_no % 10 <> 3) THEN NULL ELSE replacement END AS replacement, CASE WHEN record_no % 4 = 2 THEN 'because' ELSE rejection END AS rejection,
    char_start, CASE WHEN record_no % 9 = 5 THEN char_start ELSE char_end END AS char_end, observed FROM v_log"""
view("v_blog", _log)


@query("c07_edit_log_rules", rules_sql("v_blog", "edit_id", {
    "status_of_other_action": "NOT CASE action WHEN 'REPLACE' THEN status IN ('applied', 'rejected') WHEN 'KEEP' THEN status = 'kept' ELSE status = 'uncertain' END",
    "missing_replacement": "action = 'REPLACE' AND coalesce(replacement, '') = ''", "needless_replacement": "action <> 'REPLACE' AND replacement IS NOT NULL",
    "rejected_without_reason": "status = 'rejected' AND coalesce(rejection, '') = ''", "needless_reason": "status <> 'rejected' AND rejection IS NOT NULL",
    "empty_span": "char_end <= char_start"}))
def _(v):
    n, replaces = F.col("record_no"), F.col("action") == "REPLACE"
    log = edit_log(v).withColumns({
        "status": F.when(n % 7 == 1, "applied").otherwise(F.col("status")),
        "replacement": F.when(~((n % 6 == 2) | (~replaces & (n % 10 != 3))), F.col("replacement")),
        "rejection": F.when(n % 4 == 2, "because").otherwise(F.col("rejection")),
        "char_end": F.when(n % 9 == 5, F.col("char_start")).otherwise(F.col("char_end"))})
    return va.edit_log_violations(log)


@query("c19_job_rules", """SELECT meeting_id, stage AS record_id, 'repeated_stage' AS rule FROM v_ca GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT DISTINCT meeting_id, stage, 'unknown_stage' FROM v_ca WHERE stage NOT IN ('click', 'refund', 'purchase', 'ship')
    UNION ALL SELECT meeting_id, stage, 'missing_stage' FROM (SELECT DISTINCT meeting_id FROM v_ca), (SELECT unnest(['click', 'refund', 'purchase', 'ship']) AS stage)
      WHERE (meeting_id, stage) NOT IN (SELECT (meeting_id, stage) FROM v_ca)""")
def _(v):
    return va.job_violations(v.calls, ["click", "refund", "purchase", "ship"])


@query("c17_context_pack_rules", """SELECT DISTINCT meeting_id, canonical || '@' || source_id AS record_id, 'unknown_source' AS rule FROM v_cx WHERE source_id = 'ctx_3'""")
def _(v):
    merged = tm.merge_context_terms(context_terms(v))
    sources = v.durations.select("meeting_id", F.explode(F.array(*[F.lit(f"ctx_{i}") for i in range(3)])).alias("source_id"))
    return va.context_pack_violations(merged, sources)


@query("c19_missing_artifacts", """SELECT meeting_id, array_to_string(list_sort(list_filter(['click', 'refund', 'view'], lambda k: NOT list_contains(have, k))), ',') AS missing
    FROM (SELECT meeting_id, list(DISTINCT stage) AS have FROM v_ca GROUP BY 1) WHERE len(list_filter(['click', 'refund', 'view'], lambda k: NOT list_contains(have, k))) > 0""")
def _(v):
    return va.missing_artifacts(v.calls.select("meeting_id", F.col("stage").alias("kind")), ["click", "refund", "view"]).withColumn("missing", listed("missing"))


@query("c21_response_rules", """SELECT DISTINCT meeting_id, request_id AS record_id, 'unknown_request' AS rule FROM v_ca WHERE (meeting_id, request_id) NOT IN (
    SELECT (meeting_id, request_id) FROM v_ca WHERE status_code = 200) UNION ALL SELECT meeting_id, '', 'several_models' FROM v_ca GROUP BY meeting_id HAVING count(DISTINCT stage) > 1""")
def _(v):
    calls = v.calls.withColumn("model", F.col("stage"))
    return va.response_violations(calls, calls.filter(F.col("status_code") == 200))


# --- provenance, publishing and the read path ---
def digests(v: Views):
    return sinks.fingerprint(v.utterances.withColumn("row_sha", F.sha2("text", 256)), ["meeting_id"], ["row_sha"])


_part = lambda i: f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)"
view("v_fp", f"""SELECT meeting_id, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '-' || {_part(0)} || '-' || {_part(1)} || '-' || {_part(2)} || '-' || {_part(3)}) AS digest
    FROM (SELECT meeting_id, sha256(text) AS h FROM v_u) GROUP BY 1""")


@query("a10_fingerprint", "SELECT meeting_id, rows, digest FROM v_fp")
def _(v):
    return digests(v)


view("v_leaf", """SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) - 1 AS n, sha256(CAST(to_json(
    {'end_ms': end_ms, 'speaker_id': speaker_id, 'start_ms': start_ms, 'text': text, 'utt_idx': utt_idx}) AS VARCHAR)) AS d FROM v_u""")
for _level, _below in ((1, "v_leaf"), (2, "v_node1"), (3, "v_node2"), (4, "v_node3")):
    view(f"v_node{_level}", f"SELECT meeting_id, n // 4 AS n, sha256(string_agg(d, '' ORDER BY n)) AS d FROM {_below} GROUP BY ALL")


@query("a10_record_digest", """SELECT meeting_id, rows, sha256(rows || ':' || d) AS digest FROM v_node4 JOIN (
    SELECT meeting_id, count(*) AS rows FROM v_leaf GROUP BY 1) USING (meeting_id)""")
def _(v):
    return sinks.record_digest(v.utterances, ["meeting_id"], ["utt_idx"], ["utt_idx", "speaker_id", "start_ms", "end_ms", "text"], fan=4)


@query("c12_provenance_chain", "SELECT meeting_id, 'speaker' AS stage FROM v_dur WHERE meeting_id % 13 = 0")
def _(v):
    raw = digests(v)
    broken = F.when(F.col("meeting_id") % 13 == 0, F.lit("tampered")).otherwise(F.col("digest"))
    child = raw.select("meeting_id", F.sha2("digest", 256).alias("digest"), broken.alias("parent_digest"))
    return va.broken_provenance([("raw", raw), ("speaker", child)])


@query("d22_unique_audit", """SELECT meeting_id, CASE meeting_id % 4 WHEN 0 THEN 'not_generated' WHEN 3 THEN 'unavailable' ELSE 'available' END AS state,
    CASE WHEN meeting_id % 4 IN (1, 2) THEN 'audit_0' END AS audit_id FROM v_dur""")
def _(v):
    meetings = digests(v)
    copies = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(1), F.lit(2)), (F.col("meeting_id") % 4 + 1).cast("int"))
    audits = meetings.filter(copies > 0).select("meeting_id", "digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("n")).select(
        "meeting_id", "digest", F.concat(F.lit("audit_"), "n").alias("audit_id"))
    return rv.unique_audit(meetings, audits)


_kinds = strings([a[0] for a in fixed.ARTIFACTS])


@query("d28_artifact_lookup", f"""SELECT m.meeting_id, k.kind, h.kind IS NOT NULL AS ready FROM (SELECT DISTINCT meeting_id FROM v_ca) m, (SELECT unnest({_kinds}) AS kind) k
    LEFT JOIN (SELECT DISTINCT meeting_id, {_kinds}[event_id % 16 + 1] AS kind FROM v_ca WHERE stage <> 'error') h ON h.meeting_id = m.meeting_id AND h.kind = k.kind""")
def _(v):
    allowed = v.spark.createDataFrame(fixed.ARTIFACTS, "kind string, file_name string, media_type string")
    names = F.array(*[F.lit(a[0]) for a in fixed.ARTIFACTS])
    kind = F.when(F.col("stage") != "error", F.try_element_at(names, (F.col("event_id") % 16 + 1).cast("int")))
    return rv.artifact_lookup(v.calls.select("meeting_id", kind.alias("kind")), allowed).select("meeting_id", "kind", "ready")


def review(v: Views, *categories: str):
    """The review queue, or its rows of some categories: only those are computed."""
    first = lambda ids: F.get(ids, F.lit(0))

    def lost():
        return va.items_without_evidence(v.items, v.utterances).join(v.items, ["meeting_id", "item_id"]).select(
            "meeting_id", F.col("item_id").alias("record_id"), F.col("text").alias("title"), first("evidence_ids").alias("utterance_id"))

    def unsure():
        return utterance_reliability(v).filter(F.col("status") == "UNCERTAIN").select(
            "meeting_id", F.col("utterance_id").alias("record_id"), "status", "utterance_id").withColumnRenamed("status", "title")

    def doubtful():
        from dialogue_lake.operators.audit import verification_status

        return verification_status(v.answers).filter(F.col("status").isin("REVIEW", "UNSUPPORTED")).join(v.items, ["meeting_id", "item_id"]).select(
            "meeting_id", F.col("item_id").alias("record_id"), F.col("text").alias("title"), first("evidence_ids").alias("utterance_id"))

    def missing():
        return coverage_result(v).filter(F.col("status") == "missing").join(v.events, ["meeting_id", "event_id"]).select(
            "meeting_id", F.col("event_id").alias("record_id"), F.col("text").alias("title"), "utterance_id")

    parts = {"Evidence": lost, "Speaker": unsure, "Semantic": doubtful, "Coverage": missing}
    return rv.review_queue(v.utterances, {
        name: build() if not categories or name in categories else None for name, build in parts.items()})


REVIEW = """SELECT q.*, u.start_ms FROM (
    SELECT DISTINCT meeting_id, 'Evidence' AS category, item_id AS record_id, evidence_ids[1] AS utterance_id FROM (SELECT *, unnest(evidence_ids) AS e FROM v_it)
      WHERE (meeting_id, e) NOT IN (SELECT (meeting_id, utterance_id) FROM v_u)
    UNION ALL SELECT meeting_id, 'Speaker', utterance_id, utterance_id FROM v_ur WHERE status = 'UNCERTAIN'
    UNION ALL SELECT meeting_id, 'Semantic', item_id, evidence_ids[1] FROM v_ver JOIN v_it USING (meeting_id, item_id) WHERE status IN ('REVIEW', 'UNSUPPORTED')
    UNION ALL SELECT meeting_id, 'Coverage', event_id, e.utterance_id FROM v_cov JOIN v_ev e USING (meeting_id, event_id) WHERE status = 'missing') q
    LEFT JOIN v_u u USING (meeting_id, utterance_id)"""


@query("i03_review_queue", REVIEW)
def _(v):
    return review(v).select("meeting_id", "category", "record_id", "utterance_id", "start_ms")


@query("c20_review_filter", f"SELECT meeting_id, record_id, utterance_id FROM ({REVIEW}) WHERE category = 'Semantic'")
def _(v):
    return review(v, "Semantic").select("meeting_id", "record_id", "utterance_id")


@query("d27_missing_event_lookup", "SELECT meeting_id, event_id, text FROM v_cov JOIN v_ev USING (meeting_id, event_id) WHERE status = 'missing'")
def _(v):
    return coverage_result(v).filter(F.col("status") == "missing").select("meeting_id", "event_id").join(v.events, ["meeting_id", "event_id"]).select(
        "meeting_id", "event_id", "text")


@query("i08_distinct_in_order", r"""SELECT meeting_id, utt_idx, list_reduce(list_prepend('', l), lambda a, b: CASE WHEN contains(' ' || a || ' ', ' ' || b || ' ') THEN a ELSE trim(a || ' ' || b) END) AS words
    FROM (SELECT meeting_id, utt_idx, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM v_u)""")
def _(v):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return v.utterances.select("meeting_id", "utt_idx", F.array_join(F.array_distinct(tokens), " ").alias("words"))


@query("a03_plan_chunks", """SELECT meeting_id, i AS chunk, i * 480000 AS first_frame, least(480000, frames - i * 480000) AS n_frames FROM (
    SELECT meeting_id, frames, unnest(range(0, (frames + 479999) // 480000)) AS i FROM (SELECT meeting_id, duration_ms * 16 AS frames FROM v_dur))""")
def _(v):
    return readers.plan_chunks(v.durations.select("meeting_id", (F.col("duration_ms") * 16).alias("frames")), seconds=30)


@query("a02_merge_chunks", """SELECT meeting_id, utt_idx, 'seg_' || lpad(CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms // 60000, start_ms, utt_idx) AS VARCHAR), 6, '0') AS segment_id
    FROM v_u""")
def _(v):
    rows = v.utterances.select("meeting_id", "utt_idx", F.floor(F.col("start_ms") / 60000).cast("bigint").alias("chunk"), "start_ms", F.col("utt_idx").alias("seg_no"), "text")
    chunks = rows.groupBy("meeting_id", "chunk").agg(
        F.max("text").alias("text"), F.lit("en").alias("language"), F.lit(0.9).alias("language_probability"))
    return readers.merge_chunks(rows, chunks)[0].select("meeting_id", "utt_idx", "segment_id")

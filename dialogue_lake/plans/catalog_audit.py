"""Second-pass windows, event graph and model-answer policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import audit as au
from dialogue_lake.operators import claims as cl
from dialogue_lake.operators import graph as gr
from dialogue_lake.operators import validate as va
from dialogue_lake.operators import windows as wi
from dialogue_lake.operators.lookup import spread_join
from dialogue_lake.plans.catalog_claims import candidates, edit_log, numbered_records
from dialogue_lake.plans.catalog_speech import utterance_reliability
from dialogue_lake.plans.catalog_terms import meaning_sql, norm_sql, signature_sql, tokens_sql
from dialogue_lake.plans.registry import listed, query, view
from dialogue_lake.plans.sql_views import strings
from dialogue_lake.plans.views import Views

# --- windows ---
view("v_su", """SELECT r.meeting_id, r.utt_idx, 'grnd_' || lpad(CAST(r.n AS VARCHAR), 6, '0') AS grounding_id,
    u.start_ms + 300 * r.lo AS start_ms, u.start_ms + 300 * (r.hi + 1) AS end_ms, (70 + (r.n * 37 % 31)) / 100.0::DOUBLE AS priority
    FROM (SELECT meeting_id, utt_idx, s.lo AS lo, s.hi AS hi, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, s.char_start) AS n FROM v_gr) r
    JOIN v_u u USING (meeting_id, utt_idx)""")
view("v_reg", """SELECT meeting_id, grounding_id, priority, greatest(0, start_ms - 2000) AS s, least(duration_ms, end_ms + 2000) AS e,
    row_number() OVER (PARTITION BY meeting_id ORDER BY greatest(0, start_ms - 2000), least(duration_ms, end_ms + 2000), grounding_id) AS n
    FROM v_su JOIN v_dur USING (meeting_id) WHERE least(duration_ms, end_ms + 2000) - greatest(0, start_ms - 2000) BETWEEN 1 AND 15000""")
view("v_win", """WITH RECURSIVE w AS (SELECT meeting_id, n, s AS ws, e AS we, 1 AS wno FROM v_reg WHERE n = 1
      UNION ALL SELECT meeting_id, n, CASE WHEN j THEN ws ELSE s END, CASE WHEN j THEN greatest(we, e) ELSE e END, CASE WHEN j THEN wno ELSE wno + 1 END
      FROM (SELECT r.meeting_id, r.n, r.s, r.e, w.ws, w.we, w.wno, r.s <= w.we + 500 AND greatest(r.e, w.we) - w.ws <= 15000 AS j
        FROM w JOIN v_reg r ON r.meeting_id = w.meeting_id AND r.n = w.n + 1))
    SELECT meeting_id, min(ws) AS start_ms, max(we) AS end_ms, max(priority) AS priority, string_agg(grounding_id, ',' ORDER BY n) AS ids
    FROM w JOIN v_reg USING (meeting_id, n) GROUP BY meeting_id, wno""")
view("v_wk", "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY priority DESC, start_ms, ids) AS k FROM v_win")
view("v_sel", """WITH RECURSIVE g AS (SELECT DISTINCT meeting_id, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS taken, 0::BIGINT AS used, 'none' AS reason FROM v_wk
      UNION ALL SELECT meeting_id, k, CASE WHEN why IS NULL THEN list_append(taken, {'s': start_ms, 'e': end_ms}) ELSE taken END,
        CASE WHEN why IS NULL THEN used + end_ms - start_ms ELSE used END, why FROM (SELECT w.meeting_id, w.k, w.start_ms, w.end_ms, g.taken, g.used,
          CASE WHEN len(list_filter(g.taken, lambda t: w.start_ms < t.e AND w.end_ms > t.s)) > 0 THEN 'overlapping_window'
            WHEN len(g.taken) >= 6 THEN 'call_budget' WHEN g.used + w.end_ms - w.start_ms > 60000 THEN 'audio_budget' END AS why
        FROM g JOIN v_wk w ON w.meeting_id = g.meeting_id AND w.k = g.k + 1))
    SELECT w.meeting_id, w.start_ms, w.end_ms, w.ids, g.reason, CASE WHEN g.reason IS NULL THEN 'win_' || lpad(CAST(row_number() OVER (
      PARTITION BY w.meeting_id, g.reason IS NULL ORDER BY w.k) AS VARCHAR), 6, '0') END AS window_id FROM v_wk w JOIN g USING (meeting_id, k)""")
view("v_cw", "SELECT meeting_id, window_id, start_ms, end_ms, ids FROM v_sel WHERE reason IS NULL")


def suspicious(v: Views):
    n = F.col("record_no")
    rows = numbered_records(v).join(v.utterances.select("meeting_id", "utt_idx", "start_ms"), ["meeting_id", "utt_idx"])
    return rows.select(
        "meeting_id", "utt_idx", F.format_string("grnd_%06d", n).alias("grounding_id"),
        (F.col("start_ms") + 300 * F.col("first_word")).alias("start_ms"), (F.col("start_ms") + 300 * (F.col("last_word") + 1)).alias("end_ms"),
        ((70 + (n * 37 % 31)) / 100).alias("priority"), "first_word", "last_word", "entry_id")


def all_windows(v: Views):
    return v.shared("windows", lambda: wi.build_windows(wi.padded_regions(suspicious(v), v.durations)[0]))


def selected(v: Views):
    return v.shared("selected", lambda: wi.select_windows(all_windows(v)))


def chosen(v: Views):
    return selected(v).filter(F.col("window_id").isNotNull()).select("meeting_id", "window_id", "start_ms", "end_ms", "grounding_ids")


@query("g06_build_windows", "SELECT meeting_id, start_ms, end_ms, round(priority, 6) AS priority, ids FROM v_win")
def _(v):
    return all_windows(v).select("meeting_id", "start_ms", "end_ms", F.round("priority", 6).alias("priority"), listed("grounding_ids").alias("ids"))


@query("g07_select_windows", "SELECT meeting_id, start_ms, end_ms, window_id, reason FROM v_sel")
def _(v):
    return selected(v).select("meeting_id", "start_ms", "end_ms", "window_id", "reason")


@query("h04_suspicious_order", """SELECT meeting_id, grounding_id, round(priority, 6) AS priority,
    row_number() OVER (PARTITION BY meeting_id ORDER BY priority DESC, grounding_id) AS place FROM v_su""")
def _(v):
    from dialogue_lake.operators import ordered

    rows = suspicious(v).withColumn("_down", -F.col("priority"))
    return ordered.scan(rows, ["meeting_id"], ["_down", "grounding_id"], F.floor(F.col("_down") * 1000).cast("bigint"), [ordered.numbered("place")]).select(
        "meeting_id", "grounding_id", F.round("priority", 6).alias("priority"), "place")


view("v_wt", """SELECT c.meeting_id, c.window_id, coalesce(string_agg(w.text, ' ' ORDER BY w.seg_idx, w.word_index), '') AS text FROM v_cw c
    LEFT JOIN v_wd w ON w.meeting_id = c.meeting_id AND w.start_ms + w.end_ms >= 2 * c.start_ms AND w.start_ms + w.end_ms < 2 * c.end_ms GROUP BY ALL""")


@query("d16_window_text", "SELECT meeting_id, window_id, text FROM v_wt")
def _(v):
    return wi.window_text(chosen(v), v.words)


@query("d17_windows_utterances", """SELECT c.meeting_id, c.window_id, u.utterance_id FROM v_cw c JOIN v_u u ON u.meeting_id = c.meeting_id
    AND u.start_ms < c.end_ms AND u.end_ms > c.start_ms""")
def _(v):
    return wi.windows_with_utterances(chosen(v), v.utterances)


view("v_w2", """SELECT c.meeting_id, c.window_id, w.seg_idx * 100000 + w.word_index AS word_no, w.start_ms + 50 AS start_ms, w.end_ms + 50 AS end_ms,
    coalesce(g.canonical, w.text) AS text FROM v_cw c JOIN v_wd w ON w.meeting_id = c.meeting_id
      AND w.start_ms + w.end_ms >= 2 * c.start_ms AND w.start_ms + w.end_ms < 2 * c.end_ms
    LEFT JOIN (SELECT meeting_id, utt_idx, s.lo AS lo, s.hi AS hi, s.entry_id AS entry_id FROM v_gr) r ON r.meeting_id = w.meeting_id
      AND r.utt_idx = w.seg_idx AND r.lo = w.word_index AND r.hi = w.word_index LEFT JOIN v_g g ON g.entry_id = r.entry_id""")
view("v_w2t", "SELECT meeting_id, window_id, string_agg(text, ' ' ORDER BY word_no) AS text FROM v_w2 GROUP BY ALL")
view("v_calm", f"""SELECT a.meeting_id, a.window_id, {signature_sql(meaning_sql('a.text'))} = {signature_sql(meaning_sql('b.text'))} AS calm
    FROM v_wt a JOIN v_w2t b USING (meeting_id, window_id)""")
view("v_off", """SELECT c.meeting_id, c.window_id, k.grounding_id, k.cand_id AS entry_id, s.start_ms, s.end_ms
    FROM (SELECT meeting_id, window_id, unnest(string_split(ids, ',')) AS grounding_id FROM v_cw) c
    JOIN v_cand k USING (meeting_id, grounding_id) JOIN v_su s USING (meeting_id, grounding_id)""")
view("v_w2n", f"SELECT *, {norm_sql('text')} AS nt FROM v_w2")
view("v_lnk", f"""SELECT o.meeting_id, o.window_id, o.grounding_id, o.entry_id, min(w.word_no) AS word_no FROM v_off o JOIN v_g g USING (entry_id)
    JOIN v_calm c ON c.meeting_id = o.meeting_id AND c.window_id = o.window_id AND c.calm
    JOIN v_w2n w ON w.meeting_id = o.meeting_id AND w.window_id = o.window_id AND w.nt = g.canonical
      AND w.start_ms <= o.end_ms + 750 AND w.end_ms >= o.start_ms - 750 GROUP BY ALL""")


def second_words(v: Views):
    """Second pass: words one record covers alone come back as the record's term."""
    key = ["meeting_id", "utt_idx"]
    single = suspicious(v).filter(F.col("first_word") == F.col("last_word")).join(v.glossary.select("entry_id", "canonical"), "entry_id").select(
        F.col("meeting_id"), F.col("utt_idx").alias("seg_idx"), F.col("first_word").alias("word_index"), "canonical")
    heard = v.words.join(single, ["meeting_id", "seg_idx", "word_index"], "left")
    rows = wi.range_join(
        chosen(v).select("meeting_id", "window_id", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b")), heard, ["meeting_id"],
        (F.col("_a"), F.col("_b")), (F.col("start_ms"), F.col("end_ms")),
        (F.col("_a") * 2 <= F.col("start_ms") + F.col("end_ms")) & (F.col("start_ms") + F.col("end_ms") < F.col("_b") * 2))
    return rows.select(
        "meeting_id", "window_id", (F.col("seg_idx") * 100000 + F.col("word_index")).alias("word_no"), (F.col("start_ms") + 50).alias("start_ms"),
        (F.col("end_ms") + 50).alias("end_ms"), F.coalesce("canonical", "text").alias("text"))


def second_text(v: Views):
    return v.shared("second", lambda: second_words(v)).groupBy("meeting_id", "window_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("pass2_text"))


def pass_texts(v: Views):
    first = wi.window_text(chosen(v), v.words).withColumnRenamed("text", "pass1_text")
    return v.shared("texts", lambda: first.join(second_text(v), ["meeting_id", "window_id"]))


def links(v: Views):
    def build():
        records = suspicious(v).select("meeting_id", "grounding_id", "start_ms", "end_ms")
        asked = chosen(v).select("meeting_id", "window_id", F.explode("grounding_ids").alias("grounding_id"))
        offers = asked.join(candidates(v).select("meeting_id", "grounding_id", "entry_id", "canonical"), ["meeting_id", "grounding_id"]).join(
            records, ["meeting_id", "grounding_id"])
        return wi.link_hypotheses(offers, v.shared("second", lambda: second_words(v)), pass_texts(v))

    return v.shared("links", build)


@query("d15_link_hypotheses", """SELECT l.meeting_id, l.window_id, grounding_id, entry_id, w.start_ms AS link_start_ms FROM v_lnk l
    JOIN v_w2 w USING (meeting_id, window_id, word_no)""")
def _(v):
    return links(v).drop("link_end_ms")


@query("d18_hypothesis_outcomes", """SELECT c.meeting_id, c.window_id, coalesce(o.outcomes, 'No correction applied') AS outcomes, coalesce(o.unresolved, true) AS unresolved
    FROM v_cw c LEFT JOIN (SELECT meeting_id, window_id, string_agg(grounding_id || ' ' || action || ': ' || status, ',' ORDER BY grounding_id) AS outcomes,
      bool_or(status <> 'applied') AS unresolved FROM (SELECT DISTINCT meeting_id, window_id, grounding_id FROM v_lnk) JOIN v_log USING (meeting_id, grounding_id)
      GROUP BY ALL) o USING (meeting_id, window_id)""")
def _(v):
    return wi.hypothesis_outcomes(chosen(v), links(v), edit_log(v)).withColumn("outcomes", listed("outcomes"))


@query("j15_hypothesis_status", """SELECT meeting_id, window_id, CASE WHEN stopped THEN 'skipped' WHEN failed THEN 'failed' WHEN NOT calm THEN 'conflict'
    WHEN links > 0 THEN 'candidate' ELSE 'unmatched' END AS status FROM (SELECT *, coalesce(bool_or(failed) OVER (PARTITION BY meeting_id ORDER BY window_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM (SELECT c.meeting_id, c.window_id, k.calm, c.start_ms % 7 = 0 AS failed,
        coalesce(l.n, 0) AS links FROM v_cw c JOIN v_calm k USING (meeting_id, window_id) LEFT JOIN (SELECT meeting_id, window_id, count(*) AS n FROM v_lnk GROUP BY ALL) l
        USING (meeting_id, window_id)))""")
def _(v):
    key = ["meeting_id", "window_id"]
    counted = links(v).groupBy(*key).agg(F.count(F.lit(1)).alias("links"))
    rows = pass_texts(v).join(chosen(v), key).join(counted, key, "left").select(
        *key, F.col("window_id").alias("window_no"), F.coalesce("links", F.lit(0)).alias("links"),
        (tx.protected_signature(F.col("pass1_text")) != tx.protected_signature(F.col("pass2_text"))).alias("conflict"),
        F.when(F.col("start_ms") % 7 == 0, "provider_unavailable").alias("error"))
    return wi.hypothesis_status(rows).select(*key, "status")


@query("e29_second_pass_cost", """SELECT meeting_id, coalesce(n, 0) AS calls, CAST(coalesce(ms, 0) AS BIGINT) AS audio_ms,
    round(coalesce(ms, 0) / nullif(duration_ms, 0), 6) AS heard_fraction FROM v_dur LEFT JOIN (SELECT meeting_id, count(*) AS n, sum(end_ms - start_ms) AS ms
    FROM v_cw GROUP BY 1) USING (meeting_id)""")
def _(v):
    return wi.second_pass_cost(chosen(v), v.durations)


@query("c14_window_segments", """SELECT w.meeting_id, w.window_id || '/' || w.word_no AS record_id, 'outside_window' AS rule FROM v_w2 w JOIN v_cw c USING (meeting_id, window_id)
    WHERE w.start_ms < c.start_ms - 1000 OR w.end_ms > c.end_ms + 1000""")
def _(v):
    return va.window_segment_violations(second_words(v), chosen(v))


@query("c15_second_text", f"""SELECT meeting_id, window_id FROM v_wt JOIN v_w2t b USING (meeting_id, window_id) WHERE {norm_sql('v_wt.text')} <> {norm_sql('b.text')}""")
def _(v):
    return va.text_mismatches(pass_texts(v).select("meeting_id", "window_id", F.col("pass1_text").alias("text"), F.col("pass2_text").alias("segment_text")))


@query("g09_active_utterance", "SELECT meeting_id, utterance_id FROM v_u JOIN v_dur USING (meeting_id) WHERE start_ms <= duration_ms // 2 AND duration_ms // 2 < end_ms")
def _(v):
    half = F.floor(F.col("duration_ms") / 2)
    return spread_join(v.utterances, v.durations, ["meeting_id"], F.col("utt_idx"), "inner").filter(
        (F.col("start_ms") <= half) & (half < F.col("end_ms"))).select("meeting_id", "utterance_id")


@query("g10_clip_plan", """SELECT i.meeting_id, i.item_id, i.p - 1 AS position, greatest(0, (u.start_ms - 250) * 16) AS start_frame,
    least(d.duration_ms * 16, (u.end_ms + 250) * 16) AS end_frame FROM (SELECT meeting_id, item_id, unnest(evidence_ids) AS e,
      generate_subscripts(evidence_ids, 1) AS p FROM v_it) i JOIN v_u u ON u.meeting_id = i.meeting_id AND u.utterance_id = i.e
    JOIN v_dur d ON d.meeting_id = i.meeting_id WHERE u.end_ms > u.start_ms AND u.start_ms < d.duration_ms""")
def _(v):
    return wi.clip_plan(cl.resolve_evidence(v.items, v.utterances), v.durations)


# --- events and relations ---
OUTCOME = """CASE WHEN p < 0.60 OR choice = 'NONE' THEN 'abstained' WHEN choice = 'AMBIGUOUS' OR p < 0.85 THEN 'ambiguous' ELSE 'accepted' END"""


def typed(v: Views):
    return au.typed_events(v.events)


def numbered(v: Views):
    return v.shared("numbered", lambda: gr.number_events(typed(v).filter(F.col("outcome") == "accepted")))


@query("j10_event_outcome", f"SELECT meeting_id, event_id, choice, {OUTCOME} AS outcome FROM v_ev")
def _(v):
    return typed(v).select("meeting_id", "event_id", "choice", "outcome")


@query("h06_event_candidates", """SELECT meeting_id, utterance_id, candidate_no, n > 80 AS truncated FROM (SELECT meeting_id, utterance_id,
    row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) AS candidate_no, count(*) OVER (PARTITION BY meeting_id) AS n FROM v_u WHERE trim(text) <> '')
    WHERE candidate_no <= 80""")
def _(v):
    ranked, total = au.event_candidates(v.utterances)
    return ranked.filter("within_budget").join(total, "meeting_id").select("meeting_id", "utterance_id", "candidate_no", "truncated")


_terms = f"list_filter(list_distinct({tokens_sql('text')}), lambda t: NOT list_contains({strings(fixed.CONTENT_STOP)}, t))"
view("v_acn", f"SELECT *, {_terms} AS terms FROM v_acc")
view("v_prs", """SELECT a.meeting_id, a.event_id AS src, b.event_id AS dst, a.n AS sn, b.n AS dn, a.utt_idx AS au, b.utt_idx AS bu, a.choice AS st, b.choice AS dt
    FROM v_acn a JOIN v_acn b ON b.meeting_id = a.meeting_id AND b.n - a.n BETWEEN 1 AND 12 WHERE b.start_ms - a.end_ms <= 120000
      AND (b.n = a.n + 1 OR len(list_intersect(a.terms, b.terms)) / greatest(1, len(list_distinct(list_concat(a.terms, b.terms)))) >= 0.15)""")


def pairs(v: Views):
    return v.shared("event_pairs", lambda: gr.relation_candidates(numbered(v))[0])


@query("d13_relation_candidates", """SELECT meeting_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY dn, sn) AS k FROM v_prs) WHERE k <= 100""")
def _(v):
    return pairs(v).filter("within_budget").select("meeting_id", "src", "dst")


@query("d13_relation_counts", "SELECT meeting_id, count(*) AS pairs FROM v_prs GROUP BY 1")
def _(v):
    return gr.relation_candidates(numbered(v))[1]


@query("f06_adjacent_events", """SELECT meeting_id, event_id, lag(event_id) OVER (PARTITION BY meeting_id ORDER BY n) AS previous_event, least(n - 1, 12) AS earlier FROM v_acc""")
def _(v):
    from dialogue_lake.operators import ordered

    rows = ordered.with_preceding(numbered(v), ["meeting_id"], "n", 12, F.col("event_id"), "before")
    return rows.select("meeting_id", "event_id", F.try_element_at("before", F.lit(-1)).alias("previous_event"), F.size("before").cast("bigint").alias("earlier"))


view("v_ro", f"""SELECT *, CASE WHEN choice = 'SUPERSEDES' AND (st <> 'DECISION' OR dt <> 'DECISION') THEN 'abstained' WHEN choice = 'NONE' THEN 'abstained'
    WHEN choice = 'AMBIGUOUS' OR p < 0.85 THEN 'ambiguous' ELSE 'accepted' END AS outcome FROM (SELECT *,
      {strings(fixed.RELATION_TYPES)}[(au * 5 + bu) % 11 + 1] AS choice, CASE WHEN (au + bu) % 4 < 3 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS p FROM v_prs)""")
view("v_rl", """SELECT meeting_id, src, dst, choice AS relation_type, sn, dn FROM v_ro WHERE outcome = 'accepted'
    UNION ALL SELECT meeting_id, max_by(event_id, n), min_by(event_id, n), 'CLARIFIES', max(n), min(n) FROM v_acc WHERE meeting_id % 9 = 0 GROUP BY 1 HAVING count(*) > 1""")


def relation_answers(v: Views):
    at = lambda name, side: numbered(v).select(
        "meeting_id", F.col("event_id").alias(name), F.col("utt_idx").alias(f"{side}u"), F.col("choice").alias(f"{side}t"), F.col("evidence_ids").alias(f"{side}e"))
    rows = pairs(v).join(at("src", "s"), ["meeting_id", "src"]).join(at("dst", "d"), ["meeting_id", "dst"])
    labels = F.array(*[F.lit(t) for t in fixed.RELATION_TYPES])
    rows = rows.withColumn("choice", F.element_at(labels, ((F.col("su") * 5 + F.col("du")) % 11 + 1).cast("int"))).withColumn(
        "p", F.when((F.col("su") + F.col("du")) % 4 < 3, 0.9).otherwise(0.7))
    return rows.withColumn("outcome", au.relation_outcome(F.col("choice"), F.col("p"), F.col("st"), F.col("dt")))


def relations(v: Views):
    """Accepted relations; some meetings also have one that points back in time."""
    def build():
        kept = relation_answers(v).filter(F.col("outcome") == "accepted").select(
            "meeting_id", "src", "dst", F.col("choice").alias("relation_type"), F.array_union("se", "de").alias("evidence_ids"))
        back = numbered(v).filter(F.col("meeting_id") % 9 == 0).groupBy("meeting_id").agg(
            F.max_by("event_id", "n").alias("src"), F.min_by("event_id", "n").alias("dst"), F.count(F.lit(1)).alias("_n"),
            F.max_by("evidence_ids", "n").alias("_a")).filter(F.col("_n") > 1).select(
            "meeting_id", "src", "dst", F.lit("CLARIFIES").alias("relation_type"), F.col("_a").alias("evidence_ids"))
        return kept.unionByName(back)

    return v.shared("relations", build)


@query("j11_relation_outcome", "SELECT meeting_id, src, dst, choice, outcome FROM v_ro")
def _(v):
    return relation_answers(v).select("meeting_id", "src", "dst", "choice", "outcome")


view("v_und", """SELECT meeting_id, src AS x, dst AS y FROM v_rl UNION SELECT meeting_id, dst, src FROM v_rl
    UNION SELECT a.meeting_id, a.event_id, b.event_id FROM v_acn a JOIN v_acn b ON b.meeting_id = a.meeting_id AND abs(b.n - a.n) BETWEEN 1 AND 12
      WHERE CASE WHEN b.n > a.n THEN b.start_ms - a.end_ms ELSE a.start_ms - b.end_ms END <= 120000 AND len(list_intersect(a.terms, b.terms)) >= 2""")
view("v_comp", """SELECT meeting_id, x AS event_id, min(y) AS root FROM (WITH RECURSIVE r AS (SELECT meeting_id, event_id AS x, event_id AS y FROM v_acc
      UNION SELECT r.meeting_id, r.x, u.y FROM r JOIN v_und u ON u.meeting_id = r.meeting_id AND u.x = r.y) SELECT * FROM r) GROUP BY ALL""")
view("v_thr", """SELECT c.meeting_id, c.event_id, a.n, 'issue_' || lpad(CAST(dense_rank() OVER (PARTITION BY c.meeting_id ORDER BY f.fn) AS VARCHAR), 4, '0') AS issue_id,
    f.title, f.events FROM v_comp c JOIN v_acc a USING (meeting_id, event_id) JOIN (SELECT c.meeting_id, c.root, min(a.n) AS fn, count(*) AS events,
      arg_min(substr(a.text, 1, 120), a.n) AS title FROM v_comp c JOIN v_acc a USING (meeting_id, event_id) GROUP BY ALL) f
    ON f.meeting_id = c.meeting_id AND f.root = c.root""")


def threads(v: Views):
    return v.shared("threads", lambda: gr.issue_threads(numbered(v), relations(v)))


@query("k01_issue_threads", "SELECT meeting_id, issue_id, event_id, title, events FROM v_thr")
def _(v):
    return threads(v).drop("n")


@query("k02_cycles", """WITH reach AS (WITH RECURSIVE r AS (SELECT meeting_id, sn AS x, dn AS y FROM v_rl UNION SELECT r.meeting_id, r.x, e.dn FROM r
      JOIN v_rl e ON e.meeting_id = r.meeting_id AND e.sn = r.y) SELECT * FROM r),
    m AS (SELECT a.meeting_id, a.x, a.y FROM reach a JOIN reach b ON b.meeting_id = a.meeting_id AND b.x = a.y AND b.y = a.x WHERE a.x <> a.y)
    SELECT m.meeting_id, e.event_id, least(m.x, min(m.y)) AS cycle_n, count(*) + 1 AS size FROM m JOIN v_acc e ON e.meeting_id = m.meeting_id AND e.n = m.x
    GROUP BY m.meeting_id, e.event_id, m.x""")
def _(v):
    return gr.cycles(numbered(v), relations(v)).drop("n")


view("v_evo", """SELECT t.*, a.choice AS event_type, CASE WHEN (t.meeting_id, t.event_id) IN (SELECT (meeting_id, src) FROM v_rl WHERE relation_type = 'SUPERSEDES') THEN 'historical'
    WHEN a.choice = 'DECISION' THEN 'current_decision' WHEN a.choice IN ('TASK_ASSIGNMENT', 'COMMITMENT') THEN 'task'
    WHEN a.choice = 'PROPOSAL' AND (t.meeting_id, t.event_id) NOT IN (SELECT (meeting_id, src) FROM v_rl WHERE relation_type IN ('ACCEPTS', 'REJECTS'))
      THEN 'unresolved_proposal' ELSE 'context' END AS state FROM v_thr t JOIN v_acc a USING (meeting_id, event_id)""")


def evolution(v: Views):
    return v.shared("evolution", lambda: gr.decision_evolution(threads(v), typed(v), relations(v)))


@query("k03_decision_evolution", "SELECT meeting_id, issue_id, event_id, event_type, state FROM v_evo")
def _(v):
    return evolution(v).select("meeting_id", "issue_id", "event_id", "event_type", "state")


@query("k04_thread_view", "SELECT meeting_id, issue_id, event_id, state FROM v_evo WHERE events > 1")
def _(v):
    return gr.thread_view(evolution(v)).select("meeting_id", "issue_id", "event_id", "state")


@query("c10_graph_rules", """SELECT meeting_id, src || '>' || dst AS record_id, 'lost_evidence' AS rule FROM v_rl WHERE sn > dn""")
def _(v):
    rows = typed(v).withColumn("accepted", F.col("outcome") == "accepted")
    return va.graph_violations(rows, relations(v))


@query("c11_source_mismatches", "SELECT meeting_id, event_id FROM v_ev WHERE choice = 'BLOCKER' AND text <> upper(text)")
def _(v):
    saved = typed(v).select("meeting_id", "event_id", "utterance_id", "speaker_id", "start_ms",
                            F.when(F.col("choice") == "BLOCKER", F.upper("text")).otherwise(F.col("text")).alias("text"))
    return va.source_mismatches(saved, v.utterances, ["meeting_id", "utterance_id"], ["speaker_id", "start_ms", "text"]).select("meeting_id", "event_id")


# --- verification and coverage ---
@query("j12_verification_questions", """SELECT meeting_id, item_id, row_number() OVER (PARTITION BY meeting_id, item_id ORDER BY k) AS question_no, question_id FROM v_it,
    (VALUES (1, 'claim_supported'), (2, 'item_type_supported'), (3, 'negation_preserved'), (4, 'numbers_preserved'), (5, 'scope_preserved'),
      (6, 'owner_explicit'), (7, 'deadline_explicit')) AS q(k, question_id) WHERE section IN ('decisions', 'action_items')
      AND (k < 6 OR (section = 'action_items' AND ((k = 6 AND owner_speaker IS NOT NULL) OR (k = 7 AND deadline_text IS NOT NULL))))""")
def _(v):
    return au.verification_questions(v.items)


view("v_ver", """SELECT meeting_id, item_id, CASE WHEN bool_or(choice = 'NO' AND p >= 0.85) THEN 'UNSUPPORTED'
    WHEN bool_and(choice = 'YES' AND p >= 0.85) THEN 'SUPPORTED' ELSE 'REVIEW' END AS status FROM v_vq GROUP BY ALL""")


@query("j13_verification_status", "SELECT meeting_id, item_id, status FROM v_ver")
def _(v):
    return au.verification_status(v.answers)


_it_terms = _terms.replace("text", "i.text")
_ev_terms = _terms.replace("text", "e.text")
view("v_cc0", f"""SELECT e.meeting_id, e.event_id, e.choice AS event_type, i.item_id, list_contains(i.evidence_ids, e.utterance_id) AS shared,
    {_ev_terms} AS a, {_it_terms} AS b, NOT CASE WHEN e.choice = 'DECISION' THEN i.section = 'decisions'
      WHEN e.choice IN ('COMMITMENT', 'TASK_ASSIGNMENT') THEN i.section = 'action_items'
      ELSE i.section = 'summary' OR (i.section = 'minutes' AND i.kind = 'concern') END AS wrong_type
    FROM v_acc e JOIN v_it i USING (meeting_id) WHERE e.choice IN ('DECISION', 'TASK_ASSIGNMENT', 'COMMITMENT', 'BLOCKER')""")
view("v_cc", """SELECT *, row_number() OVER (PARTITION BY meeting_id, event_id ORDER BY wrong_type, NOT shared, similarity DESC, item_id) AS rank FROM (
    SELECT *, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS similarity FROM v_cc0) WHERE shared OR similarity >= 0.2""")


def coverage(v: Views):
    best, counts = au.coverage_candidates(typed(v), v.items)
    return v.shared("coverage", lambda: best), v.shared("coverage_counts", lambda: counts)


@query("d14_coverage_candidates", """SELECT meeting_id, event_id, item_id, rank, wrong_type, shared, round(similarity, 6) AS similarity FROM v_cc WHERE rank <= 3""")
def _(v):
    return coverage(v)[0].drop("event_type").withColumn("similarity", F.round("similarity", 6))


view("v_cj", """SELECT *, CASE WHEN k < 7 THEN 'YES' WHEN k = 7 THEN 'NO' WHEN k = 8 THEN 'AMBIGUOUS' END AS choice2,
    CASE WHEN k < 5 THEN 0.95 WHEN k < 9 THEN 0.70 END AS p FROM (SELECT *, (length(item_id || event_id) + rank * 3 + meeting_id) % 10 AS k FROM v_cc WHERE rank <= 3)""")
view("v_cov", """SELECT e.meeting_id, e.event_id, e.choice AS event_type, coalesce(j.matched, '') AS matched,
    CASE WHEN coalesce(j.nm, 0) > 0 THEN 'covered' WHEN coalesce(j.silent, false) THEN 'unavailable'
      WHEN coalesce(j.unsure, false) OR coalesce(c.n, 0) > 3 THEN 'ambiguous' ELSE 'missing' END AS status
    FROM v_acc e LEFT JOIN (SELECT meeting_id, event_id, count(*) AS n FROM v_cc GROUP BY ALL) c USING (meeting_id, event_id)
    LEFT JOIN (SELECT meeting_id, event_id, count(*) FILTER (WHERE choice2 = 'YES' AND p >= 0.85 AND NOT wrong_type) AS nm,
        string_agg(item_id, ',' ORDER BY item_id) FILTER (WHERE choice2 = 'YES' AND p >= 0.85 AND NOT wrong_type) AS matched,
        bool_or(choice2 IS NULL) AS silent, bool_or(coalesce(choice2 = 'AMBIGUOUS' OR p < 0.85 OR (choice2 = 'YES' AND wrong_type), false)) AS unsure
      FROM v_cj GROUP BY ALL) j USING (meeting_id, event_id) WHERE e.choice IN ('DECISION', 'TASK_ASSIGNMENT', 'COMMITMENT', 'BLOCKER')""")


def coverage_result(v: Views):
    best, counts = coverage(v)
    k = (F.length(F.concat("item_id", "event_id")) + F.col("rank") * 3 + F.col("meeting_id")) % 10
    judged = best.withColumn("choice", F.when(k < 7, "YES").when(k == 7, "NO").when(k == 8, "AMBIGUOUS")).withColumn(
        "p", F.when(k < 5, 0.95).when(k < 9, 0.70))
    return au.coverage_status(typed(v), judged, counts)


@query("j14_coverage_status", "SELECT meeting_id, event_id, event_type, matched, status FROM v_cov")
def _(v):
    return coverage_result(v).select("meeting_id", "event_id", "event_type", listed("matched").alias("matched"), "status")


@query("f08_budget_rank", """SELECT meeting_id, purpose, event_id, call_no FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY event_id) AS call_no FROM (
    SELECT *, row_number() OVER (PARTITION BY meeting_id, purpose ORDER BY event_id) AS k FROM (SELECT meeting_id, event_id,
      CASE stage WHEN 'error' THEN 'coverage' WHEN 'click' THEN 'events' WHEN 'view' THEN 'relations' ELSE 'verification' END AS purpose FROM v_ca))
    WHERE k <= CASE purpose WHEN 'events' THEN 80 WHEN 'relations' THEN 100 WHEN 'verification' THEN 50 ELSE 70 END) WHERE call_no <= 250""")
def _(v):
    purpose = F.when(F.col("stage") == "error", "coverage").when(F.col("stage") == "click", "events").when(F.col("stage") == "view", "relations").otherwise("verification")
    return au.budget_rank(v.calls.select("meeting_id", "event_id", purpose.alias("purpose"), F.col("event_id").alias("request_no"))).filter("within_budget").select(
        "meeting_id", "purpose", "event_id", "call_no")


@query("f09_request_dedup", "SELECT min(event_id) AS first_event, count(*) AS uses FROM v_ca GROUP BY meeting_id, stage, latency_ms // 5000")
def _(v):
    rows = v.calls.select("event_id", "meeting_id", "stage", F.floor(F.col("latency_ms") / 5000).alias("bin"))
    return au.request_dedup(rows, ["meeting_id", "stage", "bin"], "event_id")[1].select(F.col("event_id").alias("first_event"), "uses")


@query("d29_event_reliability", """SELECT e.meeting_id, e.event_id, u.status, round(u.agreement_fraction, 6) AS agreement_fraction FROM v_ev e
    LEFT JOIN v_ur u USING (meeting_id, utterance_id)""")
def _(v):
    return au.attach_reliability(v.events, utterance_reliability(v)).select(
        "meeting_id", "event_id", "status", F.round("agreement_fraction", 6).alias("agreement_fraction"))


@query("e30_audit_availability", """SELECT meeting_id, CASE WHEN n > 0 THEN 'partial' ELSE 'available' END AS availability,
    CASE WHEN n > 0 THEN 'relation_candidates_truncated' ELSE '' END AS warnings FROM (SELECT d.meeting_id, coalesce(p.n, 0) AS n FROM v_dur d
    LEFT JOIN (SELECT meeting_id, count(*) AS n FROM v_prs GROUP BY 1 HAVING count(*) > 12) p USING (meeting_id))""")
def _(v):
    counts = gr.relation_candidates(numbered(v))[1].filter(F.col("pairs") > 12)
    return au.audit_availability(typed(v), counts.select("meeting_id", F.lit("relation_candidates_truncated").alias("warning"))).withColumn(
        "warnings", listed("warnings"))

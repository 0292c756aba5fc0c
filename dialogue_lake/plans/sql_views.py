"""The same record tables as :mod:`views`, as common table expressions for DuckDB."""

from __future__ import annotations

import re

from dialogue_lake.functions import fixed_values as fixed


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {
    "v_u0": r"""SELECT conv_id AS meeting_id, turn AS utt_idx, role AS speaker_id, text,
        CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM conversations""",
    "v_u": """SELECT meeting_id, utt_idx, 'utt_' || lpad(CAST(utt_idx + 1 AS VARCHAR), 6, '0') AS utterance_id,
        speaker_id, text, n_words,
        CAST(300 * (sum(n_words) OVER w - n_words) AS BIGINT) AS start_ms,
        CAST(300 * sum(n_words) OVER w AS BIGINT) AS end_ms
        FROM v_u0 WINDOW w AS (PARTITION BY meeting_id ORDER BY utt_idx)""",
    "v_dur": "SELECT meeting_id, max(end_ms) AS duration_ms FROM v_u GROUP BY 1",
    "v_wd": r"""SELECT meeting_id, 'seg_' || lpad(CAST(utt_idx + 1 AS VARCHAR), 6, '0') AS segment_id,
        utt_idx AS seg_idx, CAST(i - 1 AS BIGINT) AS word_index, start_ms + 300 * (i - 1) AS start_ms,
        start_ms + 300 * (i - 1) + CASE WHEN (i - 1) % 37 = 0 THEN 0 ELSE 300 END AS end_ms, w AS text
        FROM (SELECT *, unnest(l) AS w, generate_subscripts(l, 1) AS i
              FROM (SELECT *, regexp_extract_all(text, '\S+') AS l FROM v_u))""",
    "v_sg": """SELECT meeting_id, 'seg_' || lpad(CAST(utt_idx + 1 AS VARCHAR), 6, '0') AS segment_id,
        utt_idx AS seg_idx, start_ms + 100 * (utt_idx % 3) AS start_ms, end_ms + 150 * (utt_idx % 2) AS end_ms,
        text FROM v_u""",
    "v_tx": """SELECT * FROM (SELECT meeting_id, 'turn_' || lpad(CAST(utt_idx + 1 AS VARCHAR), 6, '0') AS turn_id,
        utt_idx AS turn_idx, speaker_id,
        start_ms + CASE WHEN utt_idx % 3 = 2 THEN 460 ELSE 40 * (utt_idx % 3) END AS start_ms,
        end_ms - CASE WHEN utt_idx % 2 = 1 THEN 450 ELSE 0 END AS end_ms
        FROM v_u WHERE speaker_id <> 'system') WHERE end_ms > start_ms""",
    "v_tr": """SELECT meeting_id, turn_id, turn_idx, speaker_id, start_ms,
        end_ms + CASE WHEN turn_idx % 4 = 1 THEN 1500 ELSE 0 END AS end_ms FROM v_tx""",
    "v_ts": """SELECT * FROM (SELECT meeting_id, utt_idx AS turn_idx,
        CASE WHEN speaker_id = 'system' OR (speaker_id = 'assistant' AND meeting_id % 7 = 0) THEN 'S_user'
             ELSE 'S_' || speaker_id END AS speaker_id,
        start_ms + 150 * (utt_idx % 4) AS start_ms, end_ms + 200 * (utt_idx % 3) AS end_ms
        FROM v_u) WHERE end_ms > start_ms""",
    "v_tt": "SELECT meeting_id, 'T_' || speaker_id AS speaker_id, start_ms, end_ms FROM v_u WHERE end_ms > start_ms",
    "v_layers": """SELECT meeting_id, 'regular' AS layer, speaker_id, start_ms, end_ms FROM v_tr
        UNION ALL SELECT meeting_id, 'exclusive', speaker_id, start_ms, end_ms FROM v_tx
        UNION ALL SELECT meeting_id, 'secondary', speaker_id, start_ms, end_ms FROM v_ts""",
    "v_g": """SELECT 'term.' || token AS entry_id, token AS canonical,
        CASE length(token) % 3 WHEN 0 THEN 'meeting' WHEN 1 THEN 'project' ELSE 'global' END AS scope,
        CAST(length(token) % 10 AS DOUBLE) / 10 AS priority, token[1:2] || token[4:] AS asr_alias,
        CASE WHEN length(token) % 2 = 0 THEN 'technology' ELSE 'organization' END AS category,
        CAST(length(token) * 37 + ascii(token) * 101 AS BIGINT) AS vector_no
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS token FROM benchmark)""",
    "v_var": """SELECT entry_id, canonical, scope, priority, category, vector_no, 'canonical_exact' AS kind,
        canonical AS variant FROM v_g
        UNION ALL SELECT entry_id, canonical, scope, priority, category, vector_no, 'asr_alias_exact', asr_alias FROM v_g""",
    "v_it": r"""SELECT meeting_id, utt_idx, 'item_' || lpad(CAST(utt_idx AS VARCHAR), 6, '0') AS item_id,
        ['summary', 'minutes', 'decisions', 'action_items'][utt_idx % 4 + 1] AS section, text,
        CASE WHEN utt_idx % 3 = 0 THEN 'user' END AS owner_speaker,
        CASE WHEN utt_idx % 5 = 2 THEN lower(regexp_extract_all(text, '\S+')[1]) END AS deadline_text,
        ['concern', 'fact', 'question'][utt_idx % 3 + 1] AS kind,
        'topic_' || ((meeting_id + utt_idx) % 3) AS topic,
        ['utt_' || lpad(CAST(utt_idx AS VARCHAR), 6, '0'),
         'utt_' || lpad(CAST(CASE WHEN (meeting_id * 31 + utt_idx * 7) % 50 = 0 THEN utt_idx + 901 ELSE utt_idx + 1 END
           AS VARCHAR), 6, '0')] AS evidence_ids
        FROM v_u WHERE speaker_id = 'assistant'""",
    "v_ev": f"""SELECT meeting_id, utt_idx, 'evt_' || lpad(CAST(utt_idx + 1 AS VARCHAR), 6, '0') AS event_id,
        utterance_id, speaker_id, text, start_ms, end_ms,
        {strings(fixed.EVENT_TYPES)}[(meeting_id * 7 + utt_idx * 3) % 14 + 1] AS choice,
        CASE WHEN (meeting_id * 31 + utt_idx * 17) % 10 < 7 THEN 0.95::DOUBLE
             WHEN (meeting_id * 31 + utt_idx * 17) % 10 < 9 THEN 0.70::DOUBLE ELSE 0.40::DOUBLE END AS p
        FROM v_u""",
    "v_acc": """SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, event_id) AS n FROM v_ev
        WHERE choice NOT IN ('NONE', 'AMBIGUOUS') AND p >= 0.85""",
    "v_ca": """SELECT user_id AS meeting_id, event_id, event_type AS stage,
        CAST(round(value * 1000) AS BIGINT) AS latency_ms,
        CASE WHEN event_id % 17 = 0 THEN 429 ELSE 200 END AS status_code, event_id % 17 = 0 AS retry,
        CASE WHEN event_id % 23 <> 0 THEN event_id % 500 END AS tokens,
        'req_' || (event_id % 97) AS request_id, ts FROM events""",
    "v_vq": """SELECT meeting_id, item_id, section, question_id, q,
        CASE WHEN (meeting_id + utt_idx) % 2 = 0 THEN 'YES'
             ELSE ['YES', 'YES', 'NO', 'AMBIGUOUS'][(meeting_id * 3 + utt_idx + q) % 4 + 1] END AS choice,
        CASE WHEN (meeting_id * 31 + utt_idx * 17 + q) % 10 < 8 THEN 0.95::DOUBLE
             WHEN (meeting_id * 31 + utt_idx * 17 + q) % 10 < 9 THEN 0.70::DOUBLE ELSE 0.40::DOUBLE END AS p,
        ['YES', 'NO', 'AMBIGUOUS'][(meeting_id + utt_idx * 2 + q) % 3 + 1] AS gold
        FROM v_it, (VALUES (0::BIGINT, 'claim_supported'), (1, 'item_type_supported'), (2, 'negation_preserved'),
                    (3, 'numbers_preserved'), (4, 'scope_preserved')) AS questions(q, question_id)""",
    # --- words against turns, one method after another ---
    "v_pairs": """SELECT w.meeting_id, w.segment_id, w.word_index, w.start_ms AS ws, w.end_ms AS we,
        t.turn_id, t.speaker_id, t.start_ms AS ts, t.end_ms AS te FROM v_wd w JOIN v_tx t USING (meeting_id)""",
    "v_direct": """SELECT meeting_id, segment_id, word_index, speaker_id, min(ts) AS at0,
        string_agg(turn_id, ',' ORDER BY ts) AS turns,
        sum(CASE WHEN we = ws THEN 1 ELSE least(we, te) - greatest(ws, ts) END) AS ov
        FROM v_pairs WHERE CASE WHEN we = ws THEN ts <= ws AND ws < te ELSE ts < we AND te > ws END
        GROUP BY ALL""",
    "v_direct1": """SELECT * FROM v_direct QUALIFY row_number() OVER (
        PARTITION BY meeting_id, segment_id, word_index ORDER BY ov DESC, at0, speaker_id) = 1""",
    "v_padded0": """SELECT meeting_id, segment_id, word_index, speaker_id, min(ts) AS at0,
        string_agg(turn_id, ',' ORDER BY ts) AS turns, sum(least(we + 100, te) - greatest(ws - 100, ts)) AS ov
        FROM v_pairs p WHERE ts < we + 100 AND te > ws - 100 AND NOT EXISTS (SELECT 1 FROM v_direct1 d
          WHERE d.meeting_id = p.meeting_id AND d.segment_id = p.segment_id AND d.word_index = p.word_index)
        GROUP BY ALL""",
    "v_padded": """SELECT * FROM v_padded0 QUALIFY row_number() OVER (
        PARTITION BY meeting_id, segment_id, word_index ORDER BY ov DESC, at0, speaker_id) = 1""",
    "v_nearest": """SELECT * FROM (SELECT meeting_id, segment_id, word_index, speaker_id, turn_id AS turns,
          greatest(ts - we, ws - te, 0) AS gap, ts FROM v_pairs) n
        WHERE NOT EXISTS (SELECT 1 FROM v_direct1 d WHERE d.meeting_id = n.meeting_id
            AND d.segment_id = n.segment_id AND d.word_index = n.word_index)
          AND NOT EXISTS (SELECT 1 FROM v_padded d WHERE d.meeting_id = n.meeting_id
            AND d.segment_id = n.segment_id AND d.word_index = n.word_index)
        QUALIFY row_number() OVER (PARTITION BY meeting_id, segment_id, word_index ORDER BY gap, ts, speaker_id) = 1
          AND gap <= 200""",
    "v_at": """SELECT w.*, coalesce(d.speaker_id, p.speaker_id, n.speaker_id) AS speaker_id,
        CASE WHEN d.speaker_id IS NOT NULL THEN 'overlap' WHEN p.speaker_id IS NOT NULL THEN 'tolerance'
             WHEN n.speaker_id IS NOT NULL THEN 'nearest' ELSE 'unknown' END AS method,
        coalesce(d.turns, p.turns, n.turns, '') AS turns,
        CASE WHEN w.end_ms > w.start_ms THEN CASE WHEN d.ov IS NULL THEN 0.0::DOUBLE
            ELSE round(least(1.0::DOUBLE, d.ov / (w.end_ms - w.start_ms)), 6) END
          END AS overlap_fraction
        FROM v_wd w LEFT JOIN v_direct1 d USING (meeting_id, segment_id, word_index)
        LEFT JOIN v_padded p USING (meeting_id, segment_id, word_index)
        LEFT JOIN v_nearest n USING (meeting_id, segment_id, word_index)""",
    # --- overlap regions ---
    "v_pts": "SELECT meeting_id, start_ms AS t FROM v_tr UNION SELECT meeting_id, end_ms FROM v_tr",
    "v_cells": """SELECT * FROM (SELECT meeting_id, t AS s, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS e
        FROM v_pts) WHERE e IS NOT NULL""",
    "v_active": """SELECT c.meeting_id, s, e, string_agg(DISTINCT speaker_id, ',' ORDER BY speaker_id) AS speakers
        FROM v_cells c JOIN v_tr t ON t.meeting_id = c.meeting_id AND t.start_ms < e AND t.end_ms > s
        GROUP BY ALL HAVING count(DISTINCT speaker_id) >= 2""",
    "v_regions": """SELECT meeting_id, min(s) AS start_ms, max(e) AS end_ms, speakers FROM (
          SELECT *, sum(f) OVER (PARTITION BY meeting_id ORDER BY s) AS g FROM (
            SELECT *, CASE WHEN lag(e) OVER w = s AND lag(speakers) OVER w = speakers THEN 0 ELSE 1 END AS f
            FROM v_active WINDOW w AS (PARTITION BY meeting_id ORDER BY s)))
        GROUP BY meeting_id, g, speakers""",
    "v_atf": """SELECT a.*, EXISTS (SELECT 1 FROM v_regions r WHERE r.meeting_id = a.meeting_id
          AND CASE WHEN a.start_ms = a.end_ms THEN r.start_ms <= a.start_ms AND a.start_ms < r.end_ms
                   ELSE r.start_ms < a.end_ms AND r.end_ms > a.start_ms END) AS overlap_present FROM v_at a""",
    "v_utt": """SELECT meeting_id, g AS utterance_no,
          'utt_' || lpad(CAST(g AS VARCHAR), 6, '0') AS utterance_id, any_value(speaker_id) AS speaker_id,
          arg_min(start_ms, (seg_idx, word_index)) AS start_ms, max(end_ms) AS end_ms,
          string_agg(text, ' ' ORDER BY seg_idx, word_index) AS text,
          array_to_string(list_distinct(list(segment_id)).list_sort(), ',') AS segments,
          bool_or(overlap_present) AS overlap_present
        FROM (SELECT *, CAST(sum(f) OVER (PARTITION BY meeting_id ORDER BY seg_idx, word_index) AS BIGINT) AS g FROM (
            SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker_id) OVER w IS NOT DISTINCT FROM speaker_id
                AND start_ms - lag(end_ms) OVER w <= 1000 THEN 0 ELSE 1 END AS f
            FROM v_atf WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx, word_index)))
        GROUP BY meeting_id, g""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a statement needs in front of it, each after those it uses."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", sql):
            if name in known and name not in needed:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + "\n" + body

"""Attribution, timeline and agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogue_lake.operators import agreement as ag
from dialogue_lake.operators import attribution as at
from dialogue_lake.operators import intervals as iv
from dialogue_lake.operators import ordered
from dialogue_lake.plans.registry import listed, query, view
from dialogue_lake.plans.views import Views

FRACTION_COLUMNS = [f"{n}_fraction" for n in ag.FRACTIONS]


def attributed(v: Views):
    return v.shared("attributed", lambda: at.attribute_words(v.words, v.exclusive_turns))


def flagged(v: Views):
    return v.shared("flagged", lambda: at.flag_overlap(
        attributed(v), iv.overlap_regions(v.regular_turns), ["segment_id", "word_index"]))


def utterances(v: Views):
    return v.shared("utterances", lambda: at.assemble_utterances(flagged(v)))


def labels(v: Views):
    side = lambda df, name: df.select("meeting_id", F.lit(name).alias("side"), "speaker_id")
    return side(v.regular_turns, "primary").unionByName(side(v.secondary_turns, "secondary")).distinct()


def cells(v: Views):
    return v.shared("cells", lambda: ag.timeline(v.layered_turns, v.durations))


def mapping(v: Views):
    return v.shared("mapping", lambda: ag.assign_speakers(ag.overlap_matrix(cells(v)), labels(v)))


def intervals(v: Views):
    return v.shared("intervals", lambda: ag.compare_intervals(cells(v), mapping(v)))


@query("d01_attribute_words", """SELECT meeting_id, segment_id, word_index, speaker_id, method, overlap_fraction,
    turns AS source_turns FROM v_at""")
def _(v):
    return attributed(v).select(
        "meeting_id", "segment_id", "word_index", "speaker_id", "method",
        F.round("overlap_fraction", 6).alias("overlap_fraction"), listed("source_turn_ids").alias("source_turns"))


@query("d02_tolerance_words", """SELECT meeting_id, segment_id, word_index, speaker_id, overlap_fraction FROM v_at
    WHERE method = 'tolerance'""")
def _(v):
    return attributed(v).filter(F.col("method") == "tolerance").select(
        "meeting_id", "segment_id", "word_index", "speaker_id", F.round("overlap_fraction", 6).alias("overlap_fraction"))


@query("d03_nearest_words", """SELECT meeting_id, segment_id, word_index, speaker_id, turns AS source_turns FROM v_at
    WHERE method = 'nearest'""")
def _(v):
    return attributed(v).filter(F.col("method") == "nearest").select(
        "meeting_id", "segment_id", "word_index", "speaker_id", listed("source_turn_ids").alias("source_turns"))


@query("d04_point_words", """SELECT meeting_id, segment_id, word_index, speaker_id, method, overlap_fraction FROM v_at
    WHERE start_ms = end_ms""")
def _(v):
    return attributed(v).filter(F.col("start_ms") == F.col("end_ms")).select(
        "meeting_id", "segment_id", "word_index", "speaker_id", "method", "overlap_fraction")


view("v_bare", """SELECT meeting_id, segment_id, seg_idx, start_ms, end_ms, text FROM v_sg
    WHERE text IN (SELECT text FROM v_sg WHERE seg_idx = 0)""")
view("v_bare_attr0", """SELECT b.meeting_id, b.segment_id, t.speaker_id, sum(least(b.end_ms, t.end_ms)
      - greatest(b.start_ms, t.start_ms)) AS ov, min(t.start_ms) AS at0
    FROM v_bare b JOIN v_tx t ON t.meeting_id = b.meeting_id AND t.start_ms < b.end_ms AND t.end_ms > b.start_ms
    GROUP BY ALL""")
view("v_bare_pad0", """SELECT b.meeting_id, b.segment_id, t.speaker_id,
      sum(least(b.end_ms + 100, t.end_ms) - greatest(b.start_ms - 100, t.start_ms)) AS ov, min(t.start_ms) AS at0
    FROM v_bare b JOIN v_tx t ON t.meeting_id = b.meeting_id AND t.start_ms < b.end_ms + 100
      AND t.end_ms > b.start_ms - 100
    GROUP BY ALL""")
for _name in ("v_bare_attr", "v_bare_pad"):
    view(_name, f"""SELECT * FROM {_name}0 QUALIFY row_number() OVER (
        PARTITION BY meeting_id, segment_id ORDER BY ov DESC, at0, speaker_id) = 1""")
view("v_bare_near", """SELECT b.meeting_id, b.segment_id, t.speaker_id,
      greatest(t.start_ms - b.end_ms, b.start_ms - t.end_ms, 0) AS gap
    FROM v_bare b JOIN v_tx t USING (meeting_id) WHERE greatest(t.start_ms - b.end_ms, b.start_ms - t.end_ms, 0) <= 200
    QUALIFY row_number() OVER (PARTITION BY b.meeting_id, b.segment_id ORDER BY gap, t.start_ms, t.speaker_id) = 1""")


def bare_segments(v: Views):
    """Segments whose text opens some meeting are taken as having no word timestamps."""
    opening = v.segments.filter(F.col("seg_idx") == 0).select("text").distinct()
    timed = v.words.join(
        v.segments.join(opening, "text", "left_semi").select("meeting_id", "segment_id"),
        ["meeting_id", "segment_id"], "left_anti")
    return at.attribute_wordless_segments(v.segments, timed, v.exclusive_turns), timed


@query("d05_segment_fallback", """SELECT b.meeting_id, b.segment_id,
    coalesce(a.speaker_id, p.speaker_id, n.speaker_id) AS speaker_id,
    CASE WHEN a.speaker_id IS NOT NULL THEN 'segment_overlap' WHEN p.speaker_id IS NOT NULL THEN 'segment_tolerance'
         WHEN n.speaker_id IS NOT NULL THEN 'segment_nearest' ELSE 'unknown' END AS method
    FROM v_bare b LEFT JOIN v_bare_attr a USING (meeting_id, segment_id)
    LEFT JOIN v_bare_pad p USING (meeting_id, segment_id) LEFT JOIN v_bare_near n USING (meeting_id, segment_id)""")
def _(v):
    return bare_segments(v)[0].select("meeting_id", "segment_id", "speaker_id", "method")


view("v_ch", """SELECT *, start_ms // 600000 AS chunk, seg_idx * 100000 + word_index AS word_no FROM v_wd""")
view("v_opt", """SELECT *, row_number() OVER (PARTITION BY meeting_id, chunk ORDER BY word_no) AS k FROM (
    SELECT w.meeting_id, w.chunk, w.word_no, list(s.seg_idx ORDER BY greatest(0, least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms)) DESC,
      abs(w.start_ms + w.end_ms - s.start_ms - s.end_ms), s.seg_idx) AS options
    FROM v_ch w JOIN v_sg s ON s.meeting_id = w.meeting_id AND w.start_ms >= s.start_ms - 500 AND w.end_ms <= s.end_ms + 500
      AND w.chunk BETWEEN s.start_ms // 600000 AND s.end_ms // 600000 GROUP BY ALL)""")
view("v_walk", """WITH RECURSIVE walk AS (
      SELECT DISTINCT meeting_id, chunk, 0::BIGINT AS k, -1::BIGINT AS place, NULL::BIGINT AS word_no, false AS compatible FROM v_opt
      UNION ALL SELECT meeting_id, chunk, k, coalesce(x, place), word_no, x IS NOT NULL FROM (
        SELECT o.meeting_id, o.chunk, o.k, o.word_no, w.place, [s for s in o.options if s >= w.place][1] AS x
        FROM walk w JOIN v_opt o ON o.meeting_id = w.meeting_id AND o.chunk = w.chunk AND o.k = w.k + 1))
    SELECT * FROM walk WHERE k > 0""")


@query("d06_word_to_segment", """SELECT w.meeting_id, w.segment_id, w.word_index, p.place AS chosen_segment, coalesce(p.compatible, false) AS compatible
    FROM v_ch w LEFT JOIN v_walk p USING (meeting_id, chunk, word_no)""")
def _(v):
    words = v.words.withColumn("chunk", F.floor(F.col("start_ms") / 600_000).cast("bigint")).withColumn(
        "word_no", F.col("seg_idx") * 100_000 + F.col("word_index"))
    first = F.floor(F.col("start_ms") / 600_000).cast("bigint")
    last = F.floor(F.col("end_ms") / 600_000).cast("bigint")
    segments = v.segments.withColumn("chunk", F.explode(F.sequence(first, last)))
    return at.words_to_segments(words.drop("seg_idx"), segments).select(
        "meeting_id", "segment_id", "word_index", F.col("seg_idx").alias("chosen_segment"), "compatible")


@query("d07_overlap_flag", "SELECT meeting_id, segment_id, word_index, overlap_present FROM v_atf")
def _(v):
    return flagged(v).select("meeting_id", "segment_id", "word_index", "overlap_present")


UTT_SQL = """SELECT meeting_id, utterance_id, speaker_id, start_ms, end_ms, text, segments, overlap_present FROM v_utt"""


@query("f01_assemble_utterances", UTT_SQL)
def _(v):
    return utterances(v).select(
        "meeting_id", "utterance_id", "speaker_id", "start_ms", "end_ms", "text",
        listed("source_segment_ids").alias("segments"), "overlap_present")


view("v_switch", """SELECT meeting_id, count(*) FILTER (WHERE prev <> speaker_id) AS speaker_switches FROM (
    SELECT meeting_id, speaker_id, lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY utterance_no) AS prev
    FROM v_utt WHERE speaker_id IS NOT NULL) GROUP BY 1""")


@query("f02_speaker_switches", "SELECT meeting_id, speaker_switches FROM v_switch")
def _(v):
    return at.speaker_switches(utterances(v))


@query("f03_assign_ids", """SELECT meeting_id, turn_id, 'regular_turn_' || lpad(CAST(row_number() OVER (
    PARTITION BY meeting_id ORDER BY start_ms, turn_idx) AS VARCHAR), 6, '0') AS new_id FROM v_tr""")
def _(v):
    return ordered.scan(
        v.regular_turns, ["meeting_id"], ["start_ms", "turn_idx"], ordered.bucket_of("start_ms", iv.BUCKET_MS),
        [ordered.numbered("n")],
    ).select("meeting_id", "turn_id", F.format_string("regular_turn_%06d", "n").alias("new_id"))


@query("f04_label_speakers", """SELECT meeting_id, speaker_id, 'SPEAKER_' || lpad(CAST(row_number() OVER (
    PARTITION BY meeting_id ORDER BY s, e, speaker_id) - 1 AS VARCHAR), 2, '0') AS label FROM (
    SELECT meeting_id, speaker_id, (min((start_ms, end_ms)))[1] AS s, (min((start_ms, end_ms)))[2] AS e
    FROM v_layers GROUP BY ALL)""")
def _(v):
    return at.label_speakers(v.layered_turns)


@query("f05_order_checks", """SELECT meeting_id, count(*) FILTER (WHERE start_ms < prev_start) AS unordered_starts,
    count(*) FILTER (WHERE start_ms < prev_end) AS overlapping_turns FROM (
    SELECT meeting_id, start_ms, lag(start_ms) OVER w AS prev_start, lag(end_ms) OVER w AS prev_end FROM v_tr
    WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_idx)) GROUP BY 1""")
def _(v):
    rows = ordered.scan(
        v.regular_turns, ["meeting_id"], ["turn_idx"], ordered.bucket_of("turn_idx", 4096),
        [ordered.previous("_ps", F.col("start_ms")), ordered.previous("_pe", F.col("end_ms"))])
    return rows.groupBy("meeting_id").agg(
        F.count_if(F.col("start_ms") < F.col("_ps")).alias("unordered_starts"),
        F.count_if(F.col("start_ms") < F.col("_pe")).alias("overlapping_turns"))


@query("e01_reconciliation_info", """SELECT meeting_id, utterances, segment_fallbacks, total_words, direct_words,
    tolerance_words, nearest_words, unknown_words, coalesce(speaker_switches, 0) AS speaker_switches,
    round((total_words - unknown_words) / total_words, 6) AS coverage
    FROM (SELECT meeting_id, count(*) AS utterances, 0::BIGINT AS segment_fallbacks FROM v_utt GROUP BY 1)
    LEFT JOIN (SELECT meeting_id, count(*) AS total_words, count(*) FILTER (WHERE method = 'overlap') AS direct_words,
      count(*) FILTER (WHERE method = 'tolerance') AS tolerance_words,
      count(*) FILTER (WHERE method = 'nearest') AS nearest_words,
      count(*) FILTER (WHERE method = 'unknown') AS unknown_words FROM v_at GROUP BY 1) USING (meeting_id)
    LEFT JOIN v_switch USING (meeting_id)""")
def _(v):
    words = flagged(v)
    return at.reconciliation_info(words, at.assemble_utterances(words))


@query("g01_overlap_regions", "SELECT meeting_id, start_ms, end_ms, speakers FROM v_regions")
def _(v):
    return iv.overlap_regions(v.regular_turns).withColumn("speakers", listed("speakers"))


view("v_clip", """SELECT meeting_id, layer, speaker_id, least(start_ms, duration_ms) AS s, least(end_ms, duration_ms) AS e
    FROM v_layers JOIN v_dur USING (meeting_id) WHERE least(end_ms, duration_ms) > least(start_ms, duration_ms)""")
view("v_tlp", """SELECT meeting_id, s AS t FROM v_clip UNION SELECT meeting_id, e FROM v_clip
    UNION SELECT meeting_id, 0 FROM v_dur UNION SELECT meeting_id, duration_ms FROM v_dur""")
view("v_tlc", """SELECT * FROM (SELECT meeting_id, t AS s, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS e
    FROM v_tlp) WHERE e IS NOT NULL""")
view("v_tl", """SELECT c.meeting_id, c.s, c.e,
    coalesce(string_agg(DISTINCT speaker_id, ',' ORDER BY speaker_id) FILTER (WHERE layer = 'regular'), '') AS regular,
    coalesce(string_agg(DISTINCT speaker_id, ',' ORDER BY speaker_id) FILTER (WHERE layer = 'exclusive'), '') AS exclusive,
    coalesce(string_agg(DISTINCT speaker_id, ',' ORDER BY speaker_id) FILTER (WHERE layer = 'secondary'), '') AS secondary
    FROM v_tlc c LEFT JOIN v_clip t ON t.meeting_id = c.meeting_id AND t.s < c.e AND t.e > c.s GROUP BY ALL""")


@query("g02_elementary_timeline",
       "SELECT meeting_id, s AS start_ms, e AS end_ms, regular, exclusive, secondary FROM v_tl")
def _(v):
    return cells(v).select("meeting_id", "start_ms", "end_ms", listed("regular").alias("regular"),
                           listed("exclusive").alias("exclusive"), listed("secondary").alias("secondary"))


view("v_mx", """SELECT c.meeting_id, b.speaker_id AS secondary_id, a.speaker_id AS primary_id,
    CAST(sum(c.e - c.s) AS BIGINT) AS overlap_ms FROM v_tlc c
    JOIN (SELECT DISTINCT c.meeting_id, c.s, t.speaker_id FROM v_tlc c JOIN v_clip t ON t.meeting_id = c.meeting_id
          AND t.layer = 'regular' AND t.s < c.e AND t.e > c.s) a ON a.meeting_id = c.meeting_id AND a.s = c.s
    JOIN (SELECT DISTINCT c.meeting_id, c.s, t.speaker_id FROM v_tlc c JOIN v_clip t ON t.meeting_id = c.meeting_id
          AND t.layer = 'secondary' AND t.s < c.e AND t.e > c.s) b ON b.meeting_id = c.meeting_id AND b.s = c.s
    GROUP BY ALL""")
view("v_tot", """SELECT meeting_id, CASE layer WHEN 'regular' THEN 'primary' ELSE 'secondary' END AS side, speaker_id,
    CAST(sum(e - s) AS BIGINT) AS total_ms FROM (SELECT DISTINCT c.meeting_id, c.s, c.e, t.layer, t.speaker_id
      FROM v_tlc c JOIN v_clip t ON t.meeting_id = c.meeting_id AND t.s < c.e AND t.e > c.s
      WHERE t.layer <> 'exclusive') GROUP BY ALL""")


@query("e02_overlap_matrix", "SELECT meeting_id, secondary_id, primary_id, overlap_ms FROM v_mx")
def _(v):
    return ag.overlap_matrix(cells(v))


view("v_rows", """SELECT meeting_id, speaker_id AS secondary_id, row_number() OVER (PARTITION BY meeting_id
    ORDER BY speaker_id) AS r FROM (SELECT DISTINCT meeting_id, speaker_id FROM v_ts)""")
view("v_cols", """SELECT meeting_id, primary_id, row_number() OVER (PARTITION BY meeting_id ORDER BY primary_id) AS c
    FROM (SELECT DISTINCT meeting_id, speaker_id AS primary_id FROM v_tr)
    UNION ALL SELECT DISTINCT meeting_id, NULL, 99 FROM v_ts""")
view("v_opt", """SELECT r.meeting_id, r.r, r.secondary_id, c.c, c.primary_id, coalesce(m.overlap_ms, 0) AS ov
    FROM v_rows r JOIN v_cols c USING (meeting_id) LEFT JOIN v_mx m ON m.meeting_id = r.meeting_id
      AND m.secondary_id = r.secondary_id AND m.primary_id = c.primary_id""")
view("v_perm", """SELECT a.meeting_id, a.c AS c1, b.c AS c2, d.c AS c3,
    a.ov + coalesce(b.ov, 0) + coalesce(d.ov, 0) AS total FROM (SELECT * FROM v_opt WHERE r = 1) a
    LEFT JOIN (SELECT * FROM v_opt WHERE r = 2) b ON b.meeting_id = a.meeting_id AND (b.c = 99 OR b.c <> a.c)
    LEFT JOIN (SELECT * FROM v_opt WHERE r = 3) d ON d.meeting_id = a.meeting_id AND (d.c = 99 OR d.c NOT IN (a.c, b.c))
    QUALIFY row_number() OVER (PARTITION BY a.meeting_id ORDER BY total DESC, c1, c2, c3) = 1""")
view("v_map", """SELECT o.meeting_id, o.secondary_id, CASE WHEN o.ov > 0 THEN o.primary_id END AS primary_id,
    CASE WHEN o.ov > 0 THEN o.ov ELSE 0 END AS overlap_ms FROM v_opt o JOIN v_perm p USING (meeting_id)
    WHERE o.c = CASE o.r WHEN 1 THEN p.c1 WHEN 2 THEN p.c2 ELSE p.c3 END""")


@query("e03_assign_speakers", "SELECT meeting_id, secondary_id, primary_id, overlap_ms FROM v_map")
def _(v):
    return mapping(v)


@query("d20_map_speakers", """SELECT t.meeting_id, t.turn_idx, m.primary_id AS mapped_speaker FROM v_ts t
    LEFT JOIN v_map m ON m.meeting_id = t.meeting_id AND m.secondary_id = t.speaker_id""")
def _(v):
    from dialogue_lake.operators.lookup import spread_join

    return spread_join(
        v.secondary_turns.withColumnRenamed("speaker_id", "secondary_id"), mapping(v),
        ["meeting_id", "secondary_id"], F.col("start_ms")).select(
        "meeting_id", "turn_idx", F.col("primary_id").alias("mapped_speaker"))


@query("e04_split_merge_hints", """WITH q AS (SELECT m.*, p.total_ms AS p_ms, s.total_ms AS s_ms FROM v_mx m
      JOIN v_tot p ON p.meeting_id = m.meeting_id AND p.side = 'primary' AND p.speaker_id = m.primary_id
      JOIN v_tot s ON s.meeting_id = m.meeting_id AND s.side = 'secondary' AND s.speaker_id = m.secondary_id)
    SELECT meeting_id, 'split' AS hint, primary_id AS label, string_agg(secondary_id, ',' ORDER BY secondary_id) AS partners
    FROM q WHERE overlap_ms / p_ms >= 0.2 GROUP BY 1, 3 HAVING count(*) > 1
    UNION ALL SELECT meeting_id, 'merge', secondary_id, string_agg(primary_id, ',' ORDER BY primary_id)
    FROM q WHERE overlap_ms / s_ms >= 0.2 GROUP BY 1, 3 HAVING count(*) > 1""".replace("WITH q AS (", "SELECT * FROM (WITH q AS (") + ")")
def _(v):
    base = cells(v)
    return ag.split_merge_hints(ag.overlap_matrix(base), ag.speaking_totals(base)).withColumn(
        "partners", listed("partners"))


@query("i07_unmapped_speakers", """SELECT meeting_id, primary_count, secondary_count,
    primary_count <> secondary_count AS count_mismatch, coalesce(unmapped_primary, '') AS unmapped_primary,
    coalesce(unmapped_secondary, '') AS unmapped_secondary FROM
    (SELECT meeting_id, count(DISTINCT speaker_id) AS secondary_count FROM v_ts GROUP BY 1)
    JOIN (SELECT meeting_id, count(DISTINCT speaker_id) AS primary_count FROM v_tr GROUP BY 1) USING (meeting_id)
    LEFT JOIN (SELECT meeting_id, string_agg(secondary_id, ',' ORDER BY secondary_id) AS unmapped_secondary FROM v_map
               WHERE primary_id IS NULL GROUP BY 1) USING (meeting_id)
    LEFT JOIN (SELECT meeting_id, string_agg(speaker_id, ',' ORDER BY speaker_id) AS unmapped_primary FROM (
        SELECT DISTINCT meeting_id, speaker_id FROM v_tr EXCEPT
        SELECT meeting_id, primary_id FROM v_map WHERE primary_id IS NOT NULL) GROUP BY 1) USING (meeting_id)""")
def _(v):
    return ag.alignment_summary(mapping(v), labels(v)).select(
        "meeting_id", "primary_count", "secondary_count", "count_mismatch",
        listed("unmapped_primary").alias("unmapped_primary"), listed("unmapped_secondary").alias("unmapped_secondary"))


view("v_mapped", """SELECT c.meeting_id, c.s, string_agg(m.primary_id, ',' ORDER BY m.primary_id) AS mapped,
      bool_or(m.primary_id IS NULL) AS has_unmapped FROM v_tlc c
    JOIN (SELECT DISTINCT c.meeting_id, c.s, t.speaker_id FROM v_tlc c JOIN v_clip t ON t.meeting_id = c.meeting_id
          AND t.layer = 'secondary' AND t.s < c.e AND t.e > c.s) b ON b.meeting_id = c.meeting_id AND b.s = c.s
    LEFT JOIN v_map m ON m.meeting_id = c.meeting_id AND m.secondary_id = b.speaker_id GROUP BY ALL""")
view("v_state", """SELECT t.*, coalesce(m.mapped, '') AS mapped, split_part(t.exclusive, ',', 1) AS ex,
    CASE WHEN regular = '' AND secondary = '' THEN 'SILENCE' WHEN secondary = '' THEN 'PRIMARY_ONLY'
      WHEN regular = '' THEN 'SECONDARY_ONLY' WHEN has_unmapped THEN 'UNMAPPED_SECONDARY'
      WHEN contains(regular, ',') OR contains(secondary, ',') THEN
        CASE WHEN regular = coalesce(m.mapped, '') THEN 'OVERLAP_AGREE' ELSE 'OVERLAP_DISAGREE' END
      ELSE CASE WHEN regular = coalesce(m.mapped, '') THEN 'AGREE' ELSE 'DISAGREE' END END AS state
    FROM v_tl t LEFT JOIN v_mapped m USING (meeting_id, s)""")
view("v_cmp", """SELECT meeting_id, min(s) AS start_ms, max(e) AS end_ms, regular, ex, secondary, mapped, state FROM (
      SELECT *, sum(f) OVER (PARTITION BY meeting_id ORDER BY s) AS g FROM (SELECT *,
        CASE WHEN lag(e) OVER w = s AND lag((regular, ex, secondary, mapped, state)) OVER w
          = (regular, ex, secondary, mapped, state) THEN 0 ELSE 1 END AS f
        FROM v_state WINDOW w AS (PARTITION BY meeting_id ORDER BY s)))
    GROUP BY meeting_id, g, regular, ex, secondary, mapped, state""")


@query("g03_interval_state", "SELECT meeting_id, s AS start_ms, e AS end_ms, mapped, state FROM v_state")
def _(v):
    return ag.interval_state(ag.map_secondary(cells(v), mapping(v))).select(
        "meeting_id", "start_ms", "end_ms", listed("mapped").alias("mapped"), "state")


@query("g04_coalesce_intervals", """SELECT meeting_id, start_ms, end_ms, regular, ex AS exclusive_speaker, secondary,
    mapped, state FROM v_cmp""")
def _(v):
    return intervals(v).select(
        "meeting_id", "start_ms", "end_ms", listed("regular").alias("regular"),
        F.coalesce("exclusive_speaker", F.lit("")).alias("exclusive_speaker"),
        listed("secondary").alias("secondary"), listed("mapped").alias("mapped"), "state")


view("v_union", """SELECT meeting_id, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
    SELECT *, sum(f) OVER (PARTITION BY meeting_id, speaker_id ORDER BY start_ms, end_ms) AS g FROM (
      SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY meeting_id, speaker_id ORDER BY start_ms, end_ms
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM v_ts))
    GROUP BY meeting_id, speaker_id, g""")


@query("g05_union_intervals", "SELECT meeting_id, speaker_id, start_ms, end_ms FROM v_union")
def _(v):
    return iv.union_intervals(v.secondary_turns, ["meeting_id", "speaker_id"])


MEASURE = """SELECT k.meeting_id, {ids}, k.speaker_id, k.start_ms, k.end_ms, {sums}
  FROM {src} k LEFT JOIN (SELECT k.meeting_id, {ids}, c.*EXCLUDE (meeting_id, start_ms, end_ms),
      least(k.end_ms, c.end_ms) - greatest(k.start_ms, c.start_ms) AS ms,
      CASE WHEN NOT contains(c.secondary, ',') AND c.secondary <> '' AND c.mapped <> '' THEN c.mapped END AS sole
    FROM {src} k JOIN v_cmp c ON c.meeting_id = k.meeting_id AND c.start_ms < k.end_ms AND c.end_ms > k.start_ms
    WHERE k.end_ms > k.start_ms) c USING (meeting_id, {using})
    GROUP BY k.meeting_id, {ids}, k.speaker_id, k.start_ms, k.end_ms"""

_plain = "state IN ('SILENCE', 'PRIMARY_ONLY', 'SECONDARY_ONLY', 'UNMAPPED_SECONDARY')"
_agrees = "coalesce(sole = k.speaker_id AND ex = k.speaker_id, false)"
_tests = {
    "agreement": f"NOT {_plain} AND {_agrees}", "disagreement": f"NOT {_plain} AND NOT {_agrees}",
    "primary_only": "state = 'PRIMARY_ONLY'", "secondary_only": "state = 'SECONDARY_ONLY'",
    "silence": "state = 'SILENCE'", "primary_overlap": "contains(regular, ',')",
    "secondary_overlap": "contains(secondary, ',')", "overlap_agreement": "state = 'OVERLAP_AGREE'",
    "unmapped": "state = 'UNMAPPED_SECONDARY'",
}
_sums = ", ".join(
    f"CASE WHEN k.end_ms > k.start_ms THEN least(1.0::DOUBLE, CAST(coalesce(sum(ms) FILTER (WHERE {t}), 0) AS DOUBLE)"
    f" / (k.end_ms - k.start_ms)) ELSE 0.0::DOUBLE END AS {n}_fraction" for n, t in _tests.items())
view("v_wm", MEASURE.format(ids="k.segment_id, k.word_index", using="segment_id, word_index", src="v_at", sums=_sums))
view("v_um", MEASURE.format(ids="k.utterance_id", using="utterance_id", src="v_utt", sums=_sums))
view("v_wsole", """SELECT meeting_id, segment_id, word_index, arg_min(sole, (-ms, sole)) AS secondary_speaker FROM (
    SELECT k.meeting_id, k.segment_id, k.word_index, c.mapped AS sole,
      CAST(sum(least(k.end_ms, c.end_ms) - greatest(k.start_ms, c.start_ms)) AS BIGINT) AS ms
    FROM v_at k JOIN v_cmp c ON c.meeting_id = k.meeting_id AND c.start_ms < k.end_ms AND c.end_ms > k.start_ms
    WHERE k.end_ms > k.start_ms AND NOT contains(c.secondary, ',') AND c.secondary <> '' AND c.mapped <> ''
    GROUP BY ALL) GROUP BY ALL""")
view("v_cm", """SELECT meeting_id, count(DISTINCT speaker_id) FILTER (WHERE layer = 'regular')
    <> count(DISTINCT speaker_id) FILTER (WHERE layer = 'secondary') AS count_mismatch
    FROM v_layers GROUP BY 1""")


def _status_sql(zero: str) -> str:
    unsure = f"({zero} OR unmapped_fraction > 1 - 0.65)"
    good = (f"(NOT {unsure} AND agreement_fraction >= 0.9 AND greatest(primary_overlap_fraction,"
            " secondary_overlap_fraction) <= 0.1)")
    reasons = [
        (zero, "zero_duration_no_temporal_support"),
        ("greatest(primary_overlap_fraction, secondary_overlap_fraction) > 0", "overlapping_speech"),
        ("disagreement_fraction > 0", "speaker_disagreement"),
        ("primary_only_fraction + secondary_only_fraction > 0", "speech_presence_disagreement"),
        ("silence_fraction > 0", "shared_silence"), ("unmapped_fraction > 0", "unmapped_secondary"),
        ("count_mismatch", "speaker_count_mismatch"), (good, "high_model_agreement"),
    ]
    listed_reasons = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in reasons)
    return (f"CASE WHEN {unsure} THEN 'UNCERTAIN' WHEN {good} THEN 'RELIABLE' WHEN agreement_fraction >= 0.65 "
            f"THEN 'MIXED' ELSE 'UNCERTAIN' END AS status, concat_ws(',', {listed_reasons}) AS reasons")


view("v_wr", f"SELECT *, {_status_sql('start_ms = end_ms')} FROM v_wm LEFT JOIN v_cm USING (meeting_id) "
             "LEFT JOIN v_wsole USING (meeting_id, segment_id, word_index)")
view("v_ur", f"SELECT *, {_status_sql('false')} FROM v_um LEFT JOIN v_cm USING (meeting_id)")
_rounded = ", ".join(f"round({c}, 6) AS {c}" for c in FRACTION_COLUMNS)


@query("g08_time_fractions", f"SELECT meeting_id, segment_id, word_index, secondary_speaker, {_rounded} FROM v_wr")
def _(v):
    rows = ag.time_fractions(attributed(v), intervals(v), ["segment_id", "word_index"])
    return rows.select("meeting_id", "segment_id", "word_index", "secondary_speaker",
                       *[F.round(c, 6).alias(c) for c in FRACTION_COLUMNS])


def word_reliability(v: Views):
    return ag.word_reliability(attributed(v), intervals(v), ag.alignment_summary(mapping(v), labels(v)))


def utterance_reliability(v: Views):
    return ag.utterance_reliability(utterances(v), intervals(v), ag.alignment_summary(mapping(v), labels(v)))


@query("e06_classify_reliability", "SELECT meeting_id, segment_id, word_index, status, reasons FROM v_wr")
def _(v):
    return word_reliability(v).select("meeting_id", "segment_id", "word_index", "status", listed("reasons").alias("reasons"))


@query("e05_state_seconds", """SELECT meeting_id, state, CAST(sum(end_ms - start_ms) AS BIGINT) AS state_ms
    FROM v_cmp GROUP BY ALL""")
def _(v):
    return ag.state_durations(intervals(v))


@query("e05_agreement_fraction", """SELECT meeting_id, CAST(agree AS BIGINT) AS agree_ms, CAST(total AS BIGINT) AS total_ms,
    CAST(total - silence AS BIGINT) AS speech_ms, CAST(ovl AS BIGINT) AS overlap_ms,
    round(CASE WHEN total - silence > 0 THEN agree / (total - silence) ELSE 0 END, 6) AS agreement_fraction FROM (
    SELECT meeting_id, sum(end_ms - start_ms) AS total,
      coalesce(sum(end_ms - start_ms) FILTER (WHERE state IN ('AGREE', 'OVERLAP_AGREE')), 0) AS agree,
      coalesce(sum(end_ms - start_ms) FILTER (WHERE state = 'SILENCE'), 0) AS silence,
      coalesce(sum(end_ms - start_ms) FILTER (WHERE contains(regular, ',') OR contains(secondary, ',')), 0) AS ovl
    FROM v_cmp GROUP BY 1)""")
def _(v):
    return ag.agreement_summary(intervals(v)).select(
        "meeting_id", "agree_ms", "total_ms", "speech_ms", "overlap_ms", "agreement_fraction")


@query("e08_word_status", """SELECT meeting_id, status, words,
    round(words / sum(words) OVER (PARTITION BY meeting_id), 6) AS fraction
    FROM (SELECT meeting_id, status, count(*) AS words FROM v_wr GROUP BY ALL)""")
def _(v):
    from dialogue_lake.operators import metrics

    return metrics.status_shares(word_reliability(v))


view("v_bda", """SELECT u.meeting_id, u.utterance_id, t.start_ms AS ts, t.end_ms AS te FROM v_utt u JOIN v_tx t
      ON t.meeting_id = u.meeting_id AND t.speaker_id = u.speaker_id AND t.start_ms < u.end_ms AND t.end_ms > u.start_ms
    QUALIFY row_number() OVER (PARTITION BY u.meeting_id, u.utterance_id ORDER BY
      least(u.end_ms, t.end_ms) - greatest(u.start_ms, t.start_ms) DESC, t.start_ms, t.end_ms) = 1""")
view("v_bdb", """SELECT u.meeting_id, u.utterance_id, t.start_ms AS ts, t.end_ms AS te FROM v_utt u JOIN v_map m
      ON m.meeting_id = u.meeting_id AND m.primary_id = u.speaker_id JOIN v_ts t ON t.meeting_id = u.meeting_id
      AND t.speaker_id = m.secondary_id AND t.start_ms < u.end_ms AND t.end_ms > u.start_ms
    QUALIFY row_number() OVER (PARTITION BY u.meeting_id, u.utterance_id ORDER BY
      least(u.end_ms, t.end_ms) - greatest(u.start_ms, t.start_ms) DESC, t.start_ms, t.end_ms) = 1""")


@query("d21_boundary_deltas", """SELECT u.meeting_id, u.utterance_id, b.ts - a.ts AS start_delta_ms,
    b.te - a.te AS end_delta_ms, abs(b.ts - a.ts) + abs(b.te - a.te) AS boundary_disagreement_ms
    FROM v_utt u LEFT JOIN v_bda a USING (meeting_id, utterance_id) LEFT JOIN v_bdb b USING (meeting_id, utterance_id)""")
def _(v):
    return ag.boundary_deltas(utterances(v), v.exclusive_turns, v.secondary_turns, mapping(v))


@query("e27_reliability_label", """SELECT meeting_id, CASE WHEN bool_or(count_mismatch) THEN 'count_mismatch'
    WHEN bool_or(status = 'UNCERTAIN') THEN 'uncertain' WHEN bool_or(status = 'MIXED') THEN 'mixed'
    ELSE 'consistent' END AS label FROM v_ur GROUP BY 1""")
def _(v):
    from dialogue_lake.operators import review

    return review.reliability_label(utterance_reliability(v))


@query("h05_mixed_top5", """SELECT meeting_id, utterance_id, round(disagreement_fraction, 6) AS disagreement_fraction
    FROM v_ur WHERE status = 'MIXED' AND disagreement_fraction >= 0.2 QUALIFY row_number() OVER (
      PARTITION BY meeting_id ORDER BY disagreement_fraction DESC, utterance_id) <= 5""")
def _(v):
    from dialogue_lake.operators import review

    return review.most_disputed(utterance_reliability(v)).withColumn(
        "disagreement_fraction", F.round("disagreement_fraction", 6))

"""Text function and terminology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import similarity as sim
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import terms as tm
from dialogue_lake.plans.registry import listed, query, view
from dialogue_lake.plans.sql_views import strings
from dialogue_lake.plans.views import Views

W = r"[\p{L}\p{N}_]"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def norm_sql(x: str) -> str:
    """Term normalisation of already composed text."""
    s = fold_sql(x)
    for mark, word in (("+", " plus "), ("#", " sharp "), ("*", " star "), ("&", " and ")):
        s = f"replace({s}, '{mark}', '{word}')"
    fenced = (
        f"regexp_replace({s}, '(^|[^\\p{{L}}\\p{{N}}_])((?:[a-z][.\\s]){{2,}}[a-z])(\\.?)($|[^\\p{{L}}\\p{{N}}_])', "
        "'\\1' || chr(1) || '\\2' || chr(1) || '\\4', 'g')")
    joined = (
        f"array_to_string(list_transform(string_split({fenced}, chr(1)), lambda p, i: "
        "CASE WHEN i % 2 = 0 THEN regexp_replace(p, '[^a-z]', '', 'g') ELSE p END), '')")
    return f"trim(regexp_replace({joined}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


MEANING_SQL = r"\d+(?:[.,:/-]\d+)*(?:%|[a-z]+)?|[a-z]+(?:''[a-z]+)?|[%$€£¥]"


def meaning_sql(x: str) -> str:
    return f"regexp_extract_all(replace({fold_sql(x)}, '’', ''''), '{MEANING_SQL}')"


def signature_sql(tokens: str) -> str:
    return (f"list_filter({tokens}, lambda t: list_contains({strings(fixed.PROTECTED_MEANING)}, t) "
            "OR regexp_matches(t, '[0-9]') OR t IN ('%', '$', '€', '£', '¥'))")


view("v_text", """SELECT 'utterance' AS origin, meeting_id * 1000 + utt_idx AS text_id, text FROM v_u
    UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
    UNION ALL SELECT 'page', page_id, html FROM pages""")


def texts(v: Views):
    parts = [
        v.utterances.select(F.lit("utterance").alias("origin"), (F.col("meeting_id") * 1000 + F.col("utt_idx")).alias("text_id"), "text"),
        v.table("documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("text_id"), "text"),
        v.table("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("text_id"), "text"),
        v.table("pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("text_id"), F.col("html").alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_query(name: str, column, sql: str):
    """A scalar function over every text, compared by hash."""
    sql = f"SELECT origin, text_id, md5({sql}) AS hash FROM v_text"

    @query(name, sql)
    def _(v):
        return texts(v).select("origin", "text_id", F.md5(column(F.col("text"))).alias("hash"))


text_query("b01_normalize_term", tx.normalize_term, norm_sql("text"))
text_query("b02_compact_key", tx.compact_key, f"replace({norm_sql('text')}, ' ', '')")
text_query("b03_comparable", tx.comparable, f"regexp_replace({fold_sql('text')}, '[\\s\\-–—]+', '', 'g')")
text_query("b05_meaning_tokens", lambda c: F.array_join(tx.meaning_tokens(c), " "),
           f"array_to_string({meaning_sql('text')}, ' ')")
text_query("b06_protected_signature", lambda c: F.array_join(tx.protected_signature(c), " "),
           f"array_to_string({signature_sql(meaning_sql('text'))}, ' ')")
text_query("b12_wer_tokens", lambda c: F.array_join(tx.wer_tokens(c), " "),
           r"array_to_string(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\S+'), ' ')")
text_query("b15_escape_markdown", tx.escape_markdown,
           r"replace(replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
           r"'([\\`*_\[\]()#!|])', '\\\1', 'g'), chr(13), ' '), chr(10), ' ')")


@query("b04_is_protected", f"""SELECT origin, text_id, list_has_any(regexp_extract_all(replace({fold_sql('text')}, '’', ''''),
    '[\\p{{L}}\\p{{N}}_'']+'), {strings(fixed.PROTECTED_TERMS)}) AS is_protected FROM v_text""")
def _(v):
    return texts(v).select("origin", "text_id", tx.is_protected(F.col("text")).alias("is_protected"))


def edited(c):
    for old, new in ((" and ", " not "), (" to ", " 7 "), (" is ", " may "), (" was ", " friday ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


EDITED = "replace(replace(replace(replace(text, ' and ', ' not '), ' to ', ' 7 '), ' is ', ' may '), ' was ', ' friday ')"
FLAGS = {
    "number_changes": "regexp_matches(t, '[0-9]')",
    "negation_changes": f"list_contains({strings(fixed.NEGATIONS)}, t)",
    "date_time_changes": f"list_contains({strings(fixed.DATE_WORDS)}, t) OR regexp_matches(t, '^\\d+[:/-]\\d+(?:[:/-]\\d+)?$')",
    "modality_changes": f"list_contains({strings(fixed.MODALITY)}, t)",
}


@query("b07_safety_violations", "SELECT origin, text_id, " + ", ".join(
    f"list_filter(a, lambda t: {c}) <> list_filter(b, lambda t: {c}) AS {n}" for n, c in FLAGS.items())
    + f", {signature_sql('a')} <> {signature_sql('b')} AS protected_content_changes FROM (SELECT origin, text_id, "
    f"{meaning_sql('text')} AS a, {meaning_sql(EDITED)} AS b FROM v_text)")
def _(v):
    pair = texts(v).select("origin", "text_id", tx.meaning_tokens(F.col("text")).alias("a"),
                           tx.meaning_tokens(edited(F.col("text"))).alias("b"))
    flags = tx.safety_flags(F.col("a"), F.col("b"))
    return pair.select("origin", "text_id", *[c.alias(n) for n, c in flags.items()])


@query("b08_phonetic_code")
def _(v):
    both = v.utterances.select("text").unionByName(v.table("documents").select("text"))
    words = both.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("token")).distinct()
    return words.select("token", sim.metaphone("token").alias("code"))


@query("b09_lexical_score", """SELECT entry_id, round(2.0 * (length(canonical) - 1) / (2 * length(canonical) - 1), 6) AS lexical
    FROM v_g""")
def _(v):
    return v.glossary.select("entry_id", F.round(sim.lexical_score("canonical", "asr_alias"), 6).alias("lexical"))


@query("b10_jaccard", f"""SELECT meeting_id, utt_idx, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6)
    AS jaccard FROM (SELECT u.meeting_id, u.utt_idx,
      list_filter(list_distinct({tokens_sql('u.text')}), lambda t: NOT list_contains({strings(fixed.CONTENT_STOP)}, t)) AS a,
      list_filter(list_distinct({tokens_sql('p.text')}), lambda t: NOT list_contains({strings(fixed.CONTENT_STOP)}, t)) AS b
    FROM v_u u JOIN v_u p ON p.meeting_id = u.meeting_id AND p.utt_idx = u.utt_idx - 1)""")
def _(v):
    before = v.utterances.select("meeting_id", (F.col("utt_idx") + 1).alias("utt_idx"), F.col("text").alias("earlier"))
    return v.utterances.join(before, ["meeting_id", "utt_idx"]).select(
        "meeting_id", "utt_idx",
        F.round(tx.jaccard(tx.content_terms(F.col("text")), tx.content_terms(F.col("earlier"))), 6).alias("jaccard"))


@query("b11_extract_terms")
def _(v):
    documents = v.utterances.select(F.format_string("%d/%d", "meeting_id", "utt_idx").alias("source_id"), "text")
    return tm.extract_terms(documents, v.glossary)


@query("b13_literal_support", f"""SELECT meeting_id, utt_idx, contains(' ' || array_to_string({tokens_sql('text')}, ' ') || ' ',
    ' ' || array_to_string({tokens_sql('deadline_text')}, ' ') || ' ') AS supported FROM (
    SELECT i.meeting_id, i.utt_idx, i.deadline_text, u.text FROM v_it i JOIN v_u u ON u.meeting_id = i.meeting_id
      AND u.utt_idx = i.utt_idx - 1 WHERE i.deadline_text IS NOT NULL)""")
def _(v):
    before = v.utterances.select("meeting_id", (F.col("utt_idx") + 1).alias("utt_idx"), F.col("text").alias("source"))
    return v.items.filter(F.col("deadline_text").isNotNull()).drop("text").join(before, ["meeting_id", "utt_idx"]).select(
        "meeting_id", "utt_idx", tx.literal_support(F.col("deadline_text"), F.col("source")).alias("supported"))


TS = ("lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
      "lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')")


@query("b14_timestamp_text", f"""SELECT meeting_id, utt_idx, {TS.format('start_ms')} AS stamp,
    lpad(CAST(start_ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock
    FROM v_u""")
def _(v):
    return v.utterances.select("meeting_id", "utt_idx", tx.timestamp_text(F.col("start_ms")).alias("stamp"),
                               tx.clock_text(F.col("start_ms")).alias("clock"))


@query("b16_count_term", f"""SELECT meeting_id, utt_idx, CAST(len(list_filter(l, lambda t: t = l[1])) AS BIGINT) AS hits
    FROM (SELECT meeting_id, utt_idx, {tokens_sql('text')} AS l FROM v_u) WHERE len(l) > 0""")
def _(v):
    first = F.regexp_extract("text", r"([\p{L}\p{N}_]+)", 1)
    return v.utterances.withColumn("term", first).filter(F.col("term") != "").select(
        "meeting_id", "utt_idx", tx.count_term(F.col("text"), F.col("term")).cast("bigint").alias("hits"))


@query("b17_search_utterances", "SELECT meeting_id, utterance_id FROM v_u WHERE contains(lower(text), lower('The'))")
def _(v):
    return v.utterances.filter(tx.search_text(F.col("text"), "The")).select("meeting_id", "utterance_id")


@query("b18_keyword_match", f"""SELECT meeting_id, utt_idx, list_has_any({tokens_sql('text')}, ['the', 'der', 'le'])
    AND list_has_any({tokens_sql('text')}, ['and', 'und', 'et']) AS matched FROM v_u""")
def _(v):
    groups = F.array(F.array(*map(F.lit, ("the", "der", "le"))), F.array(*map(F.lit, ("and", "und", "et"))))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return v.utterances.select("meeting_id", "utt_idx", tx.keyword_match(tokens, groups).alias("matched"))


@query("b19_frame_align", """SELECT meeting_id, utt_idx, greatest(0, (start_ms - 250) * 16) AS start_frame,
    least(duration_ms * 16, (end_ms + 250) * 16) AS end_frame FROM v_u JOIN v_dur USING (meeting_id)""")
def _(v):
    return v.utterances.join(v.durations, "meeting_id").select(
        "meeting_id", "utt_idx", tx.frame_floor(F.col("start_ms") - 250).alias("start_frame"),
        tx.frame_ceil(F.col("end_ms") + 250, F.col("duration_ms") * 16).alias("end_frame"))


@query("b20_meeting_measures", """SELECT meeting_id, count(DISTINCT speaker_id) AS speakers,
    CAST(sum(n_words) AS BIGINT) AS words, max(end_ms) AS duration_ms,
    round(CASE WHEN max(end_ms) > 0 THEN sum(n_words) * 40.0 / max(end_ms) END, 6) AS real_time_factor FROM v_u GROUP BY 1""")
def _(v):
    return v.utterances.groupBy("meeting_id").agg(
        F.count_distinct("speaker_id").alias("speakers"), F.sum("n_words").alias("words"),
        F.max("end_ms").alias("duration_ms"),
        F.round(F.try_divide(F.sum("n_words") * 40.0, F.max("end_ms")), 6).alias("real_time_factor"))


@query("b21_basename_label", r"SELECT page_id, substr(list_last(string_split(replace(url, '\', '/'), '/')), 1, 160) AS label FROM pages")
def _(v):
    return v.table("pages").select("page_id", tx.basename_label(F.col("url")).alias("label"))


@query("b22_render_words", """SELECT meeting_id, segment_id, md5(string_agg(text, ' ' ORDER BY word_index)) AS hash
    FROM v_wd GROUP BY ALL""")
def _(v):
    ordered_words = F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"])
    return v.words.groupBy("meeting_id", "segment_id").agg(F.md5(tx.render_words(ordered_words)).alias("hash"))


@query("b23_strict_json", """SELECT event_id, doc NOT LIKE '%"k"%"k"%' AND json_valid(doc) AS strict FROM (
    SELECT event_id, CASE event_type WHEN 'error' THEN '{"k": 1, ' || substr(props, 2) ELSE props END AS doc FROM events)""")
def _(v):
    doc = F.when(F.col("event_type") == "error", F.concat(F.lit('{"k": 1, '), F.expr("substring(props, 2)"))).otherwise(F.col("props"))
    rows = v.table("events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", tx.strict_json(F.col("doc")).alias("strict"))


@query("b24_error_bucket", """SELECT event_id, CASE WHEN status_code = 429 THEN 'quota' WHEN contains(code, 'timeout') THEN 'timeout'
    WHEN contains(code, 'model') THEN 'local_model' ELSE 'stage_failed' END AS bucket FROM (
    SELECT event_id, status_code, CASE stage WHEN 'error' THEN 'provider_timeout' WHEN 'click' THEN 'model_missing' ELSE stage END AS code
    FROM v_ca)""")
def _(v):
    code = F.when(F.col("stage") == "error", "provider_timeout").when(F.col("stage") == "click", "model_missing").otherwise(F.col("stage"))
    return v.calls.select("event_id", tx.error_bucket(code, F.col("status_code")).alias("bucket"))


# --- spans and candidates ---
PAT = r"([\p{L}\p{N}_]+(?:[.''’+-][\p{L}\p{N}_]+)*(?:\+\+|#|\*)?)"
OFFSETS = """SELECT meeting_id, utt_idx, CAST(i // 2 - 1 AS BIGINT) AS no, tok,
    CAST(e - length(tok) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (
    SELECT *, sum(length(tok)) OVER (PARTITION BY meeting_id, utt_idx ORDER BY i) AS e FROM (
      SELECT meeting_id, utt_idx, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (
        SELECT meeting_id, utt_idx, string_split(regexp_replace(text, '{pat}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l FROM v_u)))
    WHERE i % 2 = 0"""
view("v_tok", OFFSETS.format(pat=PAT))
view("v_wof", OFFSETS.format(pat=r"(\S+)"))
view("v_sp", """SELECT a.meeting_id, a.utt_idx, a.no AS token_no, b.no - a.no + 1 AS n_tokens, a.char_start, b.char_end,
    substr(u.text, a.char_start + 1, b.char_end - a.char_start) AS observed FROM v_tok a
    JOIN v_tok b ON b.meeting_id = a.meeting_id AND b.utt_idx = a.utt_idx AND b.no BETWEEN a.no AND a.no + 3
    JOIN v_u u ON u.meeting_id = a.meeting_id AND u.utt_idx = a.utt_idx""")
view("v_norm", f"""SELECT observed, normalized, replace(normalized, ' ', '') AS compact FROM (
    SELECT observed, {norm_sql('observed')} AS normalized FROM (SELECT DISTINCT observed FROM v_sp)) WHERE normalized <> ''
    AND NOT list_has_any(regexp_extract_all(replace({fold_sql('observed')}, '’', ''''), '[\\p{{L}}\\p{{N}}_'']+'), {strings(fixed.PROTECTED_TERMS)})
    AND NOT list_contains({strings(fixed.STOP_TERMS)}, normalized)""")
view("v_ex", """SELECT s.meeting_id, s.utt_idx, s.char_start, s.char_end, s.observed, v.entry_id, v.scope, v.priority, v.vector_no,
    CASE WHEN s.observed = v.variant THEN v.kind ELSE 'normalized_exact' END AS match_type
    FROM v_sp s JOIN v_norm n USING (observed) JOIN v_var v ON v.variant = n.compact""")
view("v_emb", "SELECT vec_id, embedding, (SELECT count(*) FROM embeddings) AS n FROM embeddings")
view("v_cos", """SELECT p.meeting_id, p.utt_idx, p.entry_id,
    greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS semantic
    FROM (SELECT DISTINCT meeting_id, utt_idx, entry_id, vector_no FROM v_ex) p, v_emb a, v_emb b
    WHERE a.vec_id = (p.meeting_id * 8 + p.utt_idx) % a.n AND b.vec_id = p.vector_no % b.n""")
SCOPE_SQL = "(0.8 * CASE scope WHEN 'global' THEN 0.2 WHEN 'project' THEN 0.6 ELSE 1.0 END + 0.2 * priority)"
view("v_sc", f"""SELECT meeting_id, utt_idx, char_start, char_end, entry_id, min(match_type) AS match_type,
    any_value(scope_score) AS scope_score, any_value(score) AS score FROM (SELECT e.*,
      {SCOPE_SQL}::DOUBLE AS scope_score,
      round(0.90 + 0.05 * c.semantic + 0.05 * {SCOPE_SQL}::DOUBLE, 9) AS score
    FROM v_ex e JOIN v_cos c USING (meeting_id, utt_idx, entry_id)) GROUP BY ALL""")
view("v_rk", """SELECT *, row_number() OVER (PARTITION BY meeting_id, utt_idx, char_start, char_end
    ORDER BY score DESC, scope_score DESC, entry_id) AS rank FROM v_sc""")


def glossary(v: Views):
    return v.glossary.select(
        "entry_id", "canonical", "scope", "priority", "category", "vector_no",
        F.array().cast("array<string>").alias("aliases"), F.array("asr_alias").alias("asr_aliases"))


def exact(v: Views):
    return v.shared("exact", lambda: tm.exact_candidates(tm.ngram_spans(v.utterances), tm.variant_table(glossary(v))))


def vectors(v: Views):
    table = v.table("embeddings")
    counted = table.agg(F.count(F.lit(1)).alias("n"))
    by_id = table.select(F.col("vec_id"), F.col("embedding").alias("vector"))
    contexts = v.utterances.select("meeting_id", "utt_idx").join(F.broadcast(counted)).withColumn(
        "vec_id", (F.col("meeting_id") * 8 + F.col("utt_idx")) % F.col("n")).join(by_id, "vec_id").select(
        "meeting_id", "utt_idx", "vector")
    entries = v.glossary.select("entry_id", "vector_no").join(F.broadcast(counted)).withColumn(
        "vec_id", F.col("vector_no") % F.col("n")).join(by_id, "vec_id").select("entry_id", "vector")
    return contexts, entries


def floor_scored(v: Views):
    """Exact candidates with the score every exact match is raised to at least."""
    pairs = exact(v)
    semantic = tm.context_cosine(pairs, *vectors(v))
    scope = tm.scope_score(F.col("scope"), F.col("priority"))
    return pairs.join(semantic, ["meeting_id", "utt_idx", "entry_id"]).withColumn("scope_score", scope).withColumn(
        "score", F.round(0.90 + 0.05 * F.col("semantic") + 0.05 * F.col("scope_score"), 9)
    ).groupBy(*tm.SPAN_KEY, "entry_id").agg(
        F.min("match_type").alias("match_type"), F.first("scope_score").alias("scope_score"), F.first("score").alias("score"))


def ranked(v: Views):
    return v.shared("ranked", lambda: tm.top_candidates(floor_scored(v), tm.SPAN_KEY))


@query("j01_ngram_spans", "SELECT meeting_id, utt_idx, token_no, n_tokens, char_start, char_end, observed FROM v_sp")
def _(v):
    return tm.ngram_spans(v.utterances)


@query("d26_span_to_words", """SELECT s.meeting_id, s.utt_idx, s.char_start, s.char_end, min(w.no) AS first_word, max(w.no) AS last_word
    FROM v_sp s JOIN v_wof w ON w.meeting_id = s.meeting_id AND w.utt_idx = s.utt_idx AND w.char_start < s.char_end
      AND w.char_end > s.char_start GROUP BY ALL""")
def _(v):
    return tm.spans_to_words(tm.ngram_spans(v.utterances), v.utterances)


@query("d10_exact_terms", "SELECT meeting_id, utt_idx, char_start, char_end, entry_id, match_type FROM v_ex")
def _(v):
    return exact(v).select(*tm.SPAN_KEY, "entry_id", "match_type")


@query("d12_context_cosine", "SELECT meeting_id, utt_idx, entry_id, round(semantic, 6) AS semantic FROM v_cos")
def _(v):
    return tm.context_cosine(exact(v), *vectors(v)).withColumn("semantic", F.round("semantic", 6))


def fuzzy_scored(v: Views):
    pairs = v.shared("pairs", lambda: tm.candidate_pairs(tm.ngram_spans(v.utterances), tm.variant_table(glossary(v))))
    return tm.score_candidates(pairs, tm.context_cosine(pairs, *vectors(v)))


@query("d11_fuzzy_terms")
def _(v):
    rows = tm.top_candidates(fuzzy_scored(v), tm.SPAN_KEY)
    return rows.select(*tm.SPAN_KEY, "entry_id", "match_type", "rank", *[F.round(c, 6).alias(c) for c in ("score", "lexical", "phonetic", "semantic")])


@query("h01_candidate_topk", "SELECT meeting_id, utt_idx, char_start, char_end, entry_id, rank FROM v_rk WHERE rank <= 5")
def _(v):
    return ranked(v).select(*tm.SPAN_KEY, "entry_id", "rank")


@query("h07_candidate_cut", "SELECT meeting_id, utt_idx, char_start, char_end, entry_id, rank FROM v_rk WHERE rank <= 3")
def _(v):
    return ranked(v).filter(F.col("rank") <= 3).select(*tm.SPAN_KEY, "entry_id", "rank")


view("v_prop", """SELECT r.meeting_id, r.utt_idx, r.char_start, r.char_end, r.entry_id, r.score, w1.lo, w1.hi,
    row_number() OVER (PARTITION BY r.meeting_id, r.utt_idx ORDER BY r.score DESC, r.char_start - r.char_end, r.char_start, r.entry_id) AS k
    FROM v_rk r JOIN (SELECT r.meeting_id, r.utt_idx, r.char_start, r.char_end, min(w.no) AS lo, max(w.no) AS hi FROM v_rk r
      JOIN v_wof w ON w.meeting_id = r.meeting_id AND w.utt_idx = r.utt_idx AND w.char_start < r.char_end AND w.char_end > r.char_start
      WHERE r.rank = 1 GROUP BY ALL) w1 USING (meeting_id, utt_idx, char_start, char_end) WHERE r.rank = 1""")
view("v_gr", """SELECT meeting_id, utt_idx, unnest(kept) AS s FROM (
    SELECT meeting_id, utt_idx, list_reduce(list_prepend([]::STRUCT(char_start BIGINT, char_end BIGINT, entry_id VARCHAR, lo BIGINT, hi BIGINT)[],
      list([{'char_start': char_start, 'char_end': char_end, 'entry_id': entry_id, 'lo': lo, 'hi': hi}] ORDER BY k)),
      lambda kept, p: CASE WHEN len(list_filter(kept, lambda t: (p[1].char_start < t.char_end AND p[1].char_end > t.char_start)
        OR (p[1].lo <= t.hi AND p[1].hi >= t.lo))) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept
    FROM v_prop GROUP BY ALL)""")


def records(v: Views):
    """Grounded records: the chosen spans of each utterance."""
    def build():
        first = ranked(v).filter(F.col("rank") == 1)
        proposals = first.join(tm.spans_to_words(first, v.utterances), tm.SPAN_KEY)
        return tm.choose_spans(proposals)

    return v.shared("records", build)


@query("h02_greedy_spans", "SELECT meeting_id, utt_idx, s.char_start AS char_start, s.char_end AS char_end, s.entry_id AS entry_id FROM v_gr")
def _(v):
    return records(v).select(*tm.SPAN_KEY, "entry_id")


@query("h02_fuzzy_spans")
def _(v):
    """The chosen spans of each utterance when close forms compete with equal ones."""
    best = tm.top_candidates(v.shared("fuzzy_scored", lambda: fuzzy_scored(v)), tm.SPAN_KEY, 1)
    chosen = tm.choose_spans(best.join(tm.spans_to_words(best, v.utterances), tm.SPAN_KEY))
    return chosen.join(best.select(*tm.SPAN_KEY, "canonical", "match_type", F.round("score", 6).alias("score")), tm.SPAN_KEY).select(
        *tm.SPAN_KEY, "entry_id", "first_word", "last_word", "canonical", "match_type", "score")


@query("j08_suspicious_spans")
def _(v):
    scored = v.shared("fuzzy_scored", lambda: fuzzy_scored(v))
    supplied = scored.filter(F.col("scope") == "meeting").select("meeting_id", "entry_id")
    found = tm.suspicious_spans(scored, supplied)
    return found.select(*tm.SPAN_KEY, F.round("priority", 6).alias("priority"), listed("signals").alias("signals"))


# --- glossary tables ---
@query("e24_glossary_stats", """SELECT category, scope, count(*) AS entries, CAST(count(*) AS BIGINT) AS aliases FROM v_g GROUP BY ALL""")
def _(v):
    return tm.glossary_stats(glossary(v)).withColumn("aliases", F.col("aliases").cast("bigint"))


@query("c04_glossary_rules", """SELECT entry_id, 'unmarked_collision' AS rule FROM v_var WHERE (scope, variant) IN (
    SELECT (scope, variant) FROM v_var GROUP BY scope, variant HAVING count(DISTINCT entry_id) > 1) GROUP BY 1""")
def _(v):
    rows = v.glossary.select(
        "entry_id", "canonical", "category", "scope", F.lit(None).cast("string").alias("sense"),
        F.array("canonical", "asr_alias").alias("variants"), F.array().cast("array<string>").alias("ambiguous"))
    return tm.glossary_violations(rows)


@query("i01_union_layers", """SELECT 'glossary' AS layer, entry_id, canonical FROM v_g
    UNION ALL SELECT 'participants', 'meeting.' || substr(sha256('participants' || s_name), 1, 20), s_name FROM supplier
    UNION ALL SELECT 'companies', 'meeting.' || substr(sha256('companies' || n_name), 1, 20), n_name FROM nation""")
def _(v):
    from dialogue_lake.sources.readers import name_entries

    names = v.table("supplier").select(F.lit("participants").alias("kind"), F.col("s_name").alias("name")).unionByName(
        v.table("nation").select(F.lit("companies").alias("kind"), F.col("n_name").alias("name")))
    return v.glossary.select(F.lit("glossary").alias("layer"), "entry_id", "canonical").unionByName(
        name_entries(names)[0].select(F.col("category").alias("layer"), "entry_id", "canonical"))


@query("i09_glossary_dedup", """SELECT name_key, domain, 'global.' || substr(sha256(name_key), 1, 20) AS entry_id FROM (
    SELECT name_key, min(lang) AS domain FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS name_key
      FROM documents) GROUP BY 1)""")
def _(v):
    lines = v.table("documents").select(
        F.col("lang").alias("domain"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("name_key"))
    return tm.dedup_lines(lines.withColumn("line", F.col("name_key"))).drop("line")


@query("d23_layer_override", """SELECT entry_id, CASE WHEN length(canonical) % 3 = 0 THEN 1.0::DOUBLE ELSE priority END AS priority FROM v_g""")
def _(v):
    base = v.glossary.select("entry_id", "priority")
    own = v.glossary.filter(F.col("scope") == "meeting").select("entry_id", F.lit(1.0).alias("priority"))
    return tm.override_layers([base, own])


CX = """SELECT meeting_id, scope, canonical, 'ctx_' || (utt_idx % 4) AS source_id, priority, utt_idx * 100000 + char_start AS order_no,
    utt_idx % 2 = 1 AS inferred, asr_alias FROM (SELECT e.*, g.canonical, g.asr_alias FROM v_ex e JOIN v_g g USING (entry_id))"""
view("v_cx", CX)


def context_terms(v: Views):
    names = v.glossary.select("entry_id", "asr_alias")
    return exact(v).join(names, "entry_id").select(
        "meeting_id", "scope", "canonical", F.array("asr_alias").alias("aliases"),
        F.concat(F.lit("ctx_"), F.col("utt_idx") % 4).alias("source_id"), "priority",
        (F.col("utt_idx") % 2 == 1).alias("inferred"), (F.col("utt_idx") * 100000 + F.col("char_start")).alias("order_no"))


@query("i06_merge_context_terms", """SELECT meeting_id, scope, canonical, max(priority) AS priority, bool_and(inferred) AS inferred,
    string_agg(DISTINCT asr_alias, ',') AS aliases, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS source_ids
    FROM v_cx GROUP BY meeting_id, scope, canonical""")
def _(v):
    return tm.merge_context_terms(context_terms(v)).select(
        "meeting_id", "scope", "canonical", "priority", "inferred", listed("aliases").alias("aliases"),
        listed(F.array_sort("source_ids")).alias("source_ids"))


@query("d24_attach_sources", """SELECT r.meeting_id, r.utt_idx, r.char_start, r.char_end, r.entry_id,
    concat_ws(',', 'bounded-context cosine', 'context_source:' || g.scope) AS reasons FROM v_rk r JOIN v_g g USING (entry_id) WHERE rank <= 5""")
def _(v):
    sources = v.glossary.select("entry_id", F.array("scope").alias("source_ids"))
    rows = ranked(v).withColumn("reasons", F.array(F.lit("bounded-context cosine")))
    return tm.attach_sources(rows, sources).select(*tm.SPAN_KEY, "entry_id", listed("reasons").alias("reasons"))


view("v_voc", """SELECT meeting_id, window_no, entry_id, canonical, row_number() OVER (PARTITION BY meeting_id, window_no ORDER BY
      supplied DESC, scope_score DESC, score DESC, entry_id) AS rank FROM (
    SELECT r.meeting_id, r.utt_idx // 2 AS window_no, r.entry_id, g.canonical, g.scope = 'meeting' AS supplied, r.scope_score,
      max(r.score) AS score FROM v_rk r JOIN v_g g USING (entry_id) WHERE rank <= 5 GROUP BY ALL)""")


def vocabulary(v: Views):
    rows = ranked(v).join(v.glossary.select("entry_id", "canonical", (F.col("scope") == "meeting").alias("supplied")), "entry_id")
    rows = rows.withColumn("window_no", F.floor(F.col("utt_idx") / 2).cast("bigint"))
    return tm.window_vocabulary(rows, ["meeting_id", "window_no"])


@query("h03_window_vocabulary", "SELECT meeting_id, window_no, rank, entry_id, canonical FROM v_voc WHERE rank <= 6")
def _(v):
    return vocabulary(v)


@query("j09_pack_vocabulary", """SELECT meeting_id, window_no, count(*) AS kept,
    'Possible vocabulary: ' || string_agg(canonical, ', ' ORDER BY rank) || '.' AS prompt FROM v_voc WHERE rank <= 6 GROUP BY ALL""")
def _(v):
    return tm.pack_vocabulary(vocabulary(v), ["meeting_id", "window_no"])


view("v_case", """SELECT c.entry_id AS case_id, r.entry_id, row_number() OVER (PARTITION BY c.entry_id ORDER BY r.scope_score DESC, r.entry_id) AS rank
    FROM v_g c JOIN (SELECT DISTINCT entry_id, variant, """ + SCOPE_SQL + """::DOUBLE AS scope_score FROM v_var) r ON r.variant = c.asr_alias""")


@query("e15_retrieval_metrics", """SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1,
    round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
    round(avg(1.0 / rank), 6) AS mrr FROM v_case WHERE case_id = entry_id""")
def _(v):
    from dialogue_lake.operators import metrics

    forms = tm.variant_table(glossary(v))
    cases = v.glossary.select(F.col("entry_id").alias("case_id"), F.col("entry_id").alias("expected"), F.col("asr_alias").alias("variant"))
    found = cases.join(forms.select("variant", "entry_id", tm.scope_score(F.col("scope"), F.col("priority")).alias("scope_score")).distinct(), "variant")
    hits = tm.top_candidates(found.withColumn("score", F.lit(1.0)), ["case_id"], 5)
    return metrics.retrieval_metrics(cases, hits.select("case_id", "entry_id", "rank"))

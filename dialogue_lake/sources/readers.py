"""Typed readers for saved stage documents, glossaries, context files and truth files."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogue_lake.sources import strict

SCHEMA_VERSION = "1.0"
BAD = "_bad"

ASR_SCHEMA = (
    "meeting_id BIGINT, chunk BIGINT, offset_ms BIGINT, duration DOUBLE, text STRING, language STRING, "
    "language_probability DOUBLE, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, avg_logprob: DOUBLE, "
    "no_speech_prob: DOUBLE, compression_ratio: DOUBLE>>, words ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE>>"
)
GLOSSARY_SCHEMA = (
    "id STRING, canonical STRING, category STRING, domain STRING, description STRING, aliases ARRAY<STRING>, "
    "asr_aliases ARRAY<STRING>, ambiguous_aliases ARRAY<STRING>, symbols ARRAY<STRING>, acronym_expansion STRING, "
    "source STRING, priority DOUBLE, requires_context BOOLEAN, safe_normalization BOOLEAN, sense STRING"
)
TRUTH_SCHEMA = (
    "duration_seconds DOUBLE, audio_sha256 STRING, reference_kind STRING, verified_acoustic_annotations BOOLEAN, "
    "segments ARRAY<STRUCT<speaker_id: STRING, start: DOUBLE, end: DOUBLE>>, word_events ARRAY<STRUCT<speaker_id: STRING, time_seconds: DOUBLE, text: STRING>>"
)
MEDIA_SCHEMA = (
    "streams ARRAY<STRUCT<`index`: INT, codec_type: STRING, codec_name: STRING, sample_rate: STRING, channels: INT, "
    "bits_per_sample: INT, duration: STRING, duration_ts: BIGINT, time_base: STRING, disposition: STRUCT<`default`: INT>>>, "
    "format STRUCT<format_name: STRING, duration: STRING>"
)


def name_entries(names: DataFrame, max_chars: int = 120) -> tuple[DataFrame, DataFrame]:
    """Meeting-scoped glossary entries for names of people, companies and projects.

    ``names`` has ``kind`` and ``name``. The second result holds the names refused: blank
    (or missing) ones and those over ``max_chars``, with the reason.
    """
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "blank_name").when(F.length("name") > max_chars, "name_too_long")
    judged = names.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).select(
        F.concat(F.lit("meeting."), F.substring(F.sha2(F.concat("kind", "name"), 256), 1, 20)).alias("entry_id"),
        F.col("name").alias("canonical"), F.col("kind").alias("category"), F.lit("meeting").alias("scope"),
        F.lit(1.0).alias("priority"))
    return good, judged.filter(F.col("reason").isNotNull()).select("kind", "name", "reason")


def read_stage(spark: SparkSession, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved stage rows as JSON lines, and the lines that are not exactly of the schema.

    A row must parse, have no missing, unknown or repeated field on any level, no value of
    another type, no number that is not finite, and schema version 1.0. Every departure is a
    row (``line, path, rule``).
    """
    shape = strict.shape_of(schema)
    if "schema_version" in schema.names:
        shape.add("$.schema_version", "string", values=(SCHEMA_VERSION,))
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    bad = strict.violations(rows.distinct(), ["line"], "line", shape)
    good = rows.join(bad.select("line").distinct(), "line", "left_anti").select(F.from_json("line", schema).alias("_row")).select("_row.*")
    return good, bad


#: Fields that a recogniser may leave out.
ASR_OPTIONAL = (
    "$.chunk", "$.offset_ms", "$.duration", "$.language", "$.language_probability", "$.segments", "$.words", "$.segments[].avg_logprob",
    "$.segments[].no_speech_prob", "$.segments[].compression_ratio")


def scan_asr_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved recogniser answers (one JSON object per chunk) as segments, words, violations.

    Times are shifted by the chunk offset and become whole milliseconds. An answer that is
    not of the form is a violation with the place in the text and gives no rows; answers may
    have further fields.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    shape = strict.shape_of(T._parse_datatype_string(ASR_SCHEMA), ASR_OPTIONAL)
    for item in ("$.segments[]", "$.words[]"):
        for edge in ("start", "end"):
            shape.add(f"{item}.{edge}", "number")
        shape.add(f"{item}.{'text' if 'segments' in item else 'word'}", "string")
    shape.add("$.text", "string")
    departs = strict.violations(lines.distinct(), ["line"], "line", shape).filter(F.col("rule") != "unknown_field")
    named = F.from_json("line", "meeting_id bigint, chunk bigint")
    malformed = departs.select(named.alias("_k"), "path", "rule").select("_k.meeting_id", "_k.chunk", "path", "rule")
    good = lines.join(departs.select("line").distinct(), "line", "left_anti").select(F.from_json("line", ASR_SCHEMA).alias("_a")).select("_a.*")
    segments, words, bad = explode_asr(good)
    return segments, words, bad.unionByName(malformed)


def explode_asr(chunks: DataFrame, chunk_seconds: float = 600.0, slack: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, words and violations (``meeting_id, chunk, path, rule``) of answers.

    A time must not be negative, before its own start, before the start of the item ahead of
    it, or more than ``slack`` seconds after the audio.
    """
    key = ["meeting_id", "chunk"]
    at = lambda seconds: (F.round(seconds * 1000) + F.col("offset_ms")).cast("bigint")
    segments = chunks.select(*key, "offset_ms", F.posexplode("segments").alias("seg_no", "s")).select(
        *key, F.col("seg_no").cast("bigint").alias("seg_no"), at(F.col("s.start")).alias("start_ms"), at(F.col("s.end")).alias("end_ms"),
        F.col("s.text").alias("text"), F.col("s.avg_logprob").alias("avg_logprob"))
    words = chunks.select(*key, "offset_ms", F.posexplode("words").alias("word_no", "w")).select(
        *key, F.col("word_no").cast("bigint").alias("word_no"), at(F.col("w.start")).alias("start_ms"), at(F.col("w.end")).alias("end_ms"),
        F.col("w.word").alias("text"))
    length = F.coalesce(F.col("chunk_seconds") if "chunk_seconds" in chunks.columns else F.lit(None), F.lit(chunk_seconds))
    spoken = F.trim("text") != ""
    rules = F.array_compact(F.array(
        F.when(F.abs(F.col("duration") - length) > F.greatest(F.lit(1.0), length * 0.02), "wrong_duration"),
        F.when(spoken & (F.coalesce(F.size("segments"), F.lit(0)) < 1), "missing_segments"),
        F.when(spoken & (F.coalesce(F.size("words"), F.lit(0)) < 1), "missing_words"),
        F.when((F.coalesce(F.size("segments"), F.lit(0)) < 1) & (F.coalesce(F.size("words"), F.lit(0)) > 0), "words_without_segments")))
    bad = chunks.select(*key, F.lit("$").alias("path"), F.explode(rules).alias("rule"))
    for name, other in (("segments", "segments_out_of_order"), ("words", "words_out_of_order")):
        items = F.col(name)
        timed = F.transform(items, lambda x, i: F.struct(  # noqa: B023
            i.alias("i"), x["start"].alias("start"), x["end"].alias("end"),
            F.when(i > 0, F.get(items, i - 1)["start"]).alias("before")))  # noqa: B023
        rows = chunks.select(*key, length.alias("_length"), F.inline(timed))
        finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        start, end = F.col("start"), F.col("end")
        whole = finite(start) & finite(end)
        rules = F.array_compact(F.array(
            F.when(~whole, "not_finite"), F.when(whole & (start < 0), "negative_time"), F.when(whole & (end < start), "ends_before_start"),
            F.when(whole & (end > F.col("_length") + slack), "outside_audio"), F.when(start < F.col("before"), other)))
        bad = bad.unionByName(rows.select(
            *key, F.concat(F.lit(f"$.{name}["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.explode(rules).alias("rule")))
    return segments, words, bad


def merge_chunks(segments: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments renumbered over all chunks, and one transcript row per meeting.

    A language is kept only when every chunk names it; its probability only for a single
    chunk. Text stays one piece per chunk, in order.
    """
    from dialogue_lake.operators import ordered

    numbered = ordered.scan(
        segments, ["meeting_id"], ["chunk", "start_ms", "seg_no"], ordered.bucket_of("chunk", 16), [ordered.numbered("n")]
    ).withColumn("segment_id", F.format_string("seg_%06d", "n"))
    named = F.coalesce("language", F.lit(""))
    whole = chunks.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.when(F.count_distinct(named) == 1, F.max("language")).alias("language"),
        F.when(F.count(F.lit(1)) == 1, F.max("language_probability")).alias("language_probability"),
        F.sum(F.length("text")).alias("chars"))
    return numbered, whole


def plan_chunks(recordings: DataFrame, seconds: int = 600, max_bytes: int = 25_000_000, rate: int = 16_000) -> DataFrame:
    """Frame ranges of each recording, limited in time and in bytes of 16-bit audio."""
    step = min(seconds * rate, (max_bytes - 44) // 2)
    return recordings.filter(F.col("frames") > 0).select(
        "meeting_id", "frames", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1, F.lit(step).cast("bigint"))).alias("_n", "first_frame")
    ).select(
        "meeting_id", F.col("_n").cast("bigint").alias("chunk"), "first_frame",
        F.least(F.lit(step).cast("bigint"), F.col("frames") - F.col("first_frame")).alias("n_frames"))


def read_glossary(spark: SparkSession, path: str, scope: str, max_chars: int = 32_000) -> tuple[DataFrame, DataFrame]:
    """Entries of one layer from JSON lines, and lines that are bad or of another scope."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("_e", F.from_json("value", GLOSSARY_SCHEMA))
    fine = (F.length("value") <= max_chars) & F.col("_e.id").isNotNull() & (F.col("_e.source") == scope)
    marked = rows.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    return marked.filter("_ok").select("_e.*"), marked.filter("NOT _ok").select(F.col("value").alias("line"))


def read_context_documents(spark: SparkSession, folder: str, max_chars: int = 262_144) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supplied text and term files of a folder and its subfolders.

    Returns free texts (``source_id, sha, text``) from TXT, MD and JSON, explicit terms
    (``source_id, canonical, aliases, category, scope``) from JSON and CSV, and the files
    refused (``source_id, reason``): texts over ``max_chars`` and JSON that is no object.
    ``source_id`` is the path below the folder.
    """
    whole = lambda glob: spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    below = quote(re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", folder).rstrip("/"))
    source = F.coalesce(F.try_element_at(F.split(F.input_file_name(), rf"\Q{below}/\E", 2), F.lit(2)), F.input_file_name())
    texts = whole("*.{txt,md}").select(source.alias("source_id"), F.col("value").alias("text"))
    json_schema = "text STRING, terms ARRAY<STRUCT<canonical: STRING, aliases: ARRAY<STRING>, category: STRING, scope: STRING>>"
    documents = whole("*.json").select(
        source.alias("source_id"), F.from_json("value", json_schema).alias("_d"), F.json_object_keys("value").isNull().alias("_broken"))
    free = texts.unionByName(documents.select("source_id", F.col("_d.text").alias("text")).filter(F.col("text").isNotNull()))
    rejected = free.filter(F.length("text") > max_chars).select("source_id", F.lit("text_too_long").alias("reason")).unionByName(
        documents.filter("_broken").select("source_id", F.lit("broken_json").alias("reason")))
    free = free.filter(F.length("text") <= max_chars).withColumn("sha", F.sha2("text", 256))
    listed = documents.select("source_id", F.explode("_d.terms").alias("_t")).select("source_id", "_t.*")
    rows = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").option("header", "true").schema(
        "canonical STRING, aliases STRING, category STRING, scope STRING").csv(folder)
    from_csv = rows.select(
        source.alias("source_id"), "canonical",
        F.array_remove(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.trim(a)), "").alias("aliases"), "category", "scope")
    return free, listed.unionByName(from_csv), rejected


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Speaker lines of RTTM truth files in whole milliseconds."""
    parts = F.split(F.trim("value"), r"\s+")
    ms = lambda c: F.round(c.cast("double") * 1000).cast("bigint")
    rows = spark.read.text(path).filter(F.col("value").startswith("SPEAKER")).select(parts.alias("p"))
    start = ms(F.col("p")[3])
    return rows.select(
        F.col("p")[1].alias("recording"), F.col("p")[7].alias("speaker_id"), start.alias("start_ms"), (start + ms(F.col("p")[4])).alias("end_ms"))


def read_timed_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Timed truth documents, one JSON file a recording: segments, word events, rejects.

    The recording is the file's name without its ending. A document that is not of the form
    gives no rows; a segment that is empty, negative or beyond the duration and a word event
    outside the recording are refused alone. Rejects are ``recording, path, rule``.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)
    texts = spark.read.text(path, wholetext=True).select(name.alias("recording"), F.col("value").alias("text"))
    shape = strict.Shape().add("$", "object").add("$.duration_seconds", "number").add("$.audio_sha256", "string").add("$.reference_kind", "string")
    shape.add("$.verified_acoustic_annotations", "boolean").add("$.segments", "array").add("$.segments[]", "object").add("$.word_events", "array", required=False)
    shape.add("$.segments[].speaker_id", "string", filled=True).add("$.segments[].start", "number").add("$.segments[].end", "number").add("$.word_events[]", "object")
    shape.add("$.word_events[].speaker_id", "string", filled=True).add("$.word_events[].time_seconds", "number").add("$.word_events[].text", "string")
    bad = strict.violations(texts, ["recording"], "text", shape).filter(F.col("rule") != "unknown_field")
    parsed = texts.join(bad.select("recording").distinct(), "recording", "left_anti").select("recording", F.from_json("text", TRUTH_SCHEMA).alias("t"))
    ms = lambda c: F.round(c * 1000).cast("bigint")
    verified = F.col("t.verified_acoustic_annotations").alias("verified")
    segments = parsed.select("recording", verified, ms(F.col("t.duration_seconds")).alias("_d"), F.posexplode("t.segments").alias("_n", "s")).select(
        "recording", "verified", "_d", "_n", F.col("s.speaker_id").alias("speaker_id"), ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"))
    words = parsed.select("recording", verified, ms(F.col("t.duration_seconds")).alias("_d"), F.posexplode("t.word_events").alias("_n", "w")).select(
        "recording", "verified", "_d", "_n", F.col("w.speaker_id").alias("speaker_id"), ms(F.col("w.time_seconds")).alias("time_ms"), F.col("w.text").alias("text"))
    wrong_segment = F.when(F.col("start_ms") < 0, "negative_time").when(F.col("end_ms") <= F.col("start_ms"), "ends_before_start").when(
        F.col("end_ms") > F.col("_d"), "outside_audio")
    wrong_word = F.when(F.col("time_ms") < 0, "negative_time").when(F.col("time_ms") > F.col("_d"), "outside_audio")
    judged = [(segments.withColumn("rule", wrong_segment), "segments"), (words.withColumn("rule", wrong_word), "word_events")]
    for rows, part in judged:
        place = F.concat(F.lit(f"$.{part}["), F.col("_n").cast("string"), F.lit("]")).alias("path")
        bad = bad.unionByName(rows.filter(F.col("rule").isNotNull()).select("recording", place, "rule"))
    good = [rows.filter(F.col("rule").isNull()).drop("rule", "_d", "_n") for rows, _ in judged]
    return good[0], good[1], bad


def check_media(manifest: DataFrame, minimum_seconds: float = 0.1, tolerance_seconds: float = 0.25, tolerance_ratio: float = 0.01) -> DataFrame:
    """Chosen audio stream, its duration and the canonical-format checks.

    ``manifest``: ``meeting_id, probe`` (saved probe JSON) and ``source_seconds``.
    """
    p = F.from_json("probe", MEDIA_SCHEMA)
    audio = F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == "audio")
    preferred = F.filter(audio, lambda s: s["disposition"]["default"] == 1)
    stream = F.coalesce(F.get(preferred, F.lit(0)), F.get(audio, F.lit(0)))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    base = F.split("_s.time_base", "/")
    ticks = F.col("_s.duration_ts") * F.try_divide(base[0].cast("double"), base[1].cast("double"))
    rows = manifest.withColumn("_p", p).withColumn("_s", stream)
    own = F.coalesce(number("_s.duration"), ticks)
    rows = rows.withColumns({
        "duration_seconds": F.coalesce(own, number("_p.format.duration")),
        "duration_source": F.when(own.isNotNull(), "stream").when(number("_p.format.duration").isNotNull(), "container").otherwise("unknown")})
    duration = F.col("duration_seconds")
    canonical = (
        (F.col("_p.format.format_name") == "wav") & (F.col("_s.codec_name") == "pcm_s16le")
        & (F.col("_s.sample_rate").cast("int") == 16_000) & (F.col("_s.channels") == 1) & (F.col("_s.bits_per_sample") == 16))
    allowed = F.greatest(F.lit(tolerance_seconds), F.col("source_seconds") * tolerance_ratio)
    return rows.select(
        "meeting_id", F.col("_s.index").cast("bigint").alias("stream_index"), duration.alias("duration_seconds"), "duration_source",
        F.col("_s").isNotNull().alias("has_audio"), F.coalesce(canonical, F.lit(False)).alias("canonical"),
        F.coalesce(duration >= minimum_seconds, F.lit(False)).alias("long_enough"),
        F.coalesce(F.abs(duration - F.col("source_seconds")) <= allowed, F.lit(False)).alias("same_duration"))

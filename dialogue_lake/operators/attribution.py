"""Who said what: timed words against exclusive speaker turns, then utterances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.operators.intervals import overlap_ms, range_collect, range_join


@dataclass(frozen=True)
class AttributionRules:
    tolerance_ms: int = 100
    nearest_ms: int = 200
    utterance_gap_ms: int = 1000


def attribute(
    spans: DataFrame,
    turns: DataFrame,
    ids: list[str],
    rules: AttributionRules = AttributionRules(),
) -> DataFrame:
    """Speaker of each span by overlap, then padded overlap, then nearest turn.

    ``ids`` identify a span within its meeting. One range join finds every turn close
    enough for any of the three methods, and the choice is made on that short array. Turns
    must be exclusive, so at most one turn on either side can be nearest.
    """
    reach, pad = max(rules.tolerance_ms, rules.nearest_ms), rules.tolerance_ms
    start, end, ts, te = F.col("start_ms"), F.col("end_ms"), F.col("_ts"), F.col("_te")
    point = start == end
    near = range_collect(
        spans,
        turns.select(
            "meeting_id", F.col("turn_id").alias("_turn"), F.col("speaker_id").alias("_who"),
            F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te"),
        ),
        ids,
        (start - reach, end + reach),
        (ts, te),
        (ts <= end + reach) & (te >= start - reach),
        F.struct(
            ts.alias("at"),
            F.col("_who").alias("who"),
            F.col("_turn").alias("turn_id"),
            F.when(point, ((ts <= start) & (start < te)).cast("bigint"))
            .otherwise(overlap_ms(start, end, ts, te)).alias("direct"),
            (overlap_ms(start - pad, end + pad, ts, te) if pad else F.lit(0).cast("bigint")).alias("padded"),
            F.greatest(ts - end, start - te, F.lit(0)).alias("gap"),
        ),
        "_near",
    )

    def most(field: str) -> Column:
        """Speaker with the largest total; ties go to the earliest turn, then the label."""
        hits = F.filter("_near", lambda t: t[field] > 0)
        total = lambda who: F.aggregate(
            hits, F.lit(0).cast("bigint"),
            lambda sum_, t: sum_ + F.when(t["who"] == who, t[field]).otherwise(0))
        ranked = F.transform(
            hits, lambda t: F.struct((-total(t["who"])).alias("m"), t["at"].alias("at"), t["who"].alias("who")))
        return F.array_min(ranked)

    def turns_of(field: str, who: Column) -> Column:
        mine = F.filter("_near", lambda t: (t[field] > 0) & (t["who"] == who))
        return F.transform(mine, lambda t: t["turn_id"])

    close = F.filter("_near", lambda t: F.lit(rules.nearest_ms > 0) & (t["gap"] <= rules.nearest_ms))
    nearest = F.array_min(F.transform(
        close, lambda t: F.struct(t["gap"].alias("gap"), t["at"].alias("at"), t["who"].alias("who"), t["turn_id"].alias("turn_id"))))
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    return (
        near.withColumns({"_a": most("direct"), "_b": most("padded"), "_c": nearest})
        .withColumn("speaker_id", F.coalesce(a["who"], b["who"], c["who"]))
        .withColumn(
            "method",
            F.when(a.isNotNull(), "overlap").when(b.isNotNull(), "tolerance")
            .when(c.isNotNull(), "nearest").otherwise("unknown"))
        .withColumn(
            "overlap_fraction",
            F.when(~point, F.when(a.isNotNull(), F.least(F.lit(1.0), -a["m"] / (end - start))).otherwise(0.0)))
        .withColumn(
            "source_turn_ids",
            F.when(a.isNotNull(), turns_of("direct", a["who"]))
            .when(b.isNotNull(), turns_of("padded", b["who"]))
            .when(c.isNotNull(), F.array(c["turn_id"]))
            .otherwise(F.array().cast("array<string>")))
        .drop("_near", "_a", "_b", "_c")
    )


def attribute_words(words: DataFrame, turns: DataFrame, rules=AttributionRules()) -> DataFrame:
    return attribute(words, turns, ["segment_id", "word_index"], rules)


def attribute_wordless_segments(
    segments: DataFrame, words: DataFrame, turns: DataFrame, rules=AttributionRules()
) -> DataFrame:
    """Segments without any word are attributed as a whole."""
    bare = segments.join(words.select("meeting_id", "segment_id").distinct(), ["meeting_id", "segment_id"], "left_anti")
    found = attribute(bare, turns, ["segment_id"], rules)
    return found.withColumn(
        "method",
        F.when(F.col("method") == "unknown", "unknown").otherwise(F.concat(F.lit("segment_"), "method")),
    )


def flag_overlap(spans: DataFrame, regions: DataFrame, ids: list[str]) -> DataFrame:
    """Does the span touch any overlap region; a point uses half-open containment."""
    start, end, rs, re = F.col("start_ms"), F.col("end_ms"), F.col("_rs"), F.col("_re")
    touching = range_collect(
        spans,
        regions.select("meeting_id", F.col("start_ms").alias("_rs"), F.col("end_ms").alias("_re")),
        ids,
        (start, end),
        (rs, re),
        F.when(start == end, (rs <= start) & (start < re)).otherwise((rs < end) & (re > start)),
        rs,
        "_hits",
    )
    return touching.withColumn("overlap_present", F.size("_hits") > 0).drop("_hits")


#: Words of one segment whose text is rendered at once.
WORDS_A_PIECE = 1024


def utterance_words(
    words: DataFrame,
    bare_segments: DataFrame | None = None,
    rules=AttributionRules(),
    segments_per_bucket: int = 256,
) -> DataFrame:
    """Attributed words with ``utterance_no``: runs cut at a speaker change or a silence.

    The silence is measured from the end of the previous word, not from the furthest end
    so far. A segment without words is an utterance of its own (``word_index`` of -1).
    """
    columns = [
        "meeting_id", "seg_idx", "segment_id", "word_index", "start_ms", "end_ms", "text",
        "speaker_id", "overlap_present",
    ]
    rows = words.select(*columns, F.lit(None).cast("string").alias("method"))
    if bare_segments is not None:
        rows = rows.unionByName(
            bare_segments.withColumn("word_index", F.lit(-1).cast(words.schema["word_index"].dataType))
            .select(*columns, "method")
        )
    order = ["seg_idx", "word_index"]

    def is_new(before, now):
        return (
            (before("word_index") < 0)
            | (now("word_index") < 0)
            | ~before("speaker_id").eqNullSafe(now("speaker_id"))
            | (now("start_ms") - before("end_ms") > rules.utterance_gap_ms)
        )

    return ordered.islands(
        rows, ["meeting_id"], order, ordered.bucket_of("seg_idx", segments_per_bucket),
        ["word_index", "speaker_id", "start_ms", "end_ms"], is_new, out="utterance_no",
    )


def assemble_utterances(
    words: DataFrame,
    bare_segments: DataFrame | None = None,
    rules=AttributionRules(),
    segments_per_bucket: int = 256,
) -> DataFrame:
    """The utterances of attributed words and of segments without any."""
    marked = utterance_words(words, bare_segments, rules, segments_per_bucket)
    order = ["seg_idx", "word_index"]
    # Text is put together in two steps, so that a monologue is never one array of words:
    # a piece holds words of one segment, an utterance its pieces.
    said = F.array_sort(F.collect_list(F.struct("word_index", "text")))
    pieces = marked.groupBy("meeting_id", "utterance_no", "seg_idx", F.floor(F.col("word_index") / WORDS_A_PIECE).alias("_q")).agg(
        F.first("speaker_id").alias("speaker_id"),
        tx.render_words(F.transform(said, lambda w: w["text"])).alias("_text"),
        F.first("segment_id").alias("segment_id"),
        F.min(F.struct(*order, "start_ms")).alias("_start"),
        F.max("end_ms").alias("end_ms"),
        F.bool_or("overlap_present").alias("overlap_present"),
        F.max("method").alias("method"),
    )
    place = F.struct(F.col("_start")["seg_idx"].alias("s"), F.col("_start")["word_index"].alias("w"), F.col("_text").alias("t"))
    sources = F.array_sort(F.collect_set(F.struct("seg_idx", "segment_id")))
    return (
        pieces.groupBy("meeting_id", "utterance_no")
        .agg(
            F.first("speaker_id").alias("speaker_id"),
            F.min("_start")["start_ms"].alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            tx.render_words(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["t"])).alias("text"),
            F.transform(sources, lambda s: s["segment_id"]).alias("source_segment_ids"),
            F.bool_or("overlap_present").alias("overlap_present"),
            F.max("method").alias("method"),
        )
        .select(
            "meeting_id", "utterance_no", F.format_string("utt_%06d", F.col("utterance_no")).alias("utterance_id"),
            "speaker_id", "start_ms", "end_ms", "text", "source_segment_ids", "overlap_present", "method",
        )
    )


def speaker_switches(utterances: DataFrame, number: str = "utterance_no") -> DataFrame:
    """Changes of speaker between consecutive utterances with a known speaker."""
    known = utterances.filter(F.col("speaker_id").isNotNull()).select("meeting_id", number, "speaker_id")
    before = ordered.scan(
        known, ["meeting_id"], [number], ordered.bucket_of(number, 4096),
        [ordered.previous("_before", F.col("speaker_id"))],
    )
    return before.groupBy("meeting_id").agg(
        F.count_if(F.col("_before") != F.col("speaker_id")).alias("speaker_switches")
    )


def reconciliation_info(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """Words by method, fallbacks, switches, coverage (null when there is no word)."""
    counted = lambda name: F.count_if(F.col("method") == name)
    by_word = words.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("total_words"),
        counted("overlap").alias("direct_words"),
        counted("tolerance").alias("tolerance_words"),
        counted("nearest").alias("nearest_words"),
        counted("unknown").alias("unknown_words"),
    )
    by_utterance = utterances.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("utterances"),
        F.count("method").alias("segment_fallbacks"),
    )
    return (
        by_utterance.join(by_word, "meeting_id", "left")
        .join(speaker_switches(utterances), "meeting_id", "left")
        .na.fill(0)
        .withColumn(
            "coverage",
            F.round(F.try_divide(F.col("total_words") - F.col("unknown_words"), F.col("total_words")), 6),
        )
    )


def label_speakers(turns: DataFrame) -> DataFrame:
    """Anonymous labels numbered by first (start, end, label) over all layers."""
    first = turns.groupBy("meeting_id", "speaker_id").agg(
        F.min(F.struct("start_ms", "end_ms", "speaker_id")).alias("_first")
    )
    from pyspark.sql import Window

    # One row per speaker of a meeting, so this window stays small.
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1
    return first.select(
        "meeting_id", "speaker_id", F.format_string("SPEAKER_%02d", rank).alias("label")
    )


def words_to_segments(words: DataFrame, segments: DataFrame, slack_ms: int = 500) -> DataFrame:
    """Best compatible segment per word, never moving backwards within a chunk.

    Compatible means inside the segment widened by the slack; best means largest overlap,
    then nearest centre, then the earlier segment. A choice may not go back behind the
    segment of any earlier word.

    Where the best segment of a word is no earlier than every segment an earlier word could
    have taken, it is taken whatever was chosen before. Such words cut a chunk into runs that
    do not depend on each other; only inside a run are words folded in order.
    """
    start, end, ss, se = F.col("start_ms"), F.col("end_ms"), F.col("_ss"), F.col("_se")
    near = range_join(
        words.select("meeting_id", "chunk", "word_no", "start_ms", "end_ms"),
        segments.select(
            "meeting_id", "chunk", F.col("seg_idx").alias("_seg"),
            F.col("start_ms").alias("_ss"), F.col("end_ms").alias("_se"),
        ),
        ["meeting_id", "chunk"],
        (start, end),
        (ss - slack_ms, se + slack_ms),
        (start >= ss - slack_ms) & (end <= se + slack_ms),
    )
    option = F.struct(
        (-overlap_ms(start, end, ss, se)).alias("o"),
        F.abs((start + end) - (ss + se)).alias("d"),
        F.col("_seg").alias("seg_idx"),
    )
    options = near.groupBy("meeting_id", "chunk", "word_no").agg(
        F.array_sort(F.collect_list(option)).alias("options")
    )
    def advance(state: Column, word: Column) -> Column:
        cursor = F.coalesce(F.try_element_at(state, F.lit(-1))["seg_idx"], F.lit(-1).cast("bigint"))
        allowed = F.filter(word["options"], lambda o: o["seg_idx"] >= cursor)
        pick = F.get(allowed, F.lit(0))["seg_idx"]
        return F.concat(
            state,
            F.array(
                F.struct(
                    word["word_no"].alias("word_no"),
                    F.coalesce(pick, cursor).alias("seg_idx"),
                    pick.isNotNull().alias("compatible"),
                )
            ),
        )

    empty = F.expr("cast(array() as array<struct<word_no:bigint,seg_idx:bigint,compatible:boolean>>)")
    furthest = F.array_max(F.transform("options", lambda o: o["seg_idx"]))
    bucket = ordered.bucket_of("word_no", 1 << 16)
    key, order = ["meeting_id", "chunk"], ["word_no"]
    reached = ordered.scan(options, key, order, bucket, [ordered.running_max("_reached", furthest)])
    settled = F.coalesce(F.get("options", F.lit(0))["seg_idx"] >= F.col("_reached"), F.lit(True))
    runs = ordered.scan(
        reached.withColumn("_cut", settled.cast("bigint")), key, order, bucket, [ordered.running_sum("_run", F.col("_cut"))])
    folded = runs.groupBy("meeting_id", "chunk", "_run").agg(
        F.array_sort(F.collect_list(F.struct("word_no", "options"))).alias("w")
    )
    picked = folded.select(
        "meeting_id", "chunk", F.inline(F.aggregate("w", empty, advance))
    )
    return words.join(picked, ["meeting_id", "chunk", "word_no"], "left").withColumn(
        "compatible", F.coalesce("compatible", F.lit(False))
    )

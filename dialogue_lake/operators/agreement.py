"""Two speaker segmentations of the same meetings, compared over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.functions.similarity import assign_rows
from dialogue_lake.operators.intervals import (
    active_sets,
    boundaries,
    coalesce_intervals,
    elementary_intervals,
    home_join,
    overlap_ms,
    range_join,
    union_intervals,
)
from dialogue_lake.operators.lookup import spread_join

FRACTIONS = [
    "agreement", "disagreement", "primary_only", "secondary_only", "silence",
    "primary_overlap", "secondary_overlap", "overlap_agreement", "unmapped",
]


@dataclass(frozen=True)
class ReliabilityRules:
    reliable: float = 0.90
    mixed: float = 0.65
    low_overlap: float = 0.10
    shared: float = 0.20


def timeline(layered: DataFrame, durations: DataFrame) -> DataFrame:
    """Each meeting from zero to its duration, cut wherever any layer changes."""
    clipped = (
        spread_join(layered, durations, ["meeting_id"], F.col("start_ms"), "inner")
        .withColumn("start_ms", F.least("start_ms", "duration_ms"))
        .withColumn("end_ms", F.least("end_ms", "duration_ms"))
        .filter(F.col("end_ms") > F.col("start_ms"))
        .drop("duration_ms")
    )
    edges = durations.select(
        "meeting_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("duration_ms"))).alias("at_ms")
    )
    cells = elementary_intervals(boundaries(clipped, ["meeting_id"]).unionByName(edges), ["meeting_id"])
    return active_sets(
        cells, clipped, {"regular": "regular", "exclusive": "exclusive", "secondary": "secondary"}
    )


def overlap_matrix(cells: DataFrame) -> DataFrame:
    """Shared milliseconds of every (secondary, primary) pair that meets at all."""
    length = F.col("end_ms") - F.col("start_ms")
    return (
        cells.select("meeting_id", length.alias("ms"), "regular", F.explode("secondary").alias("secondary_id"))
        .select("meeting_id", "ms", "secondary_id", F.explode("regular").alias("primary_id"))
        .groupBy("meeting_id", "secondary_id", "primary_id")
        .agg(F.sum("ms").alias("overlap_ms"))
    )


def speaking_totals(cells: DataFrame) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    side = lambda column, name: cells.select(
        "meeting_id", F.lit(name).alias("side"), length.alias("ms"), F.explode(column).alias("speaker_id")
    )
    return (
        side("regular", "primary").unionByName(side("secondary", "secondary"))
        .groupBy("meeting_id", "side", "speaker_id").agg(F.sum("ms").alias("total_ms"))
    )


def assign_speakers(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """One-to-one map with the largest shared time; one row per secondary speaker.

    ``labels`` has ``meeting_id, side, speaker_id``. A meeting has few labels, so its
    matrix is one small array; the choice is exact for any number of them.
    """
    cell_key = lambda s, p: F.concat(s, F.lit("\u0001"), p)
    sides = labels.groupBy("meeting_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("side") == "primary", F.col("speaker_id")))).alias("ps"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "secondary", F.col("speaker_id")))).alias("ss"),
    )
    cells = matrix.groupBy("meeting_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(cell_key(F.col("secondary_id"), F.col("primary_id")), "overlap_ms"))
        ).alias("cells")
    )
    none = F.lit(0).cast("bigint")
    table = F.transform(
        "ss",
        lambda s: F.transform(
            "ps", lambda p: F.coalesce(F.try_element_at(F.col("cells"), cell_key(s, p)), none)
        ),
    )
    solved = (
        sides.join(cells, "meeting_id", "left")
        .filter(F.size("ss") > 0)
        .select("meeting_id", "ss", "ps", table.alias("table"))
        .withColumn("pick", assign_rows("table"))
        .select("meeting_id", "ps", F.explode(F.arrays_zip("ss", "pick", "table")).alias("r"))
    )
    pick = F.col("r.pick")
    return solved.select(
        "meeting_id",
        F.col("r.ss").alias("secondary_id"),
        F.when(pick >= 0, F.get(F.col("ps"), pick)).alias("primary_id"),
        F.when(pick >= 0, F.get(F.col("r.table"), pick)).otherwise(0).alias("overlap_ms"),
    )


def mapping_arrays(mapping: DataFrame) -> DataFrame:
    """One map per meeting, a few labels long."""
    return (
        mapping.filter(F.col("primary_id").isNotNull())
        .groupBy("meeting_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("secondary_id", "primary_id"))).alias("label_map"))
    )


def map_secondary(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sorted mapped labels of the secondary speakers of each interval."""
    joined = spread_join(cells, mapping_arrays(mapping), ["meeting_id"], F.col("start_ms"))
    looked = F.transform("secondary", lambda s: F.try_element_at(F.col("label_map"), s))
    return (
        joined.withColumn("_looked", F.coalesce(looked, F.transform("secondary", lambda s: F.lit(None).cast("string"))))
        .withColumn("mapped", F.array_sort(F.array_compact("_looked")))
        .withColumn("has_unmapped", F.exists("_looked", lambda x: x.isNull()))
        .drop("_looked", "label_map")
    )


def interval_state(cells: DataFrame) -> DataFrame:
    regular, secondary = F.size("regular"), F.size("secondary")
    same = F.col("regular") == F.col("mapped")
    state = (
        F.when((regular == 0) & (secondary == 0), "SILENCE")
        .when(secondary == 0, "PRIMARY_ONLY")
        .when(regular == 0, "SECONDARY_ONLY")
        .when(F.col("has_unmapped"), "UNMAPPED_SECONDARY")
        .when((regular > 1) | (secondary > 1), F.when(same, "OVERLAP_AGREE").otherwise("OVERLAP_DISAGREE"))
        .otherwise(F.when(same, "AGREE").otherwise("DISAGREE"))
    )
    return cells.withColumn("state", state)


def compare_intervals(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Elementary cells with their state, merged while every observation stays equal."""
    rows = interval_state(map_secondary(cells, mapping)).withColumn(
        "exclusive_speaker", F.get("exclusive", F.lit(0))
    )
    return coalesce_intervals(
        rows, ["meeting_id"], ["regular", "exclusive_speaker", "secondary", "mapped", "state"]
    )


def agreement_summary(intervals: DataFrame) -> DataFrame:
    ms = F.col("end_ms") - F.col("start_ms")
    when = lambda *states: F.sum(F.when(F.col("state").isin(*states), ms).otherwise(0))
    return intervals.groupBy("meeting_id").agg(
        when("AGREE", "OVERLAP_AGREE").alias("agree_ms"),
        when("SILENCE").alias("silence_ms"),
        F.sum(ms).alias("total_ms"),
        F.sum(F.when((F.size("regular") > 1) | (F.size("secondary") > 1), ms).otherwise(0)).alias("overlap_ms"),
    ).withColumn("speech_ms", F.col("total_ms") - F.col("silence_ms")).withColumn(
        "agreement_fraction",
        F.round(F.coalesce(F.try_divide("agree_ms", "speech_ms"), F.lit(0.0)), 6),
    )


def state_durations(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("meeting_id", "state").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("state_ms")
    )


def split_merge_hints(matrix: DataFrame, totals: DataFrame, rules=ReliabilityRules()) -> DataFrame:
    """Labels whose time is shared by several labels of the other side."""
    primary = totals.filter(F.col("side") == "primary").select(
        "meeting_id", F.col("speaker_id").alias("primary_id"), F.col("total_ms").alias("p_ms"))
    secondary = totals.filter(F.col("side") == "secondary").select(
        "meeting_id", F.col("speaker_id").alias("secondary_id"), F.col("total_ms").alias("s_ms"))
    rows = matrix.join(primary, ["meeting_id", "primary_id"]).join(secondary, ["meeting_id", "secondary_id"])

    def hint(kind: str, label: str, partner: str, total: str) -> DataFrame:
        return (
            rows.filter(F.try_divide("overlap_ms", total) >= rules.shared)
            .groupBy("meeting_id", F.lit(kind).alias("hint"), F.col(label).alias("label"))
            .agg(F.array_sort(F.collect_set(partner)).alias("partners"))
            .filter(F.size("partners") > 1)
        )

    return hint("split", "primary_id", "secondary_id", "p_ms").unionByName(
        hint("merge", "secondary_id", "primary_id", "s_ms")
    )


def alignment_summary(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("meeting_id").agg(
        F.count_distinct(F.when(F.col("side") == "primary", F.col("speaker_id"))).alias("primary_count"),
        F.count_distinct(F.when(F.col("side") == "secondary", F.col("speaker_id"))).alias("secondary_count"),
    )
    free_secondary = mapping.filter(F.col("primary_id").isNull()).groupBy("meeting_id").agg(
        F.array_sort(F.collect_set("secondary_id")).alias("unmapped_secondary"))
    used = mapping.filter(F.col("primary_id").isNotNull()).select("meeting_id", F.col("primary_id").alias("speaker_id"))
    free_primary = (
        labels.filter(F.col("side") == "primary").join(used, ["meeting_id", "speaker_id"], "left_anti")
        .groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker_id")).alias("unmapped_primary"))
    )
    nobody = F.array().cast("array<string>")
    return (
        counts.join(free_secondary, "meeting_id", "left").join(free_primary, "meeting_id", "left")
        .withColumn("count_mismatch", F.col("primary_count") != F.col("secondary_count"))
        .withColumn("unmapped_secondary", F.coalesce("unmapped_secondary", nobody))
        .withColumn("unmapped_primary", F.coalesce("unmapped_primary", nobody))
    )


def time_fractions(spans: DataFrame, intervals: DataFrame, ids: list[str]) -> DataFrame:
    """Share of each span's time per observation; a span without length gets zeros.

    ``spans`` has ``meeting_id``, ``ids``, ``speaker_id, start_ms, end_ms``.
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    key = ["meeting_id", *ids]
    rest = [c for c in spans.columns if c not in key]
    joined, dealt, match = home_join(
        spans,
        intervals.select(
            "meeting_id", F.col("start_ms").alias("_is"), F.col("end_ms").alias("_ie"), F.col("state").alias("_state"),
            F.col("exclusive_speaker").alias("_exclusive"),
            F.when((F.size("secondary") == 1) & (F.size("mapped") == 1), F.get("mapped", F.lit(0))).alias("_sole"),
            (F.size("regular") > 1).alias("_po"), (F.size("secondary") > 1).alias("_so"),
        ),
        (start, end), (F.col("_is"), F.col("_ie")),
        (end > start) & (F.col("_is") < end) & (F.col("_ie") > start),
    )
    # What does not meet has no time and no label; a span that meets nothing stays a row.
    met = joined.withColumns({
        "_ms": F.when(match, overlap_ms(start, end, F.col("_is"), F.col("_ie"))), "_sole": F.when(match, F.col("_sole"))})
    plain = ["SILENCE", "PRIMARY_ONLY", "SECONDARY_ONLY", "UNMAPPED_SECONDARY"]
    agrees = F.coalesce(
        (F.col("_sole") == F.col("speaker_id")) & (F.col("_exclusive") == F.col("speaker_id")),
        F.lit(False),
    )
    is_plain = F.col("_state").isin(*plain)
    parts: dict[str, Column] = {
        "agreement": ~is_plain & agrees,
        "disagreement": ~is_plain & ~agrees,
        "primary_only": F.col("_state") == "PRIMARY_ONLY",
        "secondary_only": F.col("_state") == "SECONDARY_ONLY",
        "silence": F.col("_state") == "SILENCE",
        "primary_overlap": F.col("_po"),
        "secondary_overlap": F.col("_so"),
        "overlap_agreement": F.col("_state") == "OVERLAP_AGREE",
        "unmapped": F.col("_state") == "UNMAPPED_SECONDARY",
    }
    by_label = met.groupBy(*dealt, *ids, "_sole").agg(
        F.first(F.struct(*rest)).alias("_rest"), F.sum("_ms").alias("_label_ms"),
        *[F.sum(F.when(test, F.col("_ms")).otherwise(0)).alias(f"_sum_{name}") for name, test in parts.items()],
    )
    out = by_label.groupBy(*dealt, *ids).agg(
        F.first("_rest").alias("_rest"),
        F.min(F.when(F.col("_sole").isNotNull(), F.struct((-F.col("_label_ms")).alias("m"), "_sole")))["_sole"]
        .alias("secondary_speaker"),
        *[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in parts],
    ).select(*key, "_rest.*", "secondary_speaker", *[f"_sum_{name}" for name in parts])
    length = end - start
    for name in FRACTIONS:
        share = F.least(F.lit(1.0), F.col(f"_sum_{name}") / length)
        out = out.withColumn(f"{name}_fraction", F.coalesce(F.when(length > 0, share), F.lit(0.0)))
    return out.drop(*[f"_sum_{name}" for name in FRACTIONS])


def classify_reliability(rows: DataFrame, rules=ReliabilityRules()) -> DataFrame:
    """Status and ordered reasons from the time fractions.

    Needs ``count_mismatch`` and, for words, a ``zero_duration`` column.
    """
    f = lambda name: F.col(f"{name}_fraction")
    overlap = F.greatest(f("primary_overlap"), f("secondary_overlap"))
    zero = F.col("zero_duration")
    uncertain = zero | (f("unmapped") > 1 - rules.mixed)
    reliable = ~uncertain & (f("agreement") >= rules.reliable) & (overlap <= rules.low_overlap)
    status = (
        F.when(uncertain, "UNCERTAIN")
        .when(reliable, "RELIABLE")
        .when(f("agreement") >= rules.mixed, "MIXED")
        .otherwise("UNCERTAIN")
    )
    reasons = [
        (zero, "zero_duration_no_temporal_support"),
        (overlap > 0, "overlapping_speech"),
        (f("disagreement") > 0, "speaker_disagreement"),
        ((f("primary_only") > 0) | (f("secondary_only") > 0), "speech_presence_disagreement"),
        (f("silence") > 0, "shared_silence"),
        (f("unmapped") > 0, "unmapped_secondary"),
        (F.col("count_mismatch"), "speaker_count_mismatch"),
        (reliable, "high_model_agreement"),
    ]
    return rows.withColumn("status", status).withColumn(
        "reasons", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in reasons]))
    )


def word_reliability(words: DataFrame, intervals: DataFrame, alignment: DataFrame, rules=ReliabilityRules()) -> DataFrame:
    measured = time_fractions(words, intervals, ["segment_id", "word_index"])
    with_count = spread_join(
        measured, alignment.select("meeting_id", "count_mismatch"), ["meeting_id"], F.col("start_ms"))
    return classify_reliability(
        with_count.withColumn("zero_duration", F.col("start_ms") == F.col("end_ms")), rules)


def utterance_reliability(utterances: DataFrame, intervals: DataFrame, alignment: DataFrame, rules=ReliabilityRules()) -> DataFrame:
    measured = time_fractions(utterances, intervals, ["utterance_id"])
    with_count = spread_join(
        measured, alignment.select("meeting_id", "count_mismatch"), ["meeting_id"], F.col("start_ms"))
    return classify_reliability(with_count.withColumn("zero_duration", F.lit(False)), rules)


def _best_turn(utterances: DataFrame, turns: DataFrame, prefix: str) -> DataFrame:
    """Turn of the utterance's own speaker with the largest overlap."""
    start, end, ts, te = F.col("start_ms"), F.col("end_ms"), F.col("_ts"), F.col("_te")
    met = range_join(
        utterances.select("meeting_id", "utterance_id", "speaker_id", "start_ms", "end_ms"),
        turns.select("meeting_id", "speaker_id", F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te")),
        ["meeting_id", "speaker_id"], (start, end), (ts, te), (ts < end) & (te > start),
    )
    best = F.min(F.struct((-overlap_ms(start, end, ts, te)).alias("m"), "_ts", "_te"))
    return met.groupBy("meeting_id", "utterance_id").agg(best.alias("_b")).select(
        "meeting_id", "utterance_id", F.col("_b._ts").alias(f"{prefix}_start"), F.col("_b._te").alias(f"{prefix}_end"))


def boundary_deltas(utterances: DataFrame, exclusive: DataFrame, secondary: DataFrame, mapping: DataFrame) -> DataFrame:
    """Start and end differences between the best turns of the two segmentations."""
    mapped = spread_join(
        secondary.withColumnRenamed("speaker_id", "secondary_id"),
        mapping.filter(F.col("primary_id").isNotNull()).select("meeting_id", "secondary_id", F.col("primary_id").alias("speaker_id")),
        ["meeting_id", "secondary_id"], F.col("start_ms"), "inner")
    key = ["meeting_id", "utterance_id"]
    a = _best_turn(utterances, exclusive, "a")
    b = _best_turn(utterances, mapped, "b")
    start, end = F.col("b_start") - F.col("a_start"), F.col("b_end") - F.col("a_end")
    return (
        utterances.select(*key).join(a.join(b, key), key, "left")
        .select(*key, start.alias("start_delta_ms"), end.alias("end_delta_ms"),
                (F.abs(start) + F.abs(end)).alias("boundary_disagreement_ms"))
    )


def reference_mapping(turns: DataFrame, truth: DataFrame) -> DataFrame:
    """Model label to truth label, from unioned intervals so duplicates count once."""
    key = ["meeting_id", "speaker_id"]
    model = union_intervals(turns, key).select(
        "meeting_id", F.col("speaker_id").alias("secondary_id"), F.col("start_ms").alias("_ms"), F.col("end_ms").alias("_me"))
    gold = union_intervals(truth, key).select(
        "meeting_id", F.col("speaker_id").alias("primary_id"), F.col("start_ms").alias("_gs"), F.col("end_ms").alias("_ge"))
    met = range_join(
        model, gold, ["meeting_id"], (F.col("_ms"), F.col("_me")), (F.col("_gs"), F.col("_ge")),
        (F.col("_gs") < F.col("_me")) & (F.col("_ge") > F.col("_ms")))
    matrix = met.groupBy("meeting_id", "secondary_id", "primary_id").agg(
        F.sum(overlap_ms(F.col("_ms"), F.col("_me"), F.col("_gs"), F.col("_ge"))).alias("overlap_ms"))
    labels = turns.select("meeting_id", F.lit("secondary").alias("side"), "speaker_id").unionByName(
        truth.select("meeting_id", F.lit("primary").alias("side"), "speaker_id")).distinct()
    return assign_speakers(matrix, labels).select(
        "meeting_id", F.col("secondary_id").alias("model_id"), F.col("primary_id").alias("truth_id"), "overlap_ms")


def truth_at(probes: DataFrame, truth: DataFrame, ids: list[str]) -> DataFrame:
    """Truth speaker of each probe that lies inside exactly one truth speaker.

    ``probes`` has ``meeting_id``, ``ids`` and a doubled time ``at2`` (twice the probe
    time), so that midpoints of whole milliseconds stay whole numbers.
    """
    at = F.col("at2")
    met = range_join(
        probes, truth.select("meeting_id", F.col("speaker_id").alias("_who"),
                             (F.col("start_ms") * 2).alias("_ts"), (F.col("end_ms") * 2).alias("_te")),
        ["meeting_id"], (at, at), (F.col("_ts"), F.col("_te")),
        (F.col("_ts") <= at) & (at < F.col("_te")), width=20_000)
    one = met.groupBy("meeting_id", *ids).agg(
        F.count_distinct("_who").alias("speakers_here"), F.min("_who").alias("_only"))
    return (
        probes.join(one, ["meeting_id", *ids], "left")
        .withColumn("speakers_here", F.coalesce("speakers_here", F.lit(0)).cast("bigint"))
        .withColumn("truth_id", F.when(F.col("speakers_here") == 1, F.col("_only")))
        .drop("_only")
    )

"""Conversation record tables derived from the driver's parquet tables.

The tables have no recordings, so word times, speaker turns, model answers and labels
are derived by plain arithmetic from ids and text. They exercise the operators; no
metric over them says anything about quality.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.operators import ordered
from dialogue_lake.session import checkpointed

WORD_MS = 300


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._shared: dict[str, DataFrame] = {}

    def shared(self, name: str, build) -> DataFrame:
        """A stage result used more than once by a query: computed once and checkpointed."""
        if name not in self._shared:
            self._shared[name] = checkpointed(build())
        return self._shared[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def utterances(self) -> DataFrame:
        base = self.table("conversations").select(
            F.col("conv_id").alias("meeting_id"),
            F.col("turn").alias("utt_idx"),
            F.col("role").alias("speaker_id"),
            "text",
            F.size(tx.words_of(F.col("text"))).cast("bigint").alias("n_words"),
        )
        timed = ordered.scan(
            base, ["meeting_id"], ["utt_idx"], ordered.bucket_of("utt_idx", 4096),
            [ordered.running_sum("_upto", F.col("n_words"))],
        )
        return timed.select(
            "meeting_id", "utt_idx",
            F.format_string("utt_%06d", F.col("utt_idx") + 1).alias("utterance_id"),
            "speaker_id", "text", "n_words",
            ((F.col("_upto") - F.col("n_words")) * WORD_MS).alias("start_ms"),
            (F.col("_upto") * WORD_MS).alias("end_ms"),
        )

    @cached_property
    def long_utterances(self) -> DataFrame:
        """Meetings of hundreds of turns: 64 conversations, one after the other."""
        base = self.table("conversations").select(
            F.floor(F.col("conv_id") / 64).cast("bigint").alias("meeting_id"), "conv_id", "turn", F.col("role").alias("speaker_id"), "text")
        rows = ordered.scan(base, ["meeting_id"], ["conv_id", "turn"], ordered.bucket_of("conv_id", 16), [ordered.numbered("_n")])
        return rows.select(
            "meeting_id", (F.col("_n") - 1).alias("utt_idx"), F.format_string("utt_%06d", "_n").alias("utterance_id"), "speaker_id", "text")

    @cached_property
    def durations(self) -> DataFrame:
        return self.utterances.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))

    @cached_property
    def words(self) -> DataFrame:
        start = F.col("start_ms") + F.col("i") * WORD_MS
        return (
            self.utterances.select(
                "meeting_id", "utt_idx", "start_ms", F.posexplode(tx.words_of(F.col("text"))).alias("i", "w")
            )
            .select(
                "meeting_id",
                F.format_string("seg_%06d", F.col("utt_idx") + 1).alias("segment_id"),
                F.col("utt_idx").alias("seg_idx"),
                F.col("i").cast("bigint").alias("word_index"),
                start.cast("bigint").alias("start_ms"),
                (start + F.when(F.col("i") % 37 == 0, 0).otherwise(WORD_MS)).cast("bigint").alias("end_ms"),
                F.col("w").alias("text"),
            )
        )

    @cached_property
    def segments(self) -> DataFrame:
        turn = F.col("utt_idx")
        return self.utterances.select(
            "meeting_id",
            F.format_string("seg_%06d", turn + 1).alias("segment_id"),
            turn.alias("seg_idx"),
            (F.col("start_ms") + 100 * (turn % 3)).alias("start_ms"),
            (F.col("end_ms") + 150 * (turn % 2)).alias("end_ms"),
            "text",
        )

    @cached_property
    def exclusive_turns(self) -> DataFrame:
        """Diarised turns; a system message is never spoken, so it has none."""
        turn = F.col("utt_idx")
        shift = F.when(turn % 3 == 2, 460).otherwise(40 * (turn % 3))
        cut = F.when(turn % 2 == 1, 450).otherwise(0)
        return (
            self.utterances.filter(F.col("speaker_id") != "system")
            .select(
                "meeting_id",
                F.format_string("turn_%06d", turn + 1).alias("turn_id"),
                turn.alias("turn_idx"),
                "speaker_id",
                (F.col("start_ms") + shift).alias("start_ms"),
                (F.col("end_ms") - cut).alias("end_ms"),
            )
            .filter(F.col("end_ms") > F.col("start_ms"))
        )

    @cached_property
    def regular_turns(self) -> DataFrame:
        """Turns that may run into the next speaker's."""
        return self.exclusive_turns.withColumn(
            "end_ms", F.col("end_ms") + F.when(F.col("turn_idx") % 4 == 1, 1500).otherwise(0)
        )

    @cached_property
    def secondary_turns(self) -> DataFrame:
        turn, role = F.col("utt_idx"), F.col("speaker_id")
        merged = (role == "system") | ((role == "assistant") & (F.col("meeting_id") % 7 == 0))
        return (
            self.utterances.select(
                "meeting_id",
                turn.alias("turn_idx"),
                F.when(merged, "S_user").otherwise(F.concat(F.lit("S_"), role)).alias("speaker_id"),
                (F.col("start_ms") + 150 * (turn % 4)).alias("start_ms"),
                (F.col("end_ms") + 200 * (turn % 3)).alias("end_ms"),
            )
            .filter(F.col("end_ms") > F.col("start_ms"))
        )

    @cached_property
    def truth_turns(self) -> DataFrame:
        return self.utterances.filter(F.col("end_ms") > F.col("start_ms")).select(
            "meeting_id", F.concat(F.lit("T_"), "speaker_id").alias("speaker_id"), "start_ms", "end_ms"
        )

    @cached_property
    def layered_turns(self) -> DataFrame:
        columns = ["meeting_id", "layer", "speaker_id", "start_ms", "end_ms"]
        layers = [
            ("regular", self.regular_turns), ("exclusive", self.exclusive_turns),
            ("secondary", self.secondary_turns),
        ]
        out = None
        for name, turns in layers:
            part = turns.withColumn("layer", F.lit(name)).select(*columns)
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def glossary(self) -> DataFrame:
        """Vocabulary of the benchmark items; scope and priority follow the word length."""
        token = F.col("token")
        size = F.length(token)
        return (
            self.table("benchmark")
            .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("token"))
            .distinct()
            .select(
                F.concat(F.lit("term."), token).alias("entry_id"),
                token.alias("canonical"),
                F.when(size % 3 == 0, "meeting").when(size % 3 == 1, "project").otherwise("global").alias("scope"),
                ((size % 10) / 10).alias("priority"),
                F.concat(F.substr(token, F.lit(1), F.lit(2)), F.substr(token, F.lit(4))).alias("asr_alias"),
                F.when(size % 2 == 0, "technology").otherwise("organization").alias("category"),
                (size * 37 + F.ascii(token) * 101).cast("bigint").alias("vector_no"),
            )
        )

    @cached_property
    def variants(self) -> DataFrame:
        shape = "stack(2, 'canonical_exact', canonical, 'asr_alias_exact', asr_alias) as (kind, variant)"
        return self.glossary.selectExpr(
            "entry_id", "canonical", "scope", "priority", "category", "vector_no", shape
        )

    @cached_property
    def items(self) -> DataFrame:
        """Every assistant turn is a claim citing its own and the preceding turn."""
        turn = F.col("utt_idx")
        rows = self.utterances.filter(F.col("speaker_id") == "assistant")
        missing = (F.col("meeting_id") * 31 + turn * 7) % 50 == 0
        cited = F.array(
            F.format_string("utt_%06d", turn),
            F.format_string("utt_%06d", F.when(missing, turn + 901).otherwise(turn + 1)),
        )
        return rows.select(
            "meeting_id", "utt_idx",
            F.concat(F.lit("item_"), F.format_string("%06d", turn)).alias("item_id"),
            F.element_at(F.array(*[F.lit(s) for s in ("summary", "minutes", "decisions", "action_items")]),
                         (turn % 4 + 1).cast("int")).alias("section"),
            F.col("text"),
            F.when(turn % 3 == 0, "user").alias("owner_speaker"),
            F.when(turn % 5 == 2, F.lower(F.element_at(tx.words_of(F.col("text")), 1))).alias("deadline_text"),
            F.element_at(F.array(F.lit("concern"), F.lit("fact"), F.lit("question")),
                         (turn % 3 + 1).cast("int")).alias("kind"),
            F.concat(F.lit("topic_"), (F.col("meeting_id") + turn) % 3).alias("topic"),
            cited.alias("evidence_ids"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """One typed event per utterance with an answer probability."""
        turn, meeting = F.col("utt_idx"), F.col("meeting_id")
        k = (meeting * 31 + turn * 17) % 10
        labels = F.array(*[F.lit(t) for t in fixed.EVENT_TYPES])
        return self.utterances.select(
            "meeting_id", "utt_idx",
            F.format_string("evt_%06d", turn + 1).alias("event_id"),
            "utterance_id", "speaker_id", "text", "start_ms", "end_ms",
            F.element_at(labels, ((meeting * 7 + turn * 3) % 14 + 1).cast("int")).alias("choice"),
            F.when(k < 7, 0.95).when(k < 9, 0.70).otherwise(0.40).alias("p"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        event = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("meeting_id"), "event_id", F.col("event_type").alias("stage"),
            F.round(F.col("value") * 1000).cast("bigint").alias("latency_ms"),
            F.when(event % 17 == 0, 429).otherwise(200).cast("bigint").alias("status_code"),
            (event % 17 == 0).alias("retry"),
            F.when(event % 23 != 0, event % 500).alias("tokens"),
            F.concat(F.lit("req_"), (event % 97)).alias("request_id"), "ts",
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Model answers to the verification questions of each claim."""
        base = self.items.select(
            "meeting_id", "utt_idx", "item_id", "section", "owner_speaker", "deadline_text",
            F.posexplode(F.array(*[F.lit(q) for q in (
                "claim_supported", "item_type_supported", "negation_preserved", "numbers_preserved",
                "scope_preserved")])).alias("q", "question_id"),
        )
        turn, meeting = F.col("utt_idx"), F.col("meeting_id")
        k = (meeting * 31 + turn * 17 + F.col("q")) % 10
        gold = F.array(F.lit("YES"), F.lit("NO"), F.lit("AMBIGUOUS"))
        said = F.array(F.lit("YES"), F.lit("YES"), F.lit("NO"), F.lit("AMBIGUOUS"))
        return base.select(
            "meeting_id", "item_id", "section", "question_id", F.col("q").cast("bigint").alias("q"),
            F.element_at(said, (F.when((meeting + turn) % 2 == 0, 0).otherwise(
                (meeting * 3 + turn + F.col("q")) % 4) + 1).cast("int")).alias("choice"),
            F.when(k < 8, 0.95).when(k < 9, 0.70).otherwise(0.40).alias("p"),
            F.element_at(gold, ((meeting + turn * 2 + F.col("q")) % 3 + 1).cast("int")).alias("gold"),
        )

"""Structured Streaming jobs that follow the batch rules on arriving rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that live utterances need; a session option.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WORD = "start_ms bigint, end_ms bigint, speaker_id string, text string"
UTTERANCE = "meeting_id bigint, speaker_id string, start_ms bigint, end_ms bigint, words bigint, text string"


def live_utterances_by_speaker(words: DataFrame, gap: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Words of a speaker joined until a silence of ``gap``; late words are dropped.

    ``words``: ``ts, meeting_id, speaker_id, text``. A session closes on silence of its own
    speaker, so talk of another speaker in between does not cut it: built-in windows only.
    """
    said = F.array_sort(F.collect_list(F.struct("ts", "text")))
    return (
        words.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("span"), "meeting_id", "speaker_id")
        .agg(F.count(F.lit(1)).alias("words"), F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("text"))
        .select("meeting_id", "speaker_id", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "words", "text"))


class Utterances(StatefulProcessor):
    """One meeting: words not yet final, and the utterance that is still open.

    A word is final once the watermark has passed its start, since earlier words are late
    from then on. Final words join the open utterance in order or close it. It also closes
    when the watermark is a gap beyond its end. Timers are the only thing that emits.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WORD)
        self.open = handle.getValueState("open", "speaker_id string, start_ms bigint, end_ms bigint, words bigint, text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            fresh = [(int(s), int(e), who, text) for s, e, who, text in zip(batch["start_ms"], batch["end_ms"], batch["speaker_id"], batch["text"]) if s > passed]
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(min(w[0] for w in fresh) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(w) for w in self.waiting.get()]
        final = sorted((w for w in waiting if w[0] <= passed), key=lambda w: (w[0], w[1], w[2] or "", w[3] or ""))
        later = [w for w in waiting if w[0] > passed]
        current = list(self.open.get()) if self.open.exists() else None
        # The text of a long utterance is joined once a call, not once a word.
        pieces = [current[4]] if current else []
        closed: list[tuple] = []

        def close() -> None:
            closed.append((*key, *current[:4], " ".join(pieces)))

        for start, end, who, text in final:
            if current and (current[0] != who or start - current[2] > self.gap_ms):
                close()
                current = None
            if current:
                current[2], current[3] = max(current[2], end), current[3] + 1
                pieces.append(text or "")
            else:
                current, pieces = [who, start, end, 1, ""], [text or ""]
        if current and not later and passed - current[2] >= self.gap_ms:
            close()
            current = None
        if final:
            self.waiting.put(later) if later else self.waiting.clear()
        if current:
            self.open.update((*current[:4], " ".join(pieces)))
        elif self.open.exists():
            self.open.clear()
        if later:
            self.handle.registerTimer(min(w[0] for w in later) + 1)
        elif current:
            self.handle.registerTimer(current[2] + self.gap_ms + 1)
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in UTTERANCE.split(", ")])

    def close(self) -> None:
        pass


def live_utterances(words: DataFrame, gap_ms: int = 1000, lateness: str = "10 seconds") -> DataFrame:
    """Words joined into utterances by the batch rule, on rows that arrive in any order.

    ``words``: ``meeting_id, speaker_id, start_ms, end_ms, text``, times since the epoch. A
    change of speaker or a silence of more than ``gap_ms`` closes an utterance; words later
    than ``lateness`` are dropped. An utterance ends with the latest end of its words; a
    silence counts from there. Words that start together go by end, speaker and text. The
    state of a meeting is its unsettled words and one open utterance. Needs ``STATE_STORE``.
    """
    timed = words.select("meeting_id", "speaker_id", "start_ms", "end_ms", "text", F.timestamp_millis("start_ms").alias("ts"))
    return timed.withWatermark("ts", lateness).groupBy("meeting_id").transformWithStateInPandas(
        Utterances(gap_ms), UTTERANCE, "Append", "EventTime")


def stage_monitor(stages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Latest status and running time of every job stage; use update mode.

    ``stages``: ``ts, job_id, stage, status``.
    """
    return (
        stages.withWatermark("ts", lateness).groupBy("job_id", "stage")
        .agg(
            F.max_by("status", "ts").alias("status"), F.min("ts").alias("started"),
            (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds")))


def job_monitor(stages: DataFrame, names: Sequence[str], done: Sequence[str] = ("completed", "failed"), lateness: str = "1 hour") -> DataFrame:
    """Per job how many of the known stages have not finished, and the one that moved last; use update mode."""
    latest = [F.max_by(F.when(F.col("stage") == n, F.col("status")), F.when(F.col("stage") == n, F.col("ts"))) for n in names]
    unfinished = sum((F.when(x.isin(*done), 0).otherwise(1) for x in latest), F.lit(0))
    return stages.withWatermark("ts", lateness).groupBy("job_id").agg(
        unfinished.cast("bigint").alias("unfinished"), F.max_by("stage", "ts").alias("current_stage"), F.max("ts").alias("updated"))


def request_dedup_stream(requests: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Each fingerprint once per horizon. ``requests``: ``ts, fingerprint``."""
    return requests.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["fingerprint"])

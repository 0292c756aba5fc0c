"""Live utterances against the batch rule, on shuffled batches with late words."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogue_lake.streaming import live

WORDS = "meeting_id bigint, speaker_id string, start_ms bigint, end_ms bigint, text string"
GAP, LATENESS = 1000, 10_000


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.STATE_STORE)
    yield
    spark.conf.set(name, before)


def batch_rule(words):
    out, current = [], None
    for m, who, start, end, text in sorted(words, key=lambda w: (w[0], w[2], w[3], w[1] or "", w[4])):
        if current and current[0] == m and current[1] == who and start - current[3] <= GAP:
            current[3], current[4] = max(current[3], end), [*current[4], text]
        else:
            current = [m, who, start, end, [text]]
            out.append(current)
    return {(m, who, s, e, len(t), " ".join(t)) for m, who, s, e, t in out}


def talk(seed, n=120):
    rng = random.Random(seed)
    words, at, who = [], 1_700_000_000_000, "a"
    for i in range(n):
        at += rng.choice([0, 100, 300, 300, 300, 1000, 1001, 1600])
        who = rng.choice([who, who, who, "b", None])
        end = at + rng.choice([0, 200, 300])
        words.append((seed, who, at, end, f"w{i}"))
    return words


def test_stream_equals_the_batch_rule(spark, state_store, tmp_path):
    meetings = [talk(m) for m in (1, 2, 3)]
    last = max(w[2] for words in meetings for w in words)
    batches, kept, watermark, latest = [], [], 0, 0
    todo = sorted((w for words in meetings for w in words), key=lambda w: (w[2] // 4000, random.Random(w[4] + str(w[0])).random()))
    for at in range(0, len(todo), 40):
        batch = todo[at : at + 40]
        if at in (160, 240):
            batch = [*batch, (1, "late", 5, 80, "late"), (9, "late", 0, 1, "late")]
        batches.append(batch)
    end = [(9, "end", last + 200_000 + k, last + 200_000 + k, "end") for k in (0, 1)]
    batches += [[end[0]], [end[1]]]
    for batch in batches:
        # A batch sees the watermark that the ones before it left.
        kept += [w for w in batch if w[2] > watermark]
        latest = max([latest, *(w[2] for w in batch)])
        watermark = max(watermark, latest - LATENESS)
    assert sum(map(len, batches)) - len(kept) >= 2
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, WORDS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n:03d}"))
    schema = T.StructType([*spark.createDataFrame([], WORDS).schema, T.StructField("part", T.StringType())])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    out = live.live_utterances(source, GAP, f"{LATENESS // 1000} seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("utterances").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = {tuple(r) for r in spark.table("utterances").collect()}
    assert {r for r in got if r[0] != 9} == {r for r in batch_rule(kept) if r[0] != 9}
    assert not any("late" in r[5].split() for r in got)


def test_unfinished_stages(spark):
    rows = [(1, "j", "asr", "running"), (2, "j", "asr", "completed"), (3, "j", "edit", "running"), (1, "k", "asr", "failed"), (2, "k", "edit", "completed")]
    df = spark.createDataFrame(rows, "t long, job_id string, stage string, status string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.job_id: (r.unfinished, r.current_stage) for r in live.job_monitor(df, ["asr", "edit", "claims"]).collect()}
    assert got == {"j": (2, "edit"), "k": (1, "edit")}

import json

import pytest
from pyspark.sql import types as T

from dialogue_lake.sources import readers, sinks
from dialogue_lake.streaming import live


def test_read_stage_is_strict(spark, tmp_path):
    rows = [{"id": "a", "n": 1, "schema_version": "1.0"}, {"id": "b", "n": 2}, {"id": "c", "n": 3, "schema_version": "2.0"},
            {"id": "d", "n": 4, "schema_version": "1.0", "more": 1}]
    (tmp_path / "s.json").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("schema_version", T.StringType())])
    good, bad = readers.read_stage(spark, schema, str(tmp_path / "s.json"))
    assert [r.id for r in good.collect()] == ["a"] and bad.count() == 4


def test_publish_once(spark, tmp_path):
    df = spark.range(3)
    path = sinks.publish_stage(df, str(tmp_path), "words", "r1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        sinks.publish_stage(df, str(tmp_path), "words", "r1")


def test_asr_glossary_rttm_context_media(spark, tmp_path):
    chunk = {"meeting_id": 1, "chunk": 1, "offset_ms": 600000, "duration": 30.0, "text": "a b", "language": "en",
             "segments": [{"start": 0.0, "end": 1.5, "text": "a b"}], "words": [{"word": "a", "start": 0.25, "end": 0.5}, {"word": "b", "start": 0.1, "end": 1}]}
    (tmp_path / "asr.json").write_text(json.dumps(chunk))
    segments, words, bad = readers.scan_asr_responses(spark, str(tmp_path / "asr.json"))
    assert segments.first().end_ms == 601500 and words.count() == 2
    assert sorted(r.rule for r in bad.collect()) == ["words_out_of_order", "wrong_duration"]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps({"id": i, "canonical": i, "source": s}) for i, s in [("x", "global"), ("y", "project")]))
    good, wrong = readers.read_glossary(spark, str(tmp_path / "g.jsonl"), "global")
    assert [r.id for r in good.collect()] == ["x"] and wrong.count() == 1
    (tmp_path / "t.rttm").write_text("SPEAKER rec 1 0.500 1.250 <NA> <NA> ann <NA> <NA>\nLEXEME x\n")
    assert tuple(readers.read_rttm(spark, str(tmp_path / "t.rttm")).first()) == ("rec", "ann", 500, 1750)
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("plain text")
    (docs / "b.json").write_text(json.dumps({"text": "more", "terms": [{"canonical": "K", "aliases": ["k1"]}]}))
    (docs / "c.csv").write_text("canonical,aliases,category,scope\nQ,q1 | q2 |,technology,meeting\n")
    (docs / "sub dir").mkdir()
    (docs / "sub dir" / "a.txt").write_text("plain text below")
    (docs / "long.md").write_text("x" * 300_000)
    (docs / "bad.json").write_text('{"text": ')
    free, terms, rejected = readers.read_context_documents(spark, str(docs))
    assert {r.source_id.replace("%20", " ") for r in free.collect()} == {"a.txt", "sub dir/a.txt", "b.json"}
    assert {tuple(r) for r in rejected.collect()} == {("long.md", "text_too_long"), ("bad.json", "broken_json")}
    assert {r.canonical: r.aliases for r in terms.collect()} == {"K": ["k1"], "Q": ["q1", "q2"]}
    probe = {"streams": [{"index": 0, "codec_type": "video"}, {"index": 1, "codec_type": "audio", "codec_name": "pcm_s16le", "sample_rate": "16000",
             "channels": 1, "bits_per_sample": 16, "duration_ts": 32000, "time_base": "1/16000"}], "format": {"format_name": "wav", "duration": "9"}}
    media = readers.check_media(spark.createDataFrame([(1, json.dumps(probe), 2.1)], "meeting_id bigint, probe string, source_seconds double")).first()
    assert media.stream_index == 1 and media.duration_seconds == 2.0 and media.canonical and media.same_duration


def test_names_are_refused_with_a_reason(spark):
    names = spark.createDataFrame([("people", "Ann"), ("people", " "), ("people", None), ("people", "x" * 121)], "kind string, name string")
    good, refused = readers.name_entries(names)
    assert [r.canonical for r in good.collect()] == ["Ann"]
    assert sorted(r.reason for r in refused.collect()) == ["blank_name", "blank_name", "name_too_long"]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a", 0.0, "x"), (1, "a", 0.5, "y"), (1, "a", 9.0, "z"), (1, "a", 60.0, "end")], "meeting_id bigint, speaker_id string, t double, text string")
    rows.withColumn("ts", F.timestamp_seconds("t")).withColumn("fingerprint", F.lit("same")).drop("t").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def run(build, name, mode):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    said = run(live.live_utterances_by_speaker, "said", "append")
    assert sorted(r.text for r in said) == ["x y", "z"]
    assert len(run(live.request_dedup_stream, "asked", "append")) == 1
    stages = run(lambda s: live.stage_monitor(s.select("ts", F.col("meeting_id").alias("job_id"), F.col("speaker_id").alias("stage"), F.col("text").alias("status"))), "jobs", "update")
    assert stages[-1].status == "end" and stages[-1].seconds == 60.0

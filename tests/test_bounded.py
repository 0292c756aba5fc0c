"""Merging without one array of everything, and timed truth."""

import json

from pyspark.sql import functions as F

from dialogue_lake.operators import attribution as at
from dialogue_lake.operators import claims
from dialogue_lake.operators import terms as tm
from dialogue_lake.sources import readers


def test_a_monologue_is_put_together_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(at, "WORDS_A_PIECE", 3)
    texts = ["a", " b", "c ", "d", "e", "f", ", g", "h"] * 5
    rows = [(1, i // 9, f"seg_{i // 9:03d}", i % 9, i * 10, i * 10 + 8, t, "s", i == 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "meeting_id bigint, seg_idx bigint, segment_id string, word_index bigint, start_ms bigint, end_ms bigint, text string, speaker_id string, overlap_present boolean")
    got = at.assemble_utterances(df.repartition(5)).collect()
    want = texts[0]
    for before, t in zip(texts, texts[1:]):
        want += t if before.endswith(" ") or t.startswith(" ") else f" {t}"
    assert len(got) == 1 and got[0].text == want and (got[0].start_ms, got[0].end_ms) == (0, 398)
    assert got[0].source_segment_ids == [f"seg_{k:03d}" for k in range(5)] and got[0].overlap_present


def test_a_claim_said_very_often_collects_its_citations_once(spark):
    items = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("meeting_id"), F.lit("summary").alias("section"), (F.col("id") % 50).alias("chunk_no"), F.col("id").alias("item_no"),
        F.concat(F.lit("i"), "id").alias("item_id"), F.lit("same").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("topic", "kind", "owner_speaker", "deadline_text")],
        F.when(F.col("id") % 2 == 0, F.array(F.format_string("utt_%d", 1_000_000 - F.col("id") % 7), F.lit("utt_3"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    got = claims.combine_partials(items).collect()
    assert len(got) == 1 and got[0].item_id == "i0" and got[0].evidence_ids == ["utt_3", *[f"utt_{1_000_000 - k}" for k in range(6, -1, -1)]]
    none = claims.combine_partials(items.filter("item_no % 2 = 1").limit(5)).collect()
    assert none[0].evidence_ids == []


def test_a_hot_term_keeps_each_source_once_in_order(spark):
    rows = [(1, "meeting", "Alpha" if i % 2 else "alpha", [f"a{(i * 3) % 5}", "x"] if i % 4 else [], f"s{(i * 7) % 4}", i / 1000, i % 3 > 0, i) for i in range(600)]
    df = spark.createDataFrame(rows, "meeting_id bigint, scope string, canonical string, aliases array<string>, source_id string, priority double, inferred boolean, order_no bigint")
    got = tm.merge_context_terms(df).collect()
    aliases = list(dict.fromkeys(a for r in rows for a in r[3]))
    sources = list(dict.fromkeys(r[4] for r in rows))
    assert len(got) == 1 and got[0].aliases == aliases and got[0].source_ids == sources and got[0].canonical == "alpha"
    bare = tm.merge_context_terms(df.filter("order_no = 0")).collect()
    assert bare[0].aliases == [] and bare[0].source_ids == ["s0"]


def test_timed_truth(spark, tmp_path):
    whole = {"duration_seconds": 5, "audio_sha256": "x", "reference_kind": "synthetic", "verified_acoustic_annotations": False,
             "segments": [{"speaker_id": "A", "start": 0, "end": 1.5}, {"speaker_id": "B", "start": 2, "end": 2}, {"speaker_id": "B", "start": 4, "end": 5.001}],
             "word_events": [{"speaker_id": "A", "time_seconds": 0.25, "text": "hi"}, {"speaker_id": "A", "time_seconds": -1, "text": "no"}], "note": "kept"}
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "two.v1.json").write_text(json.dumps({**whole, "segments": [{"speaker_id": " ", "start": 0, "end": 1}]}))
    (tmp_path / "three.json").write_text("{")
    segments, words, bad = readers.read_timed_truth(spark, str(tmp_path))
    assert [(r.recording, r.speaker_id, r.start_ms, r.end_ms, r.verified) for r in segments.collect()] == [("one", "A", 0, 1500, False)]
    assert [(r.recording, r.time_ms, r.text) for r in words.collect()] == [("one", 250, "hi")]
    assert {(r.recording, r.path, r.rule) for r in bad.collect()} == {
        ("one", "$.segments[1]", "ends_before_start"), ("one", "$.segments[2]", "outside_audio"), ("one", "$.word_events[1]", "negative_time"),
        ("two.v1", "$.segments[0].speaker_id", "blank_text"), ("three", "$", "invalid_json")}

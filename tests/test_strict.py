"""Strict JSON: each departure is a row; ordered digests; recogniser rules."""

import hashlib
import json

from pyspark.sql import types as T

from dialogue_lake.operators import claims
from dialogue_lake.sources import readers, sinks, strict

GOOD = {"summary": [{"text": "s", "evidence_utterance_ids": ["u1"]}], "minutes": [{"text": "m", "topic": "t", "kind": "decision", "evidence_utterance_ids": []}],
        "decisions": [], "action_items": [{"task": "a", "owner": {"kind": "named_entity", "speaker_id": None, "display_text": "Ann"}, "deadline_text": None, "evidence_utterance_ids": ["u2", "u3"]}]}


def changed(**sections):
    return json.dumps({**GOOD, **sections})


def test_every_rule_of_an_answer(spark):
    item = GOOD["action_items"][0]
    texts = {
        1: json.dumps(GOOD), 2: "{broken", 3: None, 4: json.dumps(GOOD) + " trailing", 5: '{"summary": [], ' + json.dumps(GOOD)[1:], 6: json.dumps([GOOD]),
        7: json.dumps({k: v for k, v in GOOD.items() if k != "decisions"}), 8: changed(more={"deep": [1, {"x": 2}]}), 9: changed(decisions="none"),
        10: changed(minutes=[{**GOOD["minutes"][0], "kind": "rumour"}, {**GOOD["minutes"][0], "topic": " "}]), 11: changed(summary=[{"text": 5, "evidence_utterance_ids": [None, 1]}]),
        12: changed(action_items=[{**item, "owner": {"kind": "speaker", "speaker_id": None, "display_text": "Ann"}}]),
        13: changed(action_items=[{**item, "owner": {"kind": "speaker", "name": "x"}}, item]), 14: changed(summary=[GOOD["summary"][0]] * 4),
        15: changed(action_items=[{**item, "owner": None, "deadline_text": 7}]), 16: changed(summary=["x"]), 17: "", 18: "null"}
    df = spark.createDataFrame(list(texts.items()), "id int, payload string")
    items, bad = claims.parse_extraction(df, ["id"], max_items=3)
    got = {}
    for r in bad.collect():
        got.setdefault(r.id, set()).add((r.path, r.rule))
    owner = "$.action_items[0].owner"
    assert got == {
        2: {("$", "invalid_json")}, 3: {("$", "invalid_json")}, 4: {("$", "invalid_json")}, 5: {("$", "repeated_field")}, 6: {("$", "wrong_type")},
        7: {("$.decisions", "missing_field")}, 8: {("$.more", "unknown_field")}, 9: {("$.decisions", "wrong_type")},
        10: {("$.minutes[0].kind", "not_allowed"), ("$.minutes[1].topic", "blank_text")},
        11: {("$.summary[0].text", "wrong_type"), ("$.summary[0].evidence_utterance_ids[0]", "wrong_type"), ("$.summary[0].evidence_utterance_ids[1]", "wrong_type")},
        12: {(owner, "owner_fields")}, 13: {(f"{owner}.name", "unknown_field"), (f"{owner}.speaker_id", "missing_field"), (f"{owner}.display_text", "missing_field")},
        14: {("$.summary", "too_many_items")}, 15: {("$.action_items[0].deadline_text", "wrong_type")}, 16: {("$.summary[0]", "wrong_type")},
        17: {("$", "invalid_json")}, 18: {("$", "wrong_type")}}
    rows = {(r.section, r.item_id): r for r in items.collect()}
    assert set(rows) == {("summary", "sum_0001"), ("minutes", "min_0001"), ("action_items", "act_0001")}
    act = rows["action_items", "act_0001"]
    assert (act.text, act.owner_speaker, act.owner_name, act.deadline_text, act.evidence_ids) == ("a", None, "Ann", None, ["u2", "u3"])


def test_named_owners_need_a_cited_text(spark):
    said = spark.createDataFrame([(1, "u1", "s", "Ann will do it"), (1, "u2", "s", "Annie too")], "meeting_id bigint, utterance_id string, speaker_id string, text string")
    items = [(1, "a", "action_items", None, "Ann", None, ["u1"]), (1, "b", "action_items", None, "Ann", None, ["u2"]), (1, "c", "action_items", None, None, None, ["u2"])]
    df = spark.createDataFrame(items, "meeting_id bigint, item_id string, section string, owner_speaker string, owner_name string, deadline_text string, evidence_ids array<string>")
    assert {(r.record_id, r.rule) for r in claims.claim_violations(df, said).collect()} == {("b", "named_owner_not_cited")}


def test_nested_fields_of_a_stage(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, n double, parts array<struct<k: string, v: bigint>>, schema_version string")
    part = {"k": "a", "v": 1}
    rows = [{"id": "a", "n": 1, "parts": [part], "schema_version": "1.0"}, {"id": "b", "n": 2.5, "parts": [part, {"k": "b"}], "schema_version": "1.0"},
            {"id": "c", "n": 2, "parts": [{**part, "w": 1}], "schema_version": "1.0"}, {"id": "d", "n": 2, "parts": None, "schema_version": "0.9"}]
    lines = [*map(json.dumps, rows), '{"id": "e", "n": 1e999, "parts": [], "schema_version": "1.0"}', '{"id": "f", "n": NaN, "parts": [], "schema_version": "1.0"}']
    (tmp_path / "s.json").write_text("\n".join(lines))
    good, bad = readers.read_stage(spark, schema, str(tmp_path / "s.json"))
    assert [r.id for r in good.collect()] == ["a"]
    got = {(json.loads(r.line)["id"], r.path, r.rule) for r in bad.collect()}
    assert got == {("b", "$.parts[1].v", "missing_field"), ("c", "$.parts[0].w", "unknown_field"), ("d", "$.schema_version", "not_allowed"),
                   ("e", "$.n", "not_finite"), ("f", "$", "invalid_json")}


def test_recogniser_rules(spark, tmp_path):
    seg, word = {"start": 0.0, "end": 1.5, "text": "a b"}, {"word": "a", "start": 0.25, "end": 0.5}
    base = {"meeting_id": 1, "offset_ms": 0, "duration": 600.0, "text": "a b", "language": "en"}
    chunks = [
        {**base, "chunk": 1, "segments": [seg], "words": [word], "extra": 1}, {**base, "chunk": 2, "segments": [{**seg, "start": -1.0}], "words": [{**word, "end": 0.1}]},
        {**base, "chunk": 3, "segments": [seg, {**seg, "end": 602.0}], "words": [word, {**word, "start": 0.1}]}, {**base, "chunk": 4, "segments": [], "words": [word]},
        {**base, "chunk": 5, "segments": [{"start": "x", "end": 1, "text": "t"}], "words": [word]}, {**base, "chunk": 6, "segments": [{"end": 1, "text": "t"}], "words": [word]}]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, chunks), "{nope", '{"meeting_id": 1, "chunk": 7, "text": "", "segments": [{"start": 0, "end": 1e999, "text": "t"}]}']))
    segments, words, bad = readers.scan_asr_responses(spark, str(tmp_path / "a.json"))
    got = {(r.chunk, r.path, r.rule) for r in bad.collect()}
    assert got == {
        (2, "$.segments[0]", "negative_time"), (2, "$.words[0]", "ends_before_start"), (3, "$.segments[1]", "outside_audio"), (3, "$.words[1]", "words_out_of_order"),
        (4, "$", "missing_segments"), (4, "$", "words_without_segments"), (5, "$.segments[0].start", "wrong_type"), (6, "$.segments[0].start", "missing_field"),
        (None, "$", "invalid_json"), (7, "$.segments[0].end", "not_finite")}
    assert {r.chunk for r in words.collect()} == {1, 2, 3, 4} and segments.count() == 4


def tree(rows, fan, levels):
    level = [hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in rows]
    for _ in range(levels):
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return hashlib.sha256(f"{len(rows)}:{level[0]}".encode()).hexdigest()


def test_digest_of_an_ordered_record(spark):
    rows = [{"i": i, "text": f'é "{i}"', "who": None if i % 3 else "a"} for i in range(70)]
    schema = "m bigint, i bigint, text string, who string"
    digest = lambda rs, n: sinks.record_digest(
        spark.createDataFrame([(1, r["i"], r["text"], r["who"]) for r in rs], schema).repartition(n), ["m"], ["i"], ["i", "text", "who"], fan=4).first().digest
    saved = tree(rows, 4, 4)
    assert digest(rows, 1) == digest(list(reversed(rows)), 7) == saved
    moved = [{**r, "text": rows[(r["i"] + 1) % 70]["text"]} for r in rows]
    assert digest(moved, 3) not in (saved, digest([*rows, rows[5]], 3)) and digest([*rows, rows[5]], 3) != saved


def test_shape_of_a_schema():
    shape = strict.shape_of(T.StructType.fromDDL("a int NOT NULL, b array<struct<c: string>>"))
    assert shape.places["$.a"].types == ("integer",) and shape.places["$.b[]"].types == ("object",) and shape.depth() == 3

"""Chunks at their exact serialised size, and cycles longer than any round could walk."""

import json
import random

import pytest

from dialogue_lake.operators import audit, claims, graph

SCHEMA = "meeting_id bigint, utt_idx bigint, utterance_id string, speaker_id string, text string, raw_text string, applied_edit_ids array<string>"
NAMES = ["summary", "minutes", "decisions", "action_items"]


def data(rows):
    said = [{"utterance_id": r[2], "speaker_id": r[3], "refined_text": r[4], "raw_text": r[5], "applied_edit_ids": r[6]} for r in rows]
    return {"UNTRUSTED_MEETING_TRANSCRIPT_DATA": said, "sections": NAMES}


def dumps(rows):
    return json.dumps(data(rows), ensure_ascii=False, sort_keys=True)


def walk(rows, max_chars, overlap, max_chunks):
    """Greedy chunks, measured by serialising them; None if the meeting is refused."""
    sizes = [len(dumps([r])) - len(dumps([])) for r in rows]
    start, out = 0, []
    while start < len(rows):
        end, used = start, len(dumps([]))
        while end < len(rows) and used + sizes[end] + 2 * (end > start) <= max_chars:
            used += sizes[end] + 2 * (end > start)
            end += 1
        if end == start:
            return None
        out.append((start, end - 1))
        if len(out) > max_chunks:
            return None
        if end == len(rows):
            break
        start = max(start + 1, end - overlap)
    return out


def meeting(m, n, seed, longest=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice('abé"\\\n\t/ü中😀\x01') for _ in range(rng.randint(0, longest)))
    return [(m, i, f"utt_{i:06d}", rng.choice(["a", "b", None]), word(), word(), [f"e{k}" for k in range(rng.randint(0, 3))]) for i in range(n)]


@pytest.mark.parametrize("max_chars,overlap,max_chunks", [(1500, 2, 32), (700, 5, 200), (1500, 0, 4)])
def test_chunks_equal_the_serialised_walk(spark, max_chars, overlap, max_chunks):
    meetings = {m: meeting(m, n, m) for m, n in enumerate([1, 3, 40, 90, 7, 12])}
    meetings[6] = meeting(6, 5, 1) + [(6, 5, "utt_000005", "a", "w" * 2000, "", [])] + [(6, 6, "utt_000006", "a", "w", "", [])]
    df = spark.createDataFrame([r for rows in meetings.values() for r in rows], SCHEMA)
    chunks = claims.build_chunks(df, max_chars, overlap, max_chunks)
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk_no or 0):
        got.setdefault(r.meeting_id, []).append(None if r.error else (r.first_utt, r.last_utt))
    expected = {m: walk(rows, max_chars, overlap, max_chunks) for m, rows in meetings.items()}
    assert got == {m: x or [None] for m, x in expected.items()}
    assert any(x and len(x) > 1 for x in expected.values()) and None in expected.values(), expected
    for r in audit.extraction_requests(chunks, df).collect():
        first, last = expected[r.meeting_id][r.chunk_no - 1]
        rows = meetings[r.meeting_id][first : last + 1]
        assert len(r.request) <= max_chars and json.loads(r.request) == data(rows)
        assert len(r.request) == len(dumps(rows))
        schema = json.loads(r.response_schema)
        assert schema["required"] == NAMES
        speakers = sorted({x[3] for x in rows if x[3]})
        owner = schema["properties"]["action_items"]["items"]["properties"]["owner"]["anyOf"]
        assert len(owner) == (3 if speakers else 2)
        assert not speakers or owner[0]["properties"]["speaker_id"]["enum"] == speakers
        cited = schema["properties"]["minutes"]["items"]["properties"]["evidence_utterance_ids"]["items"]["enum"]
        assert cited == [x[2] for x in rows]


def test_a_meeting_of_many_thousand_turns(spark):
    rows = [(1, i, f"utt_{i:06d}", "a", "w" * (i % 37), "", []) for i in range(20000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.chunk_no, r.first_utt, r.last_utt) for r in claims.build_chunks(df, 18000, 2, 1000).collect())
    expected = walk(rows, 18000, 2, 1000)
    assert [(n, *x) for n, x in enumerate(expected, 1)] == got and len(expected) > 100


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or real(df))
    n = 600
    events = [(1, f"e{i:05d}", i) for i in range(1, n + 1)]
    edges = [(1, f"e{i:05d}", f"e{i + 1:05d}") for i in range(1, n)] + [(1, f"e{n - 10:05d}", "e00005"), (1, f"e{n:05d}", f"e{n - 1:05d}")]
    found = graph.cycles(spark.createDataFrame(events, "meeting_id bigint, event_id string, n bigint"),
                         spark.createDataFrame(edges, "meeting_id bigint, src string, dst string")).collect()
    sizes = {}
    for r in found:
        sizes.setdefault((r.cycle_n, r.size), set()).add(r.n)
    assert sizes == {(5, n - 14): set(range(5, n - 9)), (n - 1, 2): {n - 1, n}}
    assert len(rounds) < 60

"""Spans of any length against plain loops, shuffled once."""

import random

from pyspark.sql import functions as F

from dialogue_lake.operators import agreement as ag
from dialogue_lake.operators.intervals import LEVELS, WIDER, range_collect

LEFT = "meeting_id bigint, id bigint, note string, s bigint, e bigint"
RIGHT = "meeting_id bigint, other bigint, s2 bigint, e2 bigint"


def sides():
    rng = random.Random(3)
    lengths = [0, 1, 7, 10, 11, 25, 40, 41, 500, 10 * WIDER**4, 10 * WIDER**LEVELS]
    span = lambda: (a := rng.randrange(-60, 1500), a + rng.choice(lengths))
    left = [(m, i, f"n{i}", *span()) for m in range(3) for i in range(120)] + [(9, 0, "alone", 5, 6)]
    right = [(m, 1000 + i, *span()) for m in range(3) for i in range(60)]
    return left, right


def collected(spark, left, right):
    meets = (F.col("s2") <= F.col("e")) & (F.col("e2") >= F.col("s"))
    return range_collect(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["id"],
        (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), meets, F.col("other"), "found", width=10)


def test_equals_all_pairs_at_every_length(spark):
    left, right = sides()
    want = {(m, i): (n, s, e, sorted(o for m2, o, s2, e2 in right if m2 == m and s2 <= e and e2 >= s)) for m, i, n, s, e in left}
    got = collected(spark, left, right).collect()
    assert len(got) == len(left) and {(r.meeting_id, r.id): (r.note, r.s, r.e, r.found) for r in got} == want


def test_a_span_is_shuffled_once(spark, capsys):
    rows = collected(spark, *sides())
    capsys.readouterr()
    rows.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2


def fractions(spark, spans, cells):
    rows = spark.createDataFrame(spans, "meeting_id bigint, id bigint, note string, speaker_id string, start_ms bigint, end_ms bigint")
    intervals = spark.createDataFrame(cells, "meeting_id bigint, start_ms bigint, end_ms bigint, state string, exclusive_speaker string, "
                                      "regular array<string>, secondary array<string>, mapped array<string>")
    return ag.time_fractions(rows, intervals, ["id"])


def test_shares_of_words_and_long_spans(spark, capsys):
    cells = []
    for k in range(4000):
        who, other = "ab"[k % 2], "ab"[(k // 2) % 2]
        state = ["AGREE", "DISAGREE", "PRIMARY_ONLY", "SILENCE"][k % 4]
        heard = [] if k % 4 > 1 else [f"S{other}"]
        cells.append((1, k * 50, k * 50 + 50, state, who, [who], heard, [other] if heard else []))
    rng = random.Random(5)
    spans = [(1, i, f"n{i}", rng.choice("ab"), a := rng.randrange(0, 200_000), a + rng.choice([0, 1, 60, 300, 9_000, 150_000])) for i in range(60)]
    spans += [(1, 60, "beyond", "a", 900_000, 900_100), (2, 0, "elsewhere", "a", 0, 50)]
    found = fractions(spark, spans, cells)
    for r in found.collect():
        length, share, label = r.end_ms - r.start_ms, dict.fromkeys(("agreement", "disagreement", "primary_only", "silence"), 0), {}
        for m, s, e, state, who, _, _, mapped in cells:
            ms = min(e, r.end_ms) - max(s, r.start_ms)
            if m == r.meeting_id and ms > 0:
                heard = mapped[0] if mapped else None
                kind = {"PRIMARY_ONLY": "primary_only", "SILENCE": "silence"}.get(state) or (
                    "agreement" if heard == who == r.speaker_id else "disagreement")
                share[kind] += ms
                label[heard] = label.get(heard, 0) + ms
        label.pop(None, None)
        best = min(((-ms, who) for who, ms in label.items()), default=(0, None))[1]
        assert (r.note, r.secondary_speaker) == (next(x[2] for x in spans if x[:2] == (r.meeting_id, r.id)), best)
        for name, ms in share.items():
            assert abs(r[f"{name}_fraction"] - (min(1, ms / length) if length else 0)) < 1e-12
    assert found.count() == len(spans)
    capsys.readouterr()
    fractions(spark, spans, cells).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2

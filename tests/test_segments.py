"""Words to segments against the plain walk."""

import random

from dialogue_lake.operators import attribution as at

WORDS = "meeting_id bigint, chunk bigint, word_no bigint, start_ms bigint, end_ms bigint"
SEGMENTS = "meeting_id bigint, chunk bigint, seg_idx bigint, start_ms bigint, end_ms bigint"


def walk(words, segments, slack=500):
    out, place = {}, {}
    for m, c, n, s, e in sorted(words):
        options = [(-max(0, min(e, b) - max(s, a)), abs(s + e - a - b), k) for m2, c2, k, a, b in segments if (m2, c2) == (m, c) and s >= a - slack and e <= b + slack]
        if not options:
            out[m, c, n] = (None, False)
            continue
        here = place.get((m, c), -1)
        pick = min((o for o in options if o[2] >= here), default=None)
        place[m, c] = pick[2] if pick else here
        out[m, c, n] = (place[m, c], pick is not None)
    return out


def test_equals_the_walk_on_tangled_segments(spark):
    rng = random.Random(6)
    words, segments = [], []
    for m in range(3):
        for c in range(2):
            at_ms = 0
            for n in range(120):
                at_ms += rng.choice([0, 50, 200, 400])
                words.append((m, c, n, at_ms + rng.randrange(-300, 300), at_ms + 300 + rng.choice([0, 100])))
            edges = sorted(rng.randrange(0, at_ms) for _ in range(14))
            segments += [(m, c, k, a + rng.randrange(-400, 400), a + rng.choice([600, 1500, 4000, at_ms])) for k, a in enumerate(edges)]
    words = [(m, c, n, s, max(s, e)) for m, c, n, s, e in words]
    got = at.words_to_segments(spark.createDataFrame(words, WORDS), spark.createDataFrame(segments, SEGMENTS)).collect()
    want = walk(words, segments)
    assert {(r.meeting_id, r.chunk, r.word_no): (r.seg_idx, r.compatible) for r in got} == want
    assert any(not ok and seg is not None for seg, ok in want.values())


def test_a_chunk_of_very_many_words(spark):
    n = 300_000
    words = spark.range(n).selectExpr("1L meeting_id", "0L chunk", "id word_no", "id * 300 start_ms", "id * 300 + 280 end_ms")
    segments = spark.range(n // 10).selectExpr("1L meeting_id", "0L chunk", "id seg_idx", "id * 3000 - 200 start_ms", "id * 3000 + 3100 end_ms")
    rows = at.words_to_segments(words, segments)
    bad = rows.filter("not compatible or seg_idx not in (word_no div 10, word_no div 10 - 1, word_no div 10 + 1)").count()
    assert bad == 0 and rows.count() == n

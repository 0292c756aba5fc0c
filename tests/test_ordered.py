"""Bucketed scans must equal plain loops, above all across bucket borders."""

import random

from pyspark.sql import functions as F

from dialogue_lake.operators import intervals as iv
from dialogue_lake.operators import ordered

random.seed(7)
ROWS = [(m, n, random.choice([None, random.randint(0, 9)])) for m in range(3) for n in range(0, 60 - 20 * m)]


def test_scan_equals_loop(spark):
    df = spark.createDataFrame(ROWS, "meeting_id bigint, n bigint, x bigint")
    got = ordered.scan(df, ["meeting_id"], ["n"], ordered.bucket_of("n", 7), [
        ordered.running_sum("s", F.col("x")), ordered.numbered("k"), ordered.running_max("m", F.col("x")),
        ordered.last_before("l", F.col("x")), ordered.previous("p", F.col("x")), ordered.following("f", F.col("x"))]).collect()
    got = {(r.meeting_id, r.n): r for r in got}
    assert len(got) == len(ROWS)
    for meeting in range(3):
        rows = [r for r in ROWS if r[0] == meeting]
        for i, (m, n, x) in enumerate(rows):
            r = got[m, n]
            upto = [v[2] for v in rows[: i + 1]]
            before = [v for v in upto[:-1] if v is not None]
            known = [v for v in upto if v is not None]
            assert r.s == sum(known) and r.k == i + 1
            assert r.m == (max(before) if before else None)
            assert r.l == (known[-1] if known else None)
            assert r.p == (rows[i - 1][2] if i else None)
            assert r.f == (rows[i + 1][2] if i + 1 < len(rows) else None)


def test_islands_across_buckets(spark):
    rows = [(1, n, "ab"[(n // 11) % 2]) for n in range(100)]
    df = spark.createDataFrame(rows, "meeting_id bigint, n bigint, who string")
    got = ordered.islands(df, ["meeting_id"], ["n"], ordered.bucket_of("n", 4), ["who"], lambda a, b: a("who") != b("who"))
    assert {r.n: r.island for r in got.collect()} == {n: n // 11 + 1 for n in range(100)}


def test_preceding_rows_cross_buckets(spark):
    df = spark.createDataFrame([(1, n) for n in range(1, 30)], "meeting_id bigint, n bigint")
    got = ordered.with_preceding(df, ["meeting_id"], "n", 3, F.col("n"), "before", width=4).collect()
    assert {r.n: r.before for r in got} == {n: [x for x in range(n - 3, n) if x > 0] for n in range(1, 30)}


def test_union_intervals(spark):
    rows = [(1, "a", s, e) for s, e in [(0, 5), (5, 7), (8, 30), (9, 10), (31, 32), (12, 31)]]
    df = spark.createDataFrame(rows, "meeting_id bigint, speaker_id string, start_ms bigint, end_ms bigint")
    got = iv.union_intervals(df, ["meeting_id", "speaker_id"], width=6).collect()
    assert sorted((r.start_ms, r.end_ms) for r in got) == [(0, 7), (8, 32)]


def test_overlap_regions(spark):
    rows = [(1, "a", 0, 10), (1, "b", 5, 15), (1, "b", 8, 12), (1, "a", 12, 20), (1, "c", 20, 25)]
    df = spark.createDataFrame(rows, "meeting_id bigint, speaker_id string, start_ms bigint, end_ms bigint")
    got = iv.overlap_regions(df).collect()
    assert sorted((r.start_ms, r.end_ms, r.speakers) for r in got) == [(5, 10, ["a", "b"]), (12, 15, ["a", "b"])]

"""Joins whose sides grow with the text although Spark estimates them as small."""

from pyspark.sql import functions as F

from dialogue_lake.operators import audit, lookup
from dialogue_lake.operators import metrics as me
from dialogue_lake.operators import terms as tm
from dialogue_lake.operators.intervals import range_collect, range_join


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def said(spark):
    rows = [(1, 0, "Alpha beta, al-pha x"), (1, 1, "nothing here"), (2, 0, "alpha ALPHA")]
    return spark.createDataFrame(rows, "meeting_id bigint, utt_idx bigint, text string")


def test_interval_joins_broadcast_neither_side(spark, capsys):
    a = spark.range(3).select(F.lit(1).alias("meeting_id"), "id", (F.col("id") * 100_000).alias("s"), (F.col("id") * 100_000 + 90_000).alias("e"))
    b = a.select("meeting_id", F.col("id").alias("other"), (F.col("s") + 1).alias("s2"), (F.col("e") + 1).alias("e2"))
    spans, meets = ((F.col("s"), F.col("e")), (F.col("s2"), F.col("e2"))), (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
    joined = range_join(a, b, ["meeting_id"], *spans, meets)
    collected = range_collect(a, b, ["id"], *spans, meets, F.col("other"), "found")
    assert "Broadcast" not in plan_of(joined, capsys) + plan_of(collected, capsys)
    assert sorted((r.id, r.other) for r in joined.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted((r.id, tuple(r.found)) for r in collected.collect()) == [(0, (0,)), (1, (1,)), (2, (2,))]


def test_words_of_spans_broadcast_neither_side(spark, capsys):
    found = tm.spans_to_words(tm.ngram_spans(said(spark)), said(spark))
    assert "BroadcastHashJoin" not in plan_of(found, capsys)


def test_exact_terms_send_only_forms_that_match(spark, monkeypatch):
    entries = spark.createDataFrame([("e1", "alpha"), ("e2", "beta")], "entry_id string, canonical string").select(
        "*", *[F.array().cast("array<string>").alias(c) for c in ("aliases", "asr_aliases")])
    sent = []
    real = lookup.counted_join
    monkeypatch.setattr(tm, "counted_join", lambda big, small, *a: sent.append(small.count()) or real(big, small, *a))
    found = tm.exact_candidates(tm.ngram_spans(said(spark)), tm.variant_table(entries))
    assert sent == [5]  # Alpha, alpha, ALPHA, al-pha, beta
    assert sorted((r.meeting_id, r.utt_idx, r.char_start, r.observed, r.entry_id, r.match_type) for r in found.collect()) == [
        (1, 0, 0, "Alpha", "e1", "normalized_exact"), (1, 0, 6, "beta", "e2", "canonical_exact"), (1, 0, 12, "al-pha", "e1", "normalized_exact"),
        (2, 0, 0, "alpha", "e1", "canonical_exact"), (2, 0, 6, "ALPHA", "e1", "normalized_exact")]


def test_a_counted_table_is_broadcast_only_if_few(spark, capsys):
    big, small = spark.range(100).select((F.col("id") % 7).alias("k"), "id"), spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    few, many = (lookup.counted_join(big, small, ["k"], F.col("id"), n) for n in (5, 4))
    assert "BroadcastHashJoin" in plan_of(few, capsys) and "Broadcast" not in plan_of(many, capsys)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 72


def test_copies_under_salts_count_for_a_broadcast(spark, capsys):
    """A table below the threshold whose copies are above it is not sent to every task."""
    big = spark.range(1000).select((F.col("id") % 9).alias("k"), "id")
    small = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100k")
    try:
        assert "BroadcastHashJoin" in plan_of(big.join(small, "k"), capsys)
        joined = lookup.spread_join(big, small, ["k"], F.col("id"))
        assert "SortMergeJoin" in plan_of(joined, capsys) and "BroadcastHashJoin" not in plan_of(joined, capsys)
        left = lookup.spread_join(big, small.filter("k > 2"), ["k"], F.col("id"))
        assert sorted((r.id, r.v) for r in joined.collect()) == [(n, n % 9 * 2) for n in range(1000)]
        assert sorted(r.id for r in left.filter("v IS NULL").collect()) == [n for n in range(1000) if n % 9 <= 2] and left.count() == 1000
    finally:
        spark.conf.set(limit, before)


def test_matching_does_not_carry_texts_along_their_words(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(me, "stored", lambda df: kept.append(df.columns) or df, raising=False)
    outputs = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (1, 2, ["b"]), (1, 3, ["a", "c"])], "case_id bigint, item_no bigint, tokens array<string>")
    gold = spark.createDataFrame(
        [(1, 1, [["a"], ["c", "b"]]), (1, 2, [["b", "x"]]), (1, 3, [["a"], []]), (1, 4, []), (1, 5, [["c", "a"], ["c", "a"]])],
        "case_id bigint, gold_no bigint, keywords array<array<string>>")
    assert sorted((r.item_no, r.gold_no) for r in me.match_gold(outputs, gold).collect()) == [(1, 1), (2, 2), (3, 5)]
    assert kept == [["case_id", "item_no", "_w"]]


def test_coverage_keeps_a_pair_at_the_floor_itself(spark):
    """55 of 100 terms are 0.55, although 100 * 0.55 in floating point is above 55."""
    shared, own = [f"s{n}" for n in range(55)], [f"o{n}" for n in range(45)]
    events = spark.createDataFrame([(1, "e1", "DECISION", "accepted", ["u1"], " ".join(shared + own)), (1, "e2", "DECISION", "accepted", ["u1"], "s1 z1 z2 z3 z4 z5")],
                                   "meeting_id bigint, event_id string, choice string, outcome string, evidence_ids array<string>, text string")
    items = spark.createDataFrame([(1, "i1", "decisions", "fact", ["u2"], " ".join(shared)), (1, "i2", "decisions", "fact", ["u1"], "q")],
                                  "meeting_id bigint, item_id string, section string, kind string, evidence_ids array<string>, text string")
    best, counts = audit.coverage_candidates(events, items, floor=0.55)
    assert sorted((r.event_id, r.item_id, r.shared, round(r.similarity, 6)) for r in best.collect()) == [
        ("e1", "i1", False, 0.55), ("e1", "i2", True, 0.0), ("e2", "i2", True, 0.0)]
    assert sorted(map(tuple, counts.collect())) == [(1, "e1", 2), (1, "e2", 1)]

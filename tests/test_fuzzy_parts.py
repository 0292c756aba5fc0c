"""Fuzzy candidates: string similarity of many pairs at once, bit sets of bags, joins with grown tables."""

import random

from pyspark.sql import functions as F

from dialogue_lake.functions import similarity as sim
from dialogue_lake.operators import lookup


def test_ratios_of_many_pairs_equal_those_of_each():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde é\U0001F600\u0308") for _ in range(rng.choice([0, 1, 3, 9, 20, 62, 63, 64, 70, 600])))
    a, b = ([word() for _ in range(900)] for _ in range(2))
    assert sim.indel_ratios(a, b).tolist() == [sim.indel_ratio_of(x, y) for x, y in zip(a, b)]
    assert sim.lexical_scores(a, b).tolist() == [
        0.75 * sim.indel_ratio_of(x, y) + 0.25 * sim.indel_ratio_of(sim.token_sorted(x), sim.token_sorted(y)) for x, y in zip(a, b)]
    assert sim.indel_ratios([], []).tolist() == [] and sim.indel_ratios(["", ""], ["", "a"]).tolist() == [1.0, 0.0]


def test_bit_sets_never_deny_a_shared_element():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij klmнé\U0001F600") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    elements, starts, sets = sim.bags_of(texts)
    bags = [elements[x:y].tolist() for x, y in zip(starts, starts[1:])]
    assert [len(x) for x in bags] == [len(t) for t in texts] and all(x == sorted(set(x)) for x in bags)
    for i in range(0, 300, 7):
        for j in range(300):
            alone = len(set(bags[i]) - set(bags[j]))
            assert all((int(s[i]) & ~int(s[j]) & (1 << 64) - 1).bit_count() <= alone for s in sets)


def test_a_table_that_has_grown_is_hardly_copied(spark, monkeypatch):
    copies = []
    real = lookup.spread_join
    monkeypatch.setattr(lookup, "spread_join", lambda *a: copies.append(a[5]) or real(*a))
    big, small = spark.range(300).select((F.col("id") % 200).alias("k"), "id"), spark.range(160).withColumnRenamed("id", "k")
    assert [lookup.counted_join(big, small, ["k"], F.col("id"), few).count() for few in (200, 159, 40, 9)] == [260] * 4
    assert copies == [15, 4, 1]

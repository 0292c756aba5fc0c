"""Hard negatives against a plain walk over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogue_lake.llm import hard_negatives
from dialogue_lake.llm.hard_negatives import Index, mined, search

SCHEMA = "vec_id long, embedding array<float>, label int, id long, q string, angles string, stripe int"


def walk(rows, every):
    """All pairs, one after the other."""
    own = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        own[vec_id] = min(own.get(vec_id, row), row)
    size = max((len(q) for _, q in own.values()), default=0)
    own = {i: (label, q + [0] * (size - len(q))) for i, (label, q) in own.items()}
    out = set()
    for a, (label, q) in own.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r, strict=True)), i, other) for i, (other, r) in own.items() if i != a]
        scores.sort()
        positives = [(-s, i) for s, i, other in scores if other == label][:5]
        for high, p in positives:
            fits = [(-s, i) for s, i, other in scores if other != label and 80 * high <= -100 * s <= 100 * high][:5]
            out |= {(a, p, rank + 1, i, high, s) for rank, (s, i) in enumerate(fits)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "q", "a", 2) for r in rows], SCHEMA)


def clustered(n, seed, spread=0.1, dim=8, groups=6, longest=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    of = rng.integers(0, groups, n)
    vectors = (centres[of] + rng.normal(size=(n, dim)) * spread) * rng.uniform(0.2 if longest > 1 else 1, longest, (n, 1))
    labels = (of + (rng.random(n) < 0.2)) % 4
    return [(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels, strict=True))]


def results(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


ODD = [
    (1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan"), 0.5], 1), (1030, [float("inf")], 2), (1040, [0.5] * 8, None),
    (None, [0.5] * 8, 1), (1050, [], 1), (1060, [0.0] * 8, 2), (1070, [0.7], 3), (5, [0.1] * 8, 0), (1080, [1e30] * 8, 1),
    *[(2000 + i, [0.5, -0.5] * 4, i % 2) for i in range(60)], *[(2000, [0.5, -0.5] * 4, 1)] * 3]


def test_equals_the_walk_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIPE", 40)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    rows = clustered(300, 1) + ODD
    expected = walk([r for r in rows if r[0] != 1080], 10)
    assert len(expected) > 300
    assert results(mined(frame(spark, rows), every=10)) == expected


@pytest.mark.parametrize("rows", [[], [(10, [1.0], 1)], [(10, None, 1)], [(10, [], 1), (20, [], 2), (30, [], 1)]])
def test_small_tables(spark, rows):
    assert results(mined(frame(spark, rows), every=10)) == walk(rows, 10)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(1 << 20, 1 << 22, 4)], i % 3) for i in range(60)]
    assert results(mined(frame(spark, rows), every=10)) == walk(rows, 10)


def test_whole_stripes_are_skipped(spark, monkeypatch):
    """In separated clusters most pairs of stripes and groups never meet."""
    monkeypatch.setattr(hard_negatives, "STRIPE", 50)
    monkeypatch.setattr(hard_negatives, "GROUP", 10)
    index = Index(frame(spark, clustered(2000, 2, spread=0.02, longest=1)), F.col("id") % 10 == 0, "vec_id", "embedding", "label")
    asked = index.anchors.withColumn("windows", F.array(F.struct(
        F.lit(0).cast("long").alias("key"), (0.9 * F.col("norm") ** 2).cast("long").alias("low"), F.lit(1 << 60).alias("high"))))
    pairs = hard_negatives.reachable(index.rows, asked, index.n_groups, index.width).count()
    assert pairs < 0.6 * index.n_stripes * index.n_groups


def test_bounds_hold():
    """A window that no bound can exclude by more than rounding is never missed."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    q = rng.integers(-200, 200, (40, 6))
    directions = q[:3] / np.linalg.norm(q[:3], axis=1)[:, None]
    norms = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q / norms[:, None] @ directions.T, -1, 1)).astype(np.float32)
    left = pa.table({"id": pa.array(range(40)), "label": pa.array([0] * 40), "norm": norms, "q": pa.array(q.tolist()), "angles": pa.array(angles.tolist(), pa.list_(pa.float32()))})
    score = q @ q.T
    for a in range(40):
        for b in range(40):
            s = int(score[a, b])
            windows = pa.array([[{"key": 1, "low": s, "high": s}]])
            right = left.slice(a, 1).append_column("windows", windows)
            got = search(6, 3, True, 50)(left, right)
            assert (b in got["id"].to_pylist()) == (a != b)

"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. For two vectors with angles
``a`` and ``x`` to one reference the angle between them lies in ``[|a - x|, a + x]``; over
all references the cosine has an upper and a lower bound, and times both norms these bound
the score. The bounds are widened for the rounding of stored angles, so they hold for the
integer inner product. Only rows whose interval meets one of an anchor's score windows are
scored.

Rows are sorted by nearest reference and angle into stripes of about ``STRIPE`` rows,
anchors into groups of about ``GROUP``. A stripe meets a group only if their ranges of
angles and norms allow a score in the group's windows; a pair of the two is one small task
of bounded memory, whatever label or vector is frequent. Each task returns the best rows of
each window, which one ranking merges.

Three passes use the same function: anchors against their own stripe give a floor for the
positives; against all stripes above the floor, the positives; each positive opens a window
for its negatives.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part, nor do vectors whose scores could leave a long. Shorter vectors
are padded with zeros. Rows of one id count once: the smallest label, then the smallest
vector. A zero vector scores 0 with all. An empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx

SCALE = 256
#: The references are chosen from so many vectors, those of the smallest hash of their id.
SAMPLE = 2048
REFERENCES = 8
STRIPE, GROUP = 4096, 256
POSITIVES = NEGATIVES = 5
#: Percent of its positive's score that a negative has at least.
LEAST = 80
#: Bounds a cosine's error from angles stored as floats.
SLACK = 2e-6
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
BATCH = 64

FOUND = "anchor_id long, key long, id long, score long"


def quantised(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(id, label, q) with integer components, one row per id, and the vectors' length."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"), finite.alias("finite"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.col("finite"))
    dim = own.agg(F.max(F.size("x"))).first()[0] or 0
    most = isqrt(HIGHEST // max(dim, 1))
    padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("x")))
    own = own.select("id", "label", F.transform(padded, lambda v: F.floor(v * SCALE)).alias("q"))
    own = own.filter(F.forall("q", lambda v: (v <= most) & (v >= -most)))
    own = own.groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.label", "v.q")
    return own, dim


def references(rows: DataFrame, dim: int) -> np.ndarray:
    """Directions far from each other among a bounded sample of the vectors."""
    sample = rows.select("id", "q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("q").toArrow()["q"]
    vectors = np.array(sample.to_pylist(), float).reshape(len(sample), dim)
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, max(dim, 1))[:, :dim]
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(REFERENCES, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def with_angles(rows: DataFrame, dim: int, directions: np.ndarray) -> DataFrame:
    """Rows with their norm and angles to the references."""

    def measure(batches):
        for batch in batches:
            vectors = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, dim)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = (vectors / np.where(norms > 0, norms, 1)[:, None]) @ directions.T
            angles = np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)
            width = directions.shape[0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(angles) * width + 1, width, dtype=np.int32)), pa.array(angles.ravel())),
                 pa.array(np.argmin(angles, axis=1).astype(np.int32)), pa.array(angles.min(axis=1, initial=4))],
                names=["id", "label", "q", "norm", "angles", "nearest", "angle"])

    return rows.mapInArrow(measure, "id long, label long, q array<long>, norm double, angles array<float>, nearest int, angle float")


def striped(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows in ranges of (nearest reference, angle) of about ``size`` rows, numbered in ``name``; stored."""
    n = max(1, -(-rows.count() // size))
    found = rows.repartitionByRange(n, "nearest", "angle", "id").withColumn(name, F.spark_partition_id())
    found = tx.stored(found, f"hn-{name}")
    return found, (found.agg(F.max(name)).first()[0] or 0) + 1


def _numbers(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if width is not None else column)
    return flat if width is None else flat.reshape(len(column), width)


def search(dim: int, width: int, same: bool, most: int):
    """The function of one task: rows of a stripe against anchors with their windows."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids, labels, norms = (_numbers(left[c]) for c in ("id", "label", "norm"))
            rows, angles = _numbers(left["q"], dim), _numbers(left["angles"], width).astype(float)
            exact = rows.astype(float)
            cos, sin = np.cos(angles), np.sin(angles)
            largest = int(np.abs(rows).max(initial=0))
            for at in range(0, right.num_rows, BATCH):
                part = right.slice(at, BATCH)
                own, own_labels, own_norms = (_numbers(part[c]) for c in ("id", "label", "norm"))
                anchors, own_angles = _numbers(part["q"], dim), _numbers(part["angles"], width).astype(float)
                windows = part["windows"].to_pylist()
                upper = np.full((len(own), len(ids)), 1.0)
                lower = np.full((len(own), len(ids)), -1.0)
                for k in range(width):
                    near = np.outer(np.cos(own_angles[:, k]), cos[:, k])
                    far = np.outer(np.sin(own_angles[:, k]), sin[:, k])
                    np.minimum(upper, near + far, out=upper)
                    np.maximum(lower, near - far, out=lower)
                scale = np.outer(own_norms, norms)
                upper = (upper + SLACK) * scale + 1
                lower = (lower - SLACK) * scale - 1
                alike = own_labels[:, None] == labels
                allowed = alike & (own[:, None] != ids) if same else ~alike
                meets = np.zeros_like(allowed)
                for i, own_windows in enumerate(windows):
                    for w in own_windows:
                        meets[i] |= (upper[i] >= w["low"]) & (lower[i] <= w["high"])
                meets &= allowed
                columns = np.flatnonzero(meets.any(axis=0))
                if not len(columns):
                    continue
                small = dim * largest * int(np.abs(anchors).max(initial=0)) < 1 << 53
                scores = (anchors.astype(float) @ exact[columns].T).astype(np.int64) if small else anchors @ rows[columns].T
                for i, own_windows in enumerate(windows):
                    open_columns = np.flatnonzero(meets[i, columns])
                    got = scores[i, open_columns]
                    for w in own_windows:
                        inside = np.flatnonzero((got >= w["low"]) & (got <= w["high"]))
                        if len(inside) > most:
                            floor = np.partition(got[inside], -most)[-most]
                            inside = inside[got[inside] >= floor]
                            # Stable: rows are in order of their ids, so ties are too.
                            inside = inside[np.argsort(-got[inside], kind="stable")[:most]]
                        if len(inside):
                            n = len(inside)
                            out.append((np.full(n, own[i]), np.full(n, w["key"]), ids[columns[open_columns[inside]]], got[inside]))
        joined = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table([pa.array(x, pa.int64()) for x in joined], names=["anchor_id", "key", "id", "score"])

    return best


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each window, with their rank."""
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def reachable(stripes: DataFrame, groups: DataFrame, n_groups: int, width: int) -> DataFrame:
    """(stripe, grp): pairs whose angles and norms allow a score as high as the group's lowest window."""

    def extent(df: DataFrame, by: str, p: str, *more: Column) -> DataFrame:
        angle = lambda k: F.get("angles", F.lit(k)).cast("double")
        return df.groupBy(by).agg(
            *[f(angle(k)).alias(f"{p}{f.__name__}{k}") for f in (F.min, F.max) for k in range(width)],
            F.min("norm").alias(f"{p}norm"), F.max("norm").alias(f"{p}norms"), *more)

    lowest = F.min(F.array_min(F.transform("windows", lambda w: w.low))).alias("low")
    pairs = extent(stripes, "stripe", "x").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(
        extent(groups, "grp", "a", lowest), "grp")
    for k in range(width):
        gap = F.greatest(F.lit(0.0), F.col(f"amin{k}") - F.col(f"xmax{k}"), F.col(f"xmin{k}") - F.col(f"amax{k}"))
        cosine = F.cos(gap) + SLACK
        scale = F.when(cosine >= 0, F.col("anorms") * F.col("xnorms")).otherwise(F.col("anorm") * F.col("xnorm"))
        pairs = pairs.filter(cosine * scale + 1 >= F.col("low"))
    return pairs.select("stripe", "grp")


class Index:
    """All vectors in stripes, and the anchors among them in groups."""

    def __init__(self, rows: DataFrame, anchors: Column, key: str, vector: str, label: str):
        own, self.dim = quantised(rows, key, vector, label)
        own = tx.stored(own, "hn-vectors")
        directions = references(own, self.dim)
        self.width = directions.shape[0]
        self.rows, self.n_stripes = striped(with_angles(own, self.dim, directions), STRIPE, "stripe")
        self.anchors, self.n_groups = striped(self.rows.filter(anchors), GROUP, "grp")

    def near(self, same: bool, most: int) -> DataFrame:
        """The best rows of the anchors' own stripes."""
        everything = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
        asked = self.anchors.withColumn("windows", everything)
        return self.rows.groupBy("stripe").cogroup(asked.groupBy("stripe")).applyInArrow(
            search(self.dim, self.width, same, most), FOUND)

    def best(self, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """(anchor_id, key, id, score): the best rows of each window (anchor_id, key, low, high)."""
        # A few windows an anchor: no list grows with the data.
        own = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("key", "low", "high")).alias("windows"))
        asked = tx.stored(self.anchors.drop("stripe").join(own.withColumnRenamed("anchor_id", "id"), "id"), "hn-asked")
        pairs = tx.stored(reachable(self.rows, asked, self.n_groups, self.width), "hn-pairs")
        left = self.rows.join(pairs, "stripe")
        right = asked.join(pairs, "grp")
        return left.groupBy("grp", "stripe").cogroup(right.groupBy("grp", "stripe")).applyInArrow(
            search(self.dim, self.width, same, most), FOUND)


def mined(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
          anchors: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``; without it, ids divisible by ``every``.
    """
    index = Index(rows, F.col("id") % every == 0 if anchors is None else anchors, key, vector, label)
    floors = ranked(index.near(True, POSITIVES), POSITIVES).filter(F.col("rank") == POSITIVES).select(
        "anchor_id", F.col("score").alias("low"))
    windows = index.anchors.select(F.col("id").alias("anchor_id")).join(floors, "anchor_id", "left").select(
        "anchor_id", F.lit(0).cast("long").alias("key"), F.coalesce("low", F.lit(LOWEST)).alias("low"), F.lit(HIGHEST).alias("high"))
    positives = tx.stored(ranked(index.best(windows, True, POSITIVES), POSITIVES).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hn-positives")
    # The smallest score with 100 * score >= LEAST * positive_score; below zero no score fits.
    # The remainder goes first, so that no product leaves a long.
    low = F.expr(f"{LEAST} * (positive_score div 100) + cast(ceil({LEAST} * (positive_score % 100) / 100) as long)")
    windows = positives.filter("positive_score >= 0").select(
        "anchor_id", F.col("positive_id").alias("key"), low.alias("low"), F.col("positive_score").alias("high"))
    found = ranked(index.best(windows, False, NEGATIVES), NEGATIVES)
    return found.withColumnRenamed("key", "positive_id").join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

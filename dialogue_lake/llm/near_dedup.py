"""Near-duplicates by b-bit MinHash.

A text is the set of its shingles. Texts of equal sets are one class, which its smallest
id stands for. Of the first ``BANDED`` minima of a class, groups of ``ROWS`` make band keys;
classes that share a band are candidates. Only the low bits of the minima are kept, packed into
longs: the number of equal fields, corrected for chance hits, estimates the similarity and
drops hopeless candidates. The others are confirmed on their full sets.

No bucket is expanded into all pairs. Every class of a bucket is first compared with the
bucket's centre; links merge components, and only classes of different components in one
bucket are compared further. At similarity 0.8 a pair shares no band once in 20 million.

A missing or empty text has no shingles, is linked with nothing and keeps its own id.
Repeated rows get the same answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import components
from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.hashed_words import Words, blocks

#: Minima of a text; the first of them make the bands, the low bits of all the estimate.
HASHES, BANDED, ROWS, LOW_BITS = 768, 128, 4, 2
PERCENT = 80
#: 4.5 standard deviations of the estimate below the threshold.
MARGIN = 0.077
STAR_ROUNDS = 2
#: Up to so many ids are sent to every task to pick their texts; more are joined by shuffling.
FEW_IDS = 500_000

SKETCH = "id long, n_shingles long, class_hi long, class_lo long, low array<long>, bands array<long>"


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its set's size and digest, packed low bits and band keys."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 1 << 32, HASHES).astype(np.uint32)
    fields = 64 // LOW_BITS

    def sketch(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = (np.arange(HASHES) % fields * LOW_BITS).astype(np.uint64)
        weights = np.random.default_rng(11).integers(0, 1 << 63, (BANDED // ROWS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for table in tables:
            for at, texts in blocks(table.column(1)):
                hashes, starts = Words(texts).shingles(words)
                held = np.flatnonzero(np.diff(starts))
                minima = np.zeros((len(held), HASHES), np.uint32)
                if len(held):
                    short = (hashes >> np.uint64(32)).astype(np.uint32)
                    for j in range(HASHES):
                        minima[:, j] = np.minimum.reduceat((short ^ masks[j]) * factors[j], starts[held])
                low = (minima & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64) << shifts
                packed = np.bitwise_or.reduce(low.reshape(len(held), -1, fields), axis=2).view(np.int64)
                grouped = (minima[:, :BANDED].astype(np.uint64).reshape(len(held), -1, ROWS) * weights).sum(axis=2, dtype=np.uint64)
                grouped = ((grouped ^ (grouped >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                n = np.zeros(len(texts), np.int64)
                digests = np.zeros((len(texts), 2), np.int64)
                for i in held:
                    own = np.unique(hashes[starts[i] : starts[i + 1]])
                    n[i] = len(own)
                    digests[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                lists = lambda values, width: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum((n > 0) * width)]).astype(np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).slice(at, len(texts)), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     lists(packed, HASHES // fields), lists(grouped, BANDED // ROWS)],
                    names=["id", "n_shingles", "class_hi", "class_lo", "low", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sketch, SKETCH)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full set of each (id, text) row."""

    def sets(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at, texts in blocks(table.column(1)):
                hashes, starts = Words(texts).shingles(words)
                own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).slice(at, len(texts)), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(sets, "id long, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: equal fields, corrected for equality by chance."""
    longs, fields = HASHES * LOW_BITS // 64, 64 // LOW_BITS
    ones = int("01" * fields, 2)
    differs = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(longs)]
    unequal = sum(F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(ones))) for x in differs)
    chance = 2.0**-LOW_BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def hopeful(a: str, b: str) -> Column:
    """Whether the sizes and the estimate of two sketches allow a link."""
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= PERCENT * F.greatest(f"{a}n", f"{b}n")
    return sizes & (estimate(F.col(f"{a}low"), F.col(f"{b}low")) >= PERCENT / 100 - MARGIN)


def picked(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the ids of a stored table, one row each."""
    few = ids.count() <= FEW_IDS
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(
        F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])


class Links:
    """Confirms candidate pairs on full sets; the sets of ids met before are kept."""

    def __init__(self, docs: DataFrame, facts: DataFrame, words: int, key: str, text: str):
        self.docs, self.facts, self.words, self.key, self.text = docs, facts, words, key, text
        self.sets = self.seen = None

    def among(self, pairs: DataFrame) -> DataFrame:
        """The links among hopeful pairs (a < b) that were not compared before."""
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = tx.stored(pairs, "nd-pairs")
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("id"), "id", "left_anti")
        ids = tx.stored(ids, "nd-ids")
        sets = tx.stored(shingle_sets(picked(self.docs, ids, self.key, self.text), self.words), "nd-sets")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        first = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        second = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return tx.stored(pairs.join(first, "a").join(second, "b").filter(
            100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "nd-links")

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        side = lambda p: self.facts.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("low").alias(f"{p}_low"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(hopeful("a_", "b_")).select("a", "b")


def components_of(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    found = tx.stored(sketches(docs, words, key, text), "nd-sketches")
    classes = tx.stored(found.filter("n_shingles > 0").groupBy("class_hi", "class_lo").agg(
        F.min("id").alias("component")), "nd-classes")
    # One sketch per class; a class's rows are equal but for the id.
    leaders = found.join(classes.select("component"), F.col("id") == F.col("component"), "left_semi").dropDuplicates(["id"])
    leaders = tx.stored(leaders.select("id", F.col("n_shingles").alias("n"), "low", "bands"), "nd-leaders")
    banded = leaders.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
    rows = tx.stored(banded.join(shared, "band"), "nd-rows")
    links = Links(docs, leaders, words, key, text)
    labels = leaders.select("id", F.col("id").alias("component"))
    for turn in range(STAR_ROUNDS):
        # The centre of a bucket is its smallest id, in a later round its smallest hash.
        rank = F.col("id") if turn == 0 else F.xxhash64("id", "band", F.lit(turn))
        live = rows.join(labels, "id")
        centres = live.groupBy("band").agg(
            F.min(F.struct(rank.alias("r"), F.col("id"), F.col("component"))).alias("c"),
            F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(
            "band", F.col("c.id").alias("a"), F.col("c.component").alias("ca"))
        pairs = live.join(centres, "band").filter("component != ca").select("a", F.col("id").alias("b"))
        labels = components.merged(labels, links.among(links.hopeful(pairs)))
    # What is left: classes of one bucket that lie in different components. A pair counts in
    # its first common bucket; the join itself drops hopeless pairs.
    live = rows.join(labels, "id")
    split = live.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    live = live.join(split, "band").join(leaders, "id")
    side = lambda p: live.select("band", *[F.col(c).alias(p + c) for c in ("id", "component", "n", "low", "bands")])
    left = side("a_").join(side("b_"), "band").filter(
        (F.col("a_component") < F.col("b_component")) & hopeful("a_", "b_")
        & (F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0)) == F.col("band")))
    left = left.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return _answers(found, classes, components.merged(labels, links.among(left)))


def _answers(found: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    own = classes.select("class_hi", "class_lo", F.col("component").alias("id")).join(labels, "id").select(
        "class_hi", "class_lo", F.col("component").alias("_component"))
    return found.join(own, ["class_hi", "class_lo"], "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("id")).alias("component_id"))

"""Packing into fixed-size sequences by cutting-stock column generation.

A document's tokens are cut at multiples of the sequence length; the rest of each document
is one item. Items are counted by length class, a linear program over patterns of classes
is solved by column generation (a knapsack program prices new patterns), its solution is
rounded down and what remains is filled first-fit. Only the histogram reaches the driver:
one number for each class. Patterns are then dealt to the items by their rank in a class,
which comes from counts by class and bucket, so no task holds all items of a class.

A missing text is empty: its document is the one end token. Repeated rows are packed as
often as they come; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.token_counts import batches, tokenizer

SEQUENCE = 2048
STEP = 16
END_TOKEN = 1
CACHE_WORDS = 700_000
RANK_BUCKETS = 64

PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of whole texts as bytes; a word is encoded once while the cache holds it.

    The tokenizer drops white space, never joins words across it, and takes a run of
    letters for one unit whose last token ends a word. So words share what is left without
    their capitals and final stops, and plain words are encoded many at a time.
    """

    def __init__(self, path: str):
        own = tokenizer(path)
        self.encode = own.encode_batch_fast
        vocabulary = own.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.units: dict[bytes, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        found = [x.encode().split() for x in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.units = {}, {}
            new = set().union(*found)
        self.learn(new)
        ids = [b"".join(map(self.known.__getitem__, x)) for x in found]
        for x in new:
            if len(x) > 64:
                del self.known[x]
        return ids

    def learn(self, new: set[bytes]) -> None:
        parts = []
        for word in new:
            core, tail = word, b""
            # "<|" may begin a special token, which has its own letter case.
            if b"<|" not in word:
                core = word.rstrip(b".,")
                if len(core) < len(word) and core[-1:].isalpha():
                    tail = word[len(core) :]
                else:
                    core = word
                core = core.lower()
            parts.append((word, core, tail))
        units = {x[1] for x in parts}.union({x[2] for x in parts if x[2]}).difference(self.units)
        plain = [x for x in units if x.isalpha() or not x.isascii() and x.decode().isalpha()]
        for batch in batches([" ".join(x.decode() for x in plain[i : i + 64]) for i in range(0, len(plain), 64)]):
            for text, encoded in zip(batch, self.encode(batch, add_special_tokens=False), strict=True):
                ids, words = np.asarray(encoded.ids, "<u4"), text.split(" ")
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(words):
                    data, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self.units.update([(w.encode(), data[a:b]) for w, a, b in zip(words, starts[:-1], starts[1:], strict=True)])
        for batch in batches([x.decode() for x in units if x not in self.units]):
            for unit, encoded in zip(batch, self.encode(batch, add_special_tokens=False), strict=True):
                self.units[unit.encode()] = np.asarray(encoded.ids, "<u4").tobytes()
        own = self.units
        self.known.update([(word, own[core] + own[tail] if tail else own[core]) for word, core, tail in parts])
        for unit in units:
            if len(unit) > 64:
                del self.units[unit]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document cut at multiples of ``length``."""

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(path), np.asarray([END_TOKEN], "<u4").tobytes()
        for table in tables:
            out: list[tuple[int, ...]] = []
            for begin in range(0, table.num_rows, 128):
                part = table.slice(begin, 128)
                for own, ids in zip(part.column(0).to_pylist(), ids_of.texts([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    out += [
                        (own, at, min(length, total - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), total)
                        for at in range(0, total, length)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of classes 1..len(prices) whose sum is at most ``capacity``."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for size in range(1, capacity + 1):
        options = prices[:size][: len(prices)] + value[size - 1 :: -1][: len(prices)]
        pick = int(np.argmax(options))
        if options[pick] > value[size - 1] + 1e-12:
            value[size], last[size] = options[pick], pick + 1
        else:
            value[size], last[size] = value[size - 1], 0
    pattern, size = np.zeros(len(prices), int), capacity
    while size:
        if last[size]:
            pattern[last[size] - 1] += 1
            size -= last[size]
        else:
            size -= 1
    return float(value[capacity]), pattern


def relaxed(demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and amounts of the linear program: fewest sequences that hold ``demand``.

    The classes are 1, 2, ... with ``demand`` items each. The revised simplex method starts
    from patterns of one class and prices columns with ``best_pattern``.
    """
    n = len(demand)
    basis = np.diag(capacity // np.arange(1, n + 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    amounts = inverse @ demand
    for _ in range(rounds):
        worth, pattern = best_pattern(inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-6:
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        amounts = np.maximum(amounts - ratio[leaves] * change, 0)
        amounts[leaves] = ratio[leaves]
        row = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, row)
        inverse[leaves] = row
        basis[:, leaves] = pattern
    return basis.astype(int).T, amounts


def planned(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how often, pattern) that hold ``demand`` exactly: the rounded program, then first-fit."""
    left, plan = demand.astype(int).copy(), []
    used = np.flatnonzero(left)
    if not len(used):
        return plan
    patterns, amounts = relaxed(demand.astype(float), capacity)
    for pattern, amount in zip(patterns, amounts, strict=True):
        held = pattern > 0
        times = min(int(amount + 1e-6), int((left[held] // pattern[held]).min())) if held.any() else 0
        if times:
            plan.append((times, pattern))
            left -= times * pattern
    while left.any():
        # The largest items first, as often as the same choice repeats.
        pattern, room = np.zeros(len(left), int), capacity
        for size in range(len(left), 0, -1):
            fits = min(room // size, int(left[size - 1]))
            pattern[size - 1], room = fits, room - fits * size
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((times, pattern))
        left -= times * pattern
    return plan


def dealing(plan: list[tuple[int, np.ndarray]]) -> list[tuple[int, ...]]:
    """(class, from, upto, first sequence, items a sequence): which ranks go where."""
    rows, sequence = [], 0
    taken = np.zeros(len(plan[0][1]), int) if plan else None
    for times, pattern in plan:
        for i in np.flatnonzero(pattern):
            rows.append((int(i) + 1, int(taken[i]), int(taken[i] + times * pattern[i]), sequence, int(pattern[i])))
            taken[i] += times * pattern[i]
        sequence += times
    return rows


def ranked(items: DataFrame, group: str) -> DataFrame:
    """``items`` with ``rank`` from 0 within ``group``, through counts by bucket."""
    bucket = F.pmod(F.xxhash64("key", "start"), F.lit(RANK_BUCKETS))
    items = items.withColumn("_bucket", bucket)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = items.groupBy(group, "_bucket").count().select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before.partitionBy(group)), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("key", "start", "ids_crc32")) - 1
    return items.withColumn("_inside", inside).join(
        starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "rank", F.col("_from") + F.col("_inside")).drop("_bucket", "_group", "_b", "_from", "_inside")


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, step: int = STEP) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of ``docs``."""
    spark = docs.sparkSession
    # Class 0 holds whole sequences; the others round a length up to a multiple of ``step``.
    cut = tx.stored(pieces(docs, path, key, text, length).withColumn(
        "class", F.when(F.col("length") == length, 0).otherwise(F.ceil(F.col("length") / step)).cast("int")), "pack-pieces")
    demand = np.zeros(length // step, int)
    whole = 0
    for row in cut.groupBy("class").count().collect():  # at most length / step + 1 rows
        if row["class"]:
            demand[row["class"] - 1] = row["count"]
        else:
            whole = row["count"]
    deals = spark.createDataFrame(
        dealing(planned(demand, length // step)) or [(-1, 0, 0, 0, 1)], "_class int, _lo long, _hi long, _first long, _each int")
    # At most length / step patterns and first-fit sequences of as many classes.
    items = ranked(cut, "class")
    dealt = items.filter("class > 0").join(
        F.broadcast(deals), (F.col("class") == F.col("_class")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    dealt = dealt.withColumn("sequence_id", whole + F.col("_first") + F.floor((F.col("rank") - F.col("_lo")) / F.col("_each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens"]
    return dealt.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")).unionByName(
        items.filter("class = 0").select(*columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))

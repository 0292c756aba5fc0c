"""Repeated passages by a depth-limited radix sort of suffixes.

Of every suffix only the first ``WINDOW`` bytes matter. Suffixes are put into groups by
passes, most significant digit first; a suffix alone in its group is unlike all others and
takes no part in the next pass. Groups that are left at full depth are exactly the repeated
windows, and their bytes go.

* The first digit of a window is its seed: of its stretches of ``SEED`` bytes the one of
  smallest digest, the leftmost of equal ones. Equal windows have equal seeds at equal places
  inside, and neighbouring windows mostly share theirs, so one row, a run of windows with one
  seed, stands for a hundred suffixes.
* The second digit is the run's whole extent. Runs of equal extent repeat as a whole.
* Runs that share a seed but differ in extent, at the borders of passages, are compared at
  full depth window by window, one run for each distinct extent. A seed with up to ``FEW``
  extents is one small group; for others each window is a row of its own, so that no group
  grows with a frequent passage.

Digests of stretches come from running sums over blocks of texts. A run is told apart by two
64-bit digests, a window by two. Rows are known by their id and a digest of the text: equal rows
count as two occurrences and get the same answer, different texts of one id are kept apart.

Defined cases: a null text is empty, a null id is an id like any other, texts below
``WINDOW`` bytes lose nothing, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.hashed_words import blocks, mixed

WINDOW, SEED = 400, 100
SPAN = WINDOW - SEED + 1
#: Bytes hashed at once; places inside take the low 20 bits of a seed's digest.
STEP = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LENGTH = 0xD6E8FEB86659FD93
#: Extents of one seed that are compared in one group.
FEW = 1000

RUN = "id long, h long, at int, first int, last int, core long, hull long"
SPANS = "id long, h long, start int, end int"


class Powers:
    """Powers of a base and of its inverse, as many as were ever asked for, and a number for each byte."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)
        self.numbers = np.random.default_rng(base).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x))]) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


@cache
def powers(base: int) -> Powers:
    return Powers(base)


class Digests:
    """64-bit digests of any stretch of some bytes, from running sums."""

    def __init__(self, data: np.ndarray, base: int):
        own = powers(base)
        up, self.down = own.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(own.numbers[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(LENGTH))

    def every(self, length: int) -> np.ndarray:
        """Of all stretches of one length, by start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length * LENGTH % (1 << 64)))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    parts = padded.reshape(-1, width)
    before = np.minimum.accumulate(parts, axis=1).ravel()
    after = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def seeded(digests: Digests, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): runs of windows with one seed; no window crosses an end of a text."""
    n, none = len(digests.sums) - 1, np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none
    seeds = digests.every(SEED) & ~PLACE | np.arange(n - SEED + 1, dtype=np.uint64)
    at = (lowest(seeds, SPAN) & PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    held = ends - starts >= WINDOW
    opens = np.bincount(starts[held], minlength=n + 1) - np.bincount(ends[held] - WINDOW + 1, minlength=n + 1)
    windows = np.flatnonzero(np.cumsum(opens)[: n - WINDOW + 1])
    if not len(windows):
        return none, none, none
    at = at[windows]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[new], windows[new], windows[np.concatenate([new[1:], [len(at)]]) - 1]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and the end of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


def parts_of(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of about ``STEP`` window starts, with the ends of the texts inside."""
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + WINDOW - 1]
        inside = ends[(ends > at) & (ends < at + len(part))] - at
        yield at, part, np.concatenate([inside, [len(part)]])


def runs(docs: DataFrame, extents: bool = True) -> DataFrame:
    """The runs of windows of each (id, h, text) row, with the digests of seed and extent."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in blocks(batch.column(2), STEP):
                data, ends = bytes_of(texts)
                starts = np.concatenate([[0], ends[:-1]])
                for offset, part, part_ends in parts_of(data, ends):
                    digests = Digests(part, BASES[0])
                    at, first, last = seeded(digests, part_ends)
                    core = digests.of(at, at + SEED).view(np.int64)
                    hull = Digests(part, BASES[1]).of(first, last + WINDOW).view(np.int64) if extents else core
                    text = np.searchsorted(ends, first + offset, side="right")
                    place = lambda x: pa.array((x + offset - starts[text]).astype(np.int32))  # noqa: B023, E731
                    take = pa.array(text + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), place(at), place(first), place(last), pa.array(core), pa.array(hull)],
                        names=["id", "h", "at", "first", "last", "core", "hull"])

    return docs.mapInArrow(found, RUN)


def contexts(docs: DataFrame) -> DataFrame:
    """The bytes of the runs listed in ``parts`` of each (id, h, text, parts) row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(2)[i].as_py() or "").encode()
                parts = batch.column(3)[i].as_py()
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                     pa.array([p["first"] for p in parts], pa.int32()), pa.array([p["last"] for p in parts], pa.int32()),
                     pa.array([p["core"] for p in parts], pa.int64()), pa.array([p["few"] for p in parts]),
                     pa.array([data[p["first"] : p["last"] + WINDOW] for p in parts], pa.binary())],
                    names=["id", "h", "first", "last", "core", "few", "bytes"])

    return docs.mapInArrow(cut, "id long, h long, first int, last int, core long, few boolean, bytes binary")


def windows_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, digest, digest) of every window of (first, last, bytes) rows."""
    first, last = np.asarray(table["first"]).astype(np.int64), np.asarray(table["last"]).astype(np.int64)
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
    n = last - first + 1
    begins = np.concatenate([[0], np.cumsum(n + WINDOW - 1)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begins[row] + inside
    digests = [Digests(data, base).of(at, at + WINDOW).view(np.int64) for base in BASES]
    return row, first[row] + inside, *digests


def spans_of(id_: pa.Array, h: pa.Array, row: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows by row and start as spans, consecutive ones joined."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else row
    end = start[np.concatenate([new[1:], [len(row)]]) - 1] + WINDOW if len(row) else start
    take = pa.array(row[new])
    return pa.table([id_.take(take), h.take(take), pa.array(start[new].astype(np.int32)), pa.array(end.astype(np.int32))], names=["id", "h", "start", "end"])


def compared(table: pa.Table) -> pa.Table:
    """The repeated windows among the different extents of one seed."""
    table = table.combine_chunks()
    row, start, a, b = windows_of(table)
    # A run that came twice because its row did is one run.
    of = {}
    same = np.array([of.setdefault(key, i) for i, key in enumerate(zip(*(table[c].to_pylist() for c in ("id", "h", "first")), strict=True))], np.int64)
    order = np.lexsort((same[row], b, a))
    a, b, own = a[order], b[order], same[row][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    ends = np.concatenate([begins[1:], [len(a)]]) - 1
    hit = np.sort(order[(own[begins] != own[ends])[group]])
    return spans_of(table["id"].combine_chunks(), table["h"].combine_chunks(), row[hit], start[hit])


def exploded(rows: DataFrame) -> DataFrame:
    """(a, b, id, h, start): every window of the runs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, start, a, b = windows_of(part)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32))],
                    names=["a", "b", "id", "h", "start"])

    return rows.select("id", "h", "first", "last", "bytes").mapInArrow(windows, "a long, b long, id long, h long, start int")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def repeated(rows: DataFrame) -> DataFrame:
    """(id, h, start, end): spans of (id, h, text) rows whose windows all stand elsewhere too."""
    # Counts are stored before they are joined: Spark splits a hot key of a join only where
    # neither side comes from an aggregation.
    shared = tx.stored(runs(rows, extents=False).groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "rb-seeds")
    shared_runs = tx.stored(runs(rows).join(shared, "core"), "rb-runs")
    place = F.struct("id", "h", "first", "last")
    extents = tx.stored(shared_runs.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(place).alias("place")), "rb-extents")
    sure = shared_runs.join(extents.filter("n > 1").select("core", "hull"), ["core", "hull"], "left_semi").select(
        "id", "h", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end"))
    split = tx.stored(extents.groupBy("core").agg(F.count("*").alias("d")).filter("d > 1").select(
        "core", (F.col("d") <= FEW).alias("few")), "rb-split")
    # Lists of runs of one text, never longer than the text.
    open_runs = extents.join(split, "core").groupBy("place.id", "place.h").agg(
        F.collect_list(F.struct("place.first", "place.last", "core", "few")).alias("parts"))
    cut = tx.stored(contexts(rows.join(open_runs, same_row(rows, open_runs)).select(rows["id"], rows["h"], "text", "parts")), "rb-contexts")
    few = cut.filter("few").groupBy("core").applyInArrow(compared, SPANS)
    windows = exploded(cut.filter(~F.col("few")))
    who = F.struct("id", "h", "start")
    twice = tx.stored(windows.groupBy("a", "b").agg(F.min(who).alias("x"), F.max(who).alias("y")).filter("x != y").select("a", "b"), "rb-windows")
    many = windows.join(twice, ["a", "b"], "left_semi").select("id", "h", "start", (F.col("start") + WINDOW).alias("end"))
    return sure.unionByName(few).unionByName(many)


def without(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of (id, h, text) rows; ``kept`` are the bytes left."""
    listed = spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(listed, same_row(rows, listed), "left").select(rows["id"], "text", "spans")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, marked in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                n_removed = n_spans = 0
                if marked.is_valid and len(marked):
                    start, end = (np.asarray(marked.values.field(k)).astype(np.int64) for k in (0, 1))
                    depth = np.cumsum(np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1))[:-1]
                    gone = depth > 0
                    n_removed, n_spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(data) + n_removed, n_removed, n_spans, hashlib.sha256(data).hexdigest(), data), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(tx.whole(text)).alias("h"), tx.whole(text).alias("text"))
    return without(rows, repeated(rows)).withColumnRenamed("id", key)

"""Document fingerprints as invertible Bloom lookup sketches.

A text is the set of digests of its paragraphs: its lines, cut after sentence ends and
after ``PIECE`` characters, so that equal stretches give equal pieces again soon after a
difference. The digest of a paragraph counts how often it stood before, so repeated lines
tell texts apart; the order of paragraphs does not.

A sketch has three tables of cells. Each digest is added to one cell of each: a count, the
digests xor-ed, and check values xor-ed. Subtracting two sketches cell by cell leaves only
what differs. A cell with a single digest (count one, matching check) gives it away; taking
it out of its other cells (peeling) frees more. If cells stay non-empty, the pair is tried
again with larger sketches.

The fingerprint of a text is its sketch of ``FIRST`` cells a table, written in hexadecimal:
two fingerprints can be subtracted and peeled by anyone (``difference``), which is how
likeness is found first. Texts that differ in more than it holds are told apart by larger
sketches of the same digests.

Neighbours, edited texts and digests come from DataFrame functions and one shuffle of the
texts; sketches of all rows of an Arrow batch are built and peeled together in numpy.

Defined cases: a missing text is empty, no paragraphs, empty cells. Two empty sets are alike
(1). A null id comes last; rows of equal id are ordered by a digest of their text and then
by text. Ids that very many rows share are split by that digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.hashed_words import mixed
from dialogue_lake.operators import ordered

PIECE = 64
TABLES = 3
#: Cells of a table of the fingerprint.
FIRST = 8
#: Cells of a table for each digest of both sets, attempt by attempt.
LARGER = (0.5, 1.0, 2.0, 4.0)
CHECK = np.uint64(0xA0761D6478BD642F)
#: Digests compared at once.
TOGETHER = 150_000
#: Ids of a bucket, and rows of a bucket beyond which it is split.
BUCKET, MANY = 2048, 8192
LAST = -(1 << 62)

PARAGRAPH = rf"(?s)[^.!?\n]{{0,{PIECE}}}[.!?\n]+|[^.!?\n]{{1,{PIECE}}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, each with the number of its occurrence."""
    found = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x)))
    return let(found, lambda own: F.transform(own, lambda d, i: F.xxhash64(d, i + 1 - F.array_position(own, d))))


class Sketches:
    """The sketches of many sets at once: set i has ``cells[i]`` cells a table."""

    def __init__(self, cells: np.ndarray, seed: int):
        self.cells, self.seed = cells.astype(np.uint64), seed
        self.ends = np.cumsum(TABLES * cells.astype(np.int64))
        self.begins = self.ends - TABLES * cells.astype(np.int64)
        total = int(self.ends[-1]) if len(cells) else 0
        self.count = np.zeros(total, np.int64)
        self.key, self.check = np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def place(self, of: np.ndarray, digest: np.ndarray, table: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (1 + table + TABLES * self.seed)) % (1 << 64))
        at = (mixed(digest ^ salt) % self.cells[of]).astype(np.int64)
        return self.begins[of] + table * self.cells[of].astype(np.int64) + at

    def add(self, of: np.ndarray, digest: np.ndarray, sign: np.ndarray | int, tables: tuple[int, ...] = tuple(range(TABLES))) -> None:
        for table in tables:
            at = self.place(of, digest, table)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, mixed(digest ^ CHECK))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells, self.seed)
        out.count = self.count - other.count
        out.key, out.check = self.key ^ other.key, self.check ^ other.check
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, digest, sign) of everything that peeling gives away; cells keep the rest."""
        of_cell = np.repeat(np.arange(len(self.cells)), self.ends - self.begins)
        table_of = (np.arange(len(of_cell)) - self.begins[of_cell]) // np.maximum(self.cells[of_cell].astype(np.int64), 1)
        members = [np.flatnonzero(table_of == t) for t in range(TABLES)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        idle = turn = 0
        while idle < TABLES:
            # A digest is in one cell of a table, so a turn finds no digest twice.
            at = members[turn % TABLES]
            at = at[np.abs(self.count[at]) == 1]
            at = at[self.check[at] == mixed(self.key[at] ^ CHECK)]
            idle = 0 if len(at) else idle + 1
            turn += 1
            if len(at):
                of, digest, sign = of_cell[at], self.key[at].copy(), self.count[at].copy()
                found.append((of, digest, sign))
                self.add(of, digest, -sign)
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))  # type: ignore[return-value]

    def filled(self) -> np.ndarray:
        """Which sets have cells that are not empty."""
        rest = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return np.add.reduceat(rest, self.begins) > 0 if len(rest) else np.zeros(len(self.cells), bool)

    def written(self) -> list[str]:
        """Each sketch in hexadecimal: of every cell 8 digits of count, 16 of the digests, 16 of the check values."""
        rows = np.zeros((len(self.count), 20), np.uint8)
        rows[:, :4] = self.count.astype(">i4").view(np.uint8).reshape(-1, 4)
        rows[:, 4:12] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 12:] = self.check.astype(">u8").view(np.uint8).reshape(-1, 8)
        return [rows[a:b].tobytes().hex() for a, b in zip(self.begins, self.ends, strict=True)]


def read(fingerprint: str) -> Sketches:
    """The sketch of a fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 20)
    out = Sketches(np.array([len(rows) // TABLES]), 0)
    number = lambda a, b, kind: np.ascontiguousarray(rows[:, a:b]).view(kind).ravel()
    out.count, out.key, out.check = number(0, 4, ">i4").astype(np.int64), number(4, 12, ">u8").astype(np.uint64), number(12, 20, ">u8").astype(np.uint64)
    return out


def difference(first: str, second: str) -> tuple[set[int], set[int]] | None:
    """The digests that only the first or only the second of two fingerprints has; None if they are too many."""
    rest = read(first).minus(read(second))
    _, digest, sign = rest.peeled()
    if rest.filled()[0]:
        return None
    digest = digest.astype(np.uint64).view(np.int64)
    return set(digest[sign > 0].tolist()), set(digest[sign < 0].tolist())


class Sets:
    """A column of digest arrays, flat."""

    def __init__(self, column: pa.Array):
        self.sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
        # Flattening keeps to the rows of a slice.
        self.values = np.asarray(column.flatten()).astype(np.int64).view(np.uint64)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sketches(self, cells: np.ndarray, seed: int) -> Sketches:
        out = Sketches(cells, seed)
        out.add(self.of, self.values, 1)
        return out

    def part(self, rows: np.ndarray) -> Sets:
        """Only some rows, numbered anew."""
        out = object.__new__(Sets)
        number = np.full(len(self.sizes), -1)
        number[rows] = np.arange(len(rows))
        keep = number[self.of] >= 0
        out.sizes, out.values, out.of = self.sizes[rows], self.values[keep], number[self.of[keep]]
        return out


def likeness(a: Sets, b: Sets, first: Sketches, second: Sketches) -> np.ndarray:
    """Shared digests by all digests, from what peeling the differences of sketches gives."""
    differing = np.full(len(a.sizes), -1)
    open_rows = np.arange(len(a.sizes))
    for attempt in range(len(LARGER) + 1):
        if attempt:
            own, other = a.part(open_rows), b.part(open_rows)
            cells = np.ceil((own.sizes + other.sizes) * LARGER[attempt - 1]).astype(np.int64) + 4
            first, second = own.sketches(cells, attempt), other.sketches(cells, attempt)
        rest = first.minus(second)
        of, _, _ = rest.peeled()
        done = ~rest.filled()
        differing[open_rows[done]] = np.bincount(of, minlength=len(open_rows))[done]
        open_rows = open_rows[~done]
        if not len(open_rows):
            break
    for i in open_rows:
        # Peeling failed at every size: the sets themselves are compared.
        differing[i] = len(np.setxor1d(a.values[a.of == i], b.values[b.of == i]))
    both = a.sizes + b.sizes
    return np.where(both == 0, 1.0, (both - differing) / np.maximum(both + differing, 1))


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(b, s, p, id, h, text, next): rows with the text after them in descending order of ids.

    Ids fall into buckets of ``BUCKET`` in one shuffle. ``next`` is null for the last row of
    a bucket. A bucket of very many rows is split by id, and by a digest of the text.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), tx.whole(text).alias("text"))
    b = F.coalesce(F.floor(F.col("id") / BUCKET), F.lit(LAST)).cast("long")
    large = tx.stored(rows.groupBy(b.alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") > MANY), "iblt-large")
    rows = rows.withColumn("b", b).withColumn("h", F.xxhash64("text")).join(large, "b", "left")
    # The digest's place in its range, in as many parts as the bucket has thousands of rows.
    part = F.floor((F.col("h") / 2.0**64 + 0.5) * F.ceil(F.col("n") / (MANY / 2)))
    rows = rows.withColumn("s", F.when(F.col("n").isNotNull(), -F.coalesce("id", F.lit(LAST))).otherwise(0).cast("long")).withColumn(
        "p", F.coalesce(part, F.lit(0)).cast("long")).drop("n")
    inside = Window.partitionBy("b", "s", "p").orderBy(F.col("id").desc_nulls_last(), "h", "text")
    return rows.repartition("b", "s", "p").withColumn("next", F.lead("text").over(inside)).withColumn("first", F.row_number().over(inside) == 1)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def measured(rows: DataFrame) -> DataFrame:
    """The answers for rows (text, next), and their other columns; null where ``next`` is."""
    others = [c for c in rows.columns if c not in ("next", "id")]
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next"))).select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        *others, F.col("next").isNotNull().alias("there"),
        *[F.coalesce(digests(F.col(c)), F.array().cast("array<long>")).alias(f"_{c}") for c in ("text", "edited", "next")])

    def parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
        """Slices of about ``TOGETHER`` digests, so that memory does not grow with the texts of a batch."""
        sizes = sum(np.diff(np.asarray(batch.column(at + k).offsets)).astype(np.int64) for k in (1, 2, 3))
        group = np.cumsum(sizes) // TOGETHER
        begin = 0
        for n in np.unique(group, return_counts=True)[1]:
            yield batch.slice(begin, int(n))
            begin += int(n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, whole.schema.get_field_index("there"))):
            at = batch.schema.get_field_index("there")
            own, changed, following = (Sets(batch.column(at + k)) for k in (1, 2, 3))
            cells = np.full(batch.num_rows, FIRST)
            prints = [x.sketches(cells, 0) for x in (own, changed, following)]
            hidden = ~np.asarray(batch.column(at))
            column = lambda values, kind: pa.array(values, kind, mask=hidden)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], column(np.array(prints[0].written(), object), pa.string()), column(np.array(prints[1].written(), object), pa.string()),
                 column(likeness(own, changed, prints[0], prints[1]), pa.float64()), column(likeness(own, following, prints[0], prints[2]), pa.float64())],
                names=[*batch.schema.names[:at], "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kept = T.StructType(rows.schema.fields[: rows.columns.index("there")])
    for name, kind in (("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        kept = kept.add(name, kind)
    return rows.mapInArrow(compare, kept)


ANSWERS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    edge = F.col("first") | F.col("next").isNull()
    rows = measured(followed(docs, key, text).withColumn("last", F.col("next").isNull()).withColumn("edge", F.when(edge, F.col("text"))))
    rows = tx.stored(rows.select(*ANSWERS, "b", "s", "p", "first", "last", F.col("edge").alias("text")), "iblt-answers")
    # The last row of a bucket is followed by the first of the next bucket that has rows.
    heads = rows.filter("first").select("b", "s", "p", "text")
    order = heads.select("b", "s", "p", (-F.col("b")).alias("o"), F.lit(0).alias("all"))
    bucket = F.struct("b", "s", "p")
    linked = ordered.scan(order, ["all"], ["o", "s", "p"], ordered.bucket_of("o", 4096), [ordered.following("after", bucket)])
    start = order.groupBy("all").agg(F.min_by(bucket, F.struct("o", "s", "p")).alias("start"))
    linked = linked.join(start, "all").select("b", "s", "p", F.coalesce("after", "start").alias("after"))
    after = heads.select(bucket.alias("after"), F.col("text").alias("next"))
    lasts = rows.filter("last").select("id", "b", "s", "p", "text").join(linked, ["b", "s", "p"]).join(after, "after").select("id", "text", "next")
    return rows.filter(~F.col("last")).select(*ANSWERS).unionByName(measured(lasts).select(*ANSWERS)).withColumnRenamed("id", key)

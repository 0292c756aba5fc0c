"""Spelling variants by k-d trees over letter counts.

A word is a point: how often it has each letter. One inserted or deleted letter moves the
point by one, one replaced letter by two at most (sum of absolute differences). Words of
each length have a tree of their own; words of that length ask it for points within two,
words one letter longer for points within one. A branch whose box is further away is not
visited. What is found is verified on the order of the letters.

The top of each tree is built from a bounded sample of the words (``SAMPLE`` of the smallest
hash) and only decides which leaf a word lies in: any word goes to one leaf, and to every
leaf as near as its radius as a question. A leaf is one group, or a grid of groups where it
is large; inside it the tree goes on down to ``SMALL`` points, with all questions walking
together. Letters outside a-z share
``OTHERS`` counts, which moves points nearer but never further apart.

Words and their counts come from DataFrame functions alone; the sum of counts is
combined before it is shuffled, so a frequent word is no hot key. Words are few beside
their occurrences, and only words are searched.

Defined cases: a null text has no words, a null id counts as the empty string in the rule
that deletes a letter, repeated rows count as often as they occur. A table without words
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.components import _rooted as rooted

# Letters of a word and how occurrences are read, from the contract.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES, TIMES_MORE, TYPO_EVERY = 6, 5, 5, 199

#: Sampled words are no longer than ``SAMPLE_LETTERS``; longer words have one leaf a length.
SAMPLE, SAMPLE_LEAF, SAMPLE_LETTERS = 65536, 32, 64
#: Words a leaf of the top tree aims at, and points below which all are compared.
LEAF, SMALL = 8192, 48
#: Most points and questions of one task; larger leaves become a grid of tasks.
POINTS, QUESTIONS = 32768, 131072
OTHERS = 6
WIDTH = 26 + OTHERS
#: Numbers held at once while comparing points or letters.
CHUNK = 1 << 22

NEAR = "word string, other string, n_other long"


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, length): distinct words of enough letters and occurrences."""
    # A shorter run cannot become a word: deleting only makes it shorter.
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run"))
    return run.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(
        (F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_TIMES)).withColumn("length", F.length("word"))


def letters_of(words: list[bytes]) -> np.ndarray:
    """Letter counts of Latin-1 words, one row each."""
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    plain = (flat >= 97) & (flat <= 122)
    letter = np.where(plain, flat - 97, 26 + flat % OTHERS)
    return np.bincount(row * WIDTH + letter, minlength=len(words) * WIDTH).reshape(-1, WIDTH).astype(np.int32)


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def away(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each point from a box."""
    return (np.maximum(low - points, 0) + np.maximum(points - high, 0)).sum(axis=1)


def cut_of(points: np.ndarray) -> tuple[int, int] | None:
    """The letter that spreads the points most and its middle; None if all are one point."""
    axis = int(np.argmax(points.var(axis=0)))
    values = np.sort(points[:, axis])
    if values[0] == values[-1]:
        return None
    middle = int(values[(len(values) - 1) // 2])
    return axis, middle if middle < values[-1] else int(values[values < values[-1]].max())


class Tree:
    """Boxes that divide all points; leaves are numbered in order."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.low, self.high = np.zeros(WIDTH, np.int64), np.full(WIDTH, 1 << 40)
        self.leaves = 0
        self.root = self._grown(points, leaf)

    def _grown(self, points: np.ndarray, leaf: int):
        cut = cut_of(points) if len(points) > leaf else None
        if cut is None:
            self.leaves += 1
            return self.leaves - 1
        axis, middle = cut
        below = points[:, axis] <= middle
        return axis, middle, self._grown(points[below], leaf), self._grown(points[~below], leaf)

    def within(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf): all leaves whose box is no further than ``radius``."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.root, self.low, self.high, np.arange(len(points)))]
        while todo:
            node, low, high, asked = todo.pop()
            asked = asked[away(points[asked], low, high) <= radius]
            if not len(asked):
                continue
            if isinstance(node, int):
                rows.append(asked)
                leaves.append(np.full(len(asked), node))
                continue
            axis, middle, below, above = node
            upto, beyond = high.copy(), low.copy()
            upto[axis], beyond[axis] = middle, middle + 1
            todo += [(below, low, upto, asked), (above, beyond, high, asked)]
        return np.concatenate(rows), np.concatenate(leaves)


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether words, row by row, differ by one replaced letter, or one more in ``longer``."""
    n = shorter.shape[1]
    if longer.shape[1] == n:
        return (longer != shorter).sum(axis=1) == 1
    ahead = np.cumprod(longer[:, :n] == shorter, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((longer[:, 1:] == shorter)[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= n


def pairs_within(points: np.ndarray, asked: np.ndarray, radius: int):
    """Arrays (asked row, point row) of all pairs no further than ``radius``, part by part."""
    todo = [(np.arange(len(points)), np.arange(len(asked)))]
    while todo:
        own, questions = todo.pop()
        low, high = points[own].min(axis=0), points[own].max(axis=0)
        questions = questions[away(asked[questions], low, high) <= radius]
        if not len(questions):
            continue
        cut = cut_of(points[own]) if len(own) > SMALL else None
        if cut:
            below = points[own, cut[0]] <= cut[1]
            todo += [(own[below], questions), (own[~below], questions)]
            continue
        step = max(1, CHUNK // (min(len(own), CHUNK) * WIDTH))
        for a in range(0, len(own), max(1, CHUNK // WIDTH)):
            some = own[a : a + CHUNK // WIDTH]
            for at in range(0, len(questions), step):
                part = questions[at : at + step]
                near = np.abs(asked[part][:, None] - points[some]).sum(axis=2) <= radius
                i, j = np.nonzero(near)
                yield part[i], some[j]


def _joined(words: list[bytes], rows: np.ndarray) -> np.ndarray:
    length = len(words[rows[0]])
    return np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)


def search_leaf(table: pa.Table) -> pa.Table:
    """The near words of one leaf; of two words each pair comes once."""
    point = np.asarray(table["point"])
    lengths = np.asarray(table["length"])
    words, n = encoded(table["word"]), np.asarray(table["n"])
    vectors = letters_of(words)
    own = np.flatnonzero(point)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(own):
        length = lengths[own[0]]
        for questions, radius in ((np.flatnonzero(lengths == length), 2), (np.flatnonzero(lengths == length + 1), 1)):
            # A word of this leaf is there twice, as a point and as a question.
            questions = questions[~point[questions]]
            if not len(questions):
                continue
            for q, p in pairs_within(vectors[own], vectors[questions], radius):
                q, p = questions[q], own[p]
                for at in range(0, len(q), max(1, CHUNK // int(length + 1))):
                    a, b = q[at : at + CHUNK // int(length + 1) + 1], p[at : at + CHUNK // int(length + 1) + 1]
                    fits = one_edit(_joined(words, a), _joined(words, b))
                    a, b = a[fits], b[fits]
                    if radius == 2:
                        once = np.array([words[i] > words[j] for i, j in zip(a, b, strict=True)], bool)
                        a, b = a[once], b[once]
                    left.append(a)
                    right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    text = table["word"].combine_chunks()
    return pa.table({"a": text.take(pa.array(a)), "b": text.take(pa.array(b)), "n_a": pa.array(n[a], pa.int64()), "n_b": pa.array(n[b], pa.int64())})


def grown(words: DataFrame, total: int) -> dict[int, Tree]:
    """A tree for each length of the sampled words, with about as many leaves as all words fill."""
    sample = words.filter(F.col("length") <= SAMPLE_LETTERS).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word", "length").toArrow()
    lengths, texts = np.asarray(sample["length"]), encoded(sample["word"])
    leaf = max(SAMPLE_LEAF, int(np.ceil(len(texts) * LEAF / max(total, 1))))
    found = {}
    for length in np.unique(lengths):
        found[int(length)] = Tree(letters_of([texts[i] for i in np.flatnonzero(lengths == length)]), leaf)
    return found


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(tree, leaf, point, word, n, length): words in their leaves, and as questions in all near ones."""
    single = Tree(np.zeros((0, WIDTH), np.int32), 1)

    def deal(batches):
        for batch in batches:
            texts, lengths = encoded(batch.column(0)), np.asarray(batch.column(2))
            vectors = letters_of(texts)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                for tree, radius, point in ((length, 0, True), (length, 2, False), (length - 1, 1, False)):
                    if tree < LEAST_LETTERS:
                        continue
                    at, leaf = trees.get(int(tree), single).within(vectors[rows], radius)
                    take = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree), pa.int32()), pa.array(leaf, pa.int32()), pa.array(np.full(len(at), point)),
                         *[batch.column(i).take(take) for i in range(3)]],
                        names=["tree", "leaf", "point", "word", "n", "length"])

    return words.select("word", "n", "length").mapInArrow(deal, "tree int, leaf int, point boolean, word string, n long, length int")


def gridded(rows: DataFrame) -> DataFrame:
    """Rows of large leaves copied into a grid: each part of the points meets each part of the questions."""
    parts = lambda of, most: F.ceil(F.count(F.when(of, 1)) / most).cast("int")
    sizes = rows.groupBy("tree", "leaf").agg(
        F.greatest(F.lit(1), parts(F.col("point"), POINTS)).alias("p"), F.greatest(F.lit(1), parts(~F.col("point"), QUESTIONS)).alias("q"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    rows = rows.join(sizes, ["tree", "leaf"]).withColumn("p", F.explode(F.when(F.col("point"), one("p")).otherwise(every("p"))))
    return rows.withColumn("q", F.explode(F.when(F.col("point"), every("q")).otherwise(one("q"))))


def near_words(words: DataFrame, total: int) -> DataFrame:
    """(word, other, n_other): every ordered pair of words one edit apart."""
    rows = gridded(tx.stored(dealt(words, grown(words, total)), "sv-leaves"))
    found = rows.groupBy("tree", "leaf", "p", "q").applyInArrow(search_leaf, "a string, b string, n_a long, n_b long")
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))))
    return found.select(both.alias("x")).select("x.*")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``."""
    words = tx.stored(counted(docs, key, text), "sv-words")
    near = near_words(words, words.count()).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= TIMES_MORE * F.col("n")
    rows = tx.stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "sv-forms")
    # Each form is much more frequent than its word, so following forms ends.
    roots = rooted(rows.filter("form is not null").select(F.col("word").alias("child"), F.col("form").alias("parent")))
    return rows.join(roots.select(F.col("child").alias("word"), F.col("parent").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

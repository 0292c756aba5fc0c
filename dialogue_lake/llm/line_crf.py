"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. What speaks for either are measures of the line itself and of
the lines before and after it; transition weights tie neighbours together. Forward and
backward passes give each line's probability to be good, and the mean of these, weighted
by the lines' lengths, is the document's score.

It is fitted on at most ``SAMPLE`` labelled documents, whose lines all carry the
document's label: the ones with the smallest hashes, so reruns agree. Everything else covers
every row: a missing or empty text has one empty line and gets that line's probability.
Without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm.hashed_words import Words, blocks
from dialogue_lake.llm.quality_rules import STOP_WORDS

SAMPLE = 2000
ROUNDS = 80
CLASSES = (b"#*$%&<>|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b" \t\r\v\f")
FEATURES = 14


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, where each text's lines start) of a block of texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    breaks = np.flatnonzero(data == 10) + 1
    # A line starts with each text and after each line break.
    owner = np.searchsorted(ends[1:], breaks, "left")
    begin = np.sort(np.concatenate([ends[:-1], breaks]), kind="stable")
    starts = np.concatenate([[0], np.cumsum(1 + np.bincount(owner, minlength=n)[:n])])
    upto = np.concatenate([begin[1:], [len(data)]])
    length = (upto - begin).astype(np.float64)
    table = np.zeros(256, np.int64)
    counts = []
    for letters in CLASSES:
        table[:] = 0
        table[list(letters)] = 1
        sums = np.concatenate([[0], np.cumsum(table[data])])
        counts.append(sums[upto] - sums[begin])
    symbols, marks, upper, digits, points, blanks = counts
    words = Words(texts)
    stop = np.isin(words.hashes, _stop_hashes())
    again = np.zeros(len(words.hashes), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    line_of = np.searchsorted(begin, words.begin, "right") - 1
    per_line = lambda x: np.bincount(line_of, x, len(begin))
    n_words = per_line(np.ones(len(words.hashes)))
    some = np.maximum(n_words, 1)
    letters = np.maximum(length - blanks, 1)
    found = np.stack([
        np.ones(len(begin)), np.log1p(length) / 6, (n_words == 0), np.minimum(symbols / some, 3), np.minimum(marks / some, 3),
        upper / letters, digits / letters, np.minimum(points / some, 3), per_line(stop) / some, per_line(again) / some,
        np.minimum(letters / some, 30) / 10, (n_words > 0) & (per_line(stop) == 0), (upper > 0.5 * letters), np.minimum(n_words, 8) / 8,
    ], axis=1).astype(np.float64)
    return found, length, starts


def _stop_hashes() -> np.ndarray:
    return Words(pa.array(sorted(set(STOP_WORDS)))).hashes


def with_neighbours(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it in the same text."""
    before, after = np.zeros_like(found), np.zeros_like(found)
    before[1:], after[:-1] = found[:-1], found[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([found, before, after], axis=1)


def _by_place(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Lines at place 0, 1, ... of all texts; the longest texts come first."""
    order = np.argsort(-np.diff(starts), kind="stable")
    begin, length = starts[:-1][order], np.diff(starts)[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield begin[: np.searchsorted(-length, -t, "left")] + t


def forward_backward(good: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability to be good, and the expected transitions.

    ``good``: weight of good against bad for each line; ``ties``: weights of transitions.
    """
    emit = np.stack([np.zeros(len(good)), good], axis=1)
    ahead, back = emit.copy(), np.zeros_like(emit)
    places = list(_by_place(starts))
    for t in range(1, len(places)):
        now = places[t]
        last = ahead[places[t - 1][: len(now)]]
        ahead[now] += np.logaddexp(last[:, :1] + ties[0], last[:, 1:] + ties[1])
    for t in range(len(places) - 2, -1, -1):
        later = places[t + 1]
        now = places[t][: len(later)]
        out = (emit + back)[later]
        back[now] = np.logaddexp(out[:, :1] + ties[:, 0], out[:, 1:] + ties[:, 1])
    both = ahead + back
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    later = np.ones(len(good), bool)
    later[starts[:-1]] = False
    b = np.flatnonzero(later)
    pairs = ahead[b - 1][:, :, None] + ties + (emit + back)[b][:, None, :]
    pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True))
    return p, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fitted(found: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition weights) by gradient ascent on the likelihood of the labels."""
    x = with_neighbours(found, starts)
    y = np.repeat(labels, np.diff(starts)).astype(np.float64)
    observed = np.zeros((2, 2))
    for label, lines in zip(labels, np.diff(starts), strict=True):
        observed[int(label), int(label)] += lines - 1
    flat = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(1, rounds + 1):
        weights, ties = flat[:-4], flat[-4:].reshape(2, 2)
        p, expected = forward_backward(x @ weights, ties, starts)
        grad = np.concatenate([x.T @ (y - p), (observed - expected).ravel()]) / len(x) - 1e-3 * flat
        first += 0.1 * (grad - first)
        second += 0.01 * (grad**2 - second)
        flat += 0.1 * first / (1 - 0.9**turn) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9)
    return flat[:-4], flat[-4:].reshape(2, 2)


def mean_marginals(found: np.ndarray, lengths: np.ndarray, starts: np.ndarray, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """The log odds of the mean over a document's bytes of its lines' probabilities."""
    p, _ = forward_backward(with_neighbours(found, starts) @ model[0], model[1], starts)
    weights = lengths + 1
    mean = np.add.reduceat(p * weights, starts[:-1]) / np.add.reduceat(weights, starts[:-1])
    return np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))


def curve(odds: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and height of the logistic curve through (log odds, label), by Newton's method."""
    x, at = np.stack([odds, np.ones_like(odds)], axis=1), np.asarray([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6)
        at = at + np.linalg.solve((x.T * weight) @ x + 0.1 * np.eye(2), x.T @ (labels - p) - 0.1 * (at - [1.0, 0.0]))
    return at


def document_scores(found: np.ndarray, lengths: np.ndarray, starts: np.ndarray, model: tuple[np.ndarray, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mean_marginals(found, lengths, starts, model) * model[2][0] + model[2][1], -30, 30)))


def training_lines(docs: DataFrame, labels: DataFrame, sample: int, key: str, text: str, label: str) -> list:
    """Features of the lines of at most ``sample`` labelled documents."""
    chosen = labels.filter(F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("_key"), "_label").limit(sample)

    def lines(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at, part in blocks(table.column(1)):
                found, lengths, starts = line_features(part)
                rows = [np.column_stack([found, lengths])[a:b].ravel() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).slice(at, len(part)), pa.array(rows, pa.list_(pa.float64()))], names=["label", "lines"])

    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    return own.select("_label", "_text").mapInArrow(lines, "label int, lines array<double>").collect()


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Column:
    """The score of each text of ``docs``, learned from ``labels`` (one row per labelled document)."""
    rows = training_lines(docs, labels, sample, key, text, label)
    model = None
    if len({r["label"] for r in rows}) == 2:
        rows.sort(key=lambda r: (r["label"], r["lines"]))
        parts = [np.asarray(r["lines"]).reshape(-1, FEATURES + 1) for r in rows]
        starts, given = np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.asarray([r["label"] for r in rows])
        found = np.concatenate(parts)
        model = fitted(found[:, :-1], starts, given)
        model = *model, curve(mean_marginals(found[:, :-1], found[:, -1], starts, model), given)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [np.zeros(0)]
            for _, part in blocks(column):
                out.append(document_scores(*line_features(part), model) if model else np.full(len(part), 0.5))
            yield pa.array(np.concatenate(out))

    return score(F.col(text))

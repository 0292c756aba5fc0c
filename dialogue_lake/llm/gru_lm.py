"""A gated recurrent language model with a class-factored output, and its unigram base.

Counts of all training tokens come from one aggregation. The words counted ``RARE``
times or more (head) have their own inputs and outputs, in classes by frequency that are
small for frequent words and wide for rare ones; every other word is known by a class that
its last byte gives. The model's probability of a word is that of its class given the state times

* the decisions on its way down the class's binary tree given the state, for head words, or
* its share of the class's counts, (c + 0.5) / (class count + 0.5 (class words + 1)), for
  all others, where an unseen word counts 0. Seen words and one unseen word sum to 1.

Training is truncated backpropagation in numpy inside tasks: from shared weights each task
walks through all its training documents, and Spark averages the weights, first over an
eighth of the documents, then over the others. Documents are scored in step, many at a
time, with the state carried from window to window until each document's end.

Counts of the ``LOCAL`` most frequent words go to every task, a fixed bound, which also bounds
the head (weights take about 0.5 KB a word in a task); the few other
tokens are joined to the table of counts. A missing text is empty: its one token is the
end. Repeated rows are scored alike; with no training rows everything is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx
from dialogue_lake.llm.hashed_words import Words, blocks

HIDDEN, HEAD, TAILS = 16, 1024, 16
#: Words of a class, a power of two, for places by frequency below a bound that it divides.
WIDTHS = ((1 << 10, 32), (1 << 13, 512), (1 << 16, 4096), (1 << 62, 8192))
LOCAL = 200_000
#: Words counted less often have no weights of their own.
RARE = 8
END = 0
END_HASH = np.int64(0x1E3779B97F4A7C15)
LANES, STEPS, RATE = 1024, 8, 0.016
#: How much faster rows of words and nodes start to learn than the weights that all tokens share.
ROWS = 10
DENSE = ("state", "class", "class_bias")
#: Weights a row when the tasks' weights are averaged.
BLOCK = 1 << 16
WINDOW_ROWS = 1 << 14
#: Tokens whose class scores are made at once, so that they stay in a core's cache.
TOGETHER = 1 << 10


def per_class(head: int) -> int:
    """Words of the widest class."""
    return next(width for bound, width in WIDTHS if head <= bound)


def head_size(counts: np.ndarray) -> int:
    """Places for every word counted ``RARE`` times or more, in whole classes, at least ``HEAD``."""
    n = max(HEAD, int((counts >= RARE).sum()))
    return -(-n // per_class(n)) * per_class(n)


@cache
def class_of(head: int) -> np.ndarray:
    """The class of every place and, after them, of every tail."""
    widths, at = [], 0
    for bound, width in WIDTHS:
        widths += [width] * ((min(head, bound) - at) // width)
        at = min(head, bound)
    return np.repeat(np.arange(len(widths) + TAILS, dtype=np.int32), [*widths, *[1] * TAILS])


def shapes(head: int) -> dict[str, tuple[int, ...]]:
    classes = int(class_of(head)[-1]) + 1
    return {
        "input": (head + TAILS, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "class": (HIDDEN, classes),
        "class_bias": (classes,), "node": (head, HIDDEN), "node_bias": (head,)}


def unpacked(flat: np.ndarray, head: int = HEAD) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(head).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(head_counts: np.ndarray, tail_counts: np.ndarray) -> np.ndarray:
    """Small random weights; the biases start at the unigram frequencies."""
    rng = np.random.default_rng(3)
    flat = (rng.standard_normal(sum(int(np.prod(s)) for s in shapes(len(head_counts)).values())) * 0.1).astype(np.float32)
    w = unpacked(flat, len(head_counts))
    own = head_counts + 0.5
    w["class_bias"][:] = np.log(np.bincount(class_of(len(own)), np.concatenate([own, tail_counts + 0.5])))
    at = 0
    for bound, width in WIDTHS:
        below = own[at:bound].reshape(-1, width)
        # Nodes of a class's tree stand like those of a heap: 1 at the top, 2 k and 2 k + 1 below k.
        bias = w["node_bias"][at:bound].reshape(-1, width)
        bias[:, 0] = 0
        for level in range(width.bit_length() - 2, -1, -1):
            left, right = below[:, ::2], below[:, 1::2]
            bias[:, 1 << level : 2 << level] = np.log(right / left)
            below = left + right
        at = bound
    w["class"][:] *= 0.1
    w["node"][:] *= 0.1
    return flat


class Model:
    """What tasks need to make the weights: the counts behind the first ones, and how far each moved since.

    The first weights are made anew from the counts, and moves are sent in half precision, so
    a task is sent two bytes a weight, and none in the first round.
    """

    def __init__(self, head_counts: np.ndarray, tail_counts: np.ndarray, moved: np.ndarray | None = None):
        self.head_counts, self.tail_counts, self.moved = head_counts, tail_counts, moved

    def weights(self) -> np.ndarray:
        flat = initial(self.head_counts, self.tail_counts)
        return flat if self.moved is None else flat + self.moved.astype(np.float32)

    def after(self, moves: dict[int, np.ndarray]) -> Model:
        """The model whose weights moved on, by place of each stretch."""
        moved = np.zeros(sum(int(np.prod(x)) for x in shapes(len(self.head_counts)).values()), np.float32)
        if self.moved is not None:
            moved += self.moved
        for place, part in moves.items():
            moved[place : place + len(part)] += part
        return Model(self.head_counts, self.tail_counts, moved.astype(np.float16))


class Vocabulary:
    """The most frequent words: sorted hashes with their counts and places by frequency."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, head: int = HEAD):
        """Words by falling count, the first being the end of a text."""
        self.head = head
        order = np.argsort(hashes)
        self.hashes, self.counts, self.places = hashes[order], counts[order], order.astype(np.int32)

    def tokens(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """By block: input ids, counts (-1: not here), hashes, and where each text starts."""
        for _, part in blocks(texts):
            words = Words(part)
            hashes = words.hashes.view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            here = self.hashes[at] == hashes
            head = here & (self.places[at] < self.head)
            ids = np.where(head, self.places[at], self.head + words.last.astype(np.int32) % TAILS)
            yield ids.astype(np.int32), np.where(here, self.counts[at], -1), hashes, words.starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(w: dict[str, np.ndarray], tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The state after ``tokens``, with what the way back needs."""
    x, a = w["input"][tokens], h @ w["state"]
    gates = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    own = a[:, 2 * HIDDEN :]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * own)
    return n + z * (h - n), z, r, n, own


def class_scores(w: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the score of every class, less the largest of a row, and the sum of each row."""
    scores = h @ w["class"]
    scores += w["class_bias"]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores, scores.sum(axis=1)


def paths(ids: np.ndarray, head: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth of the trees: which of ``ids`` are there, the node of each level above them, and the way taken (0 or 1)."""
    at = 0
    for bound, width in WIDTHS:
        own = np.flatnonzero((ids >= at) & (ids < min(bound, head)))
        if len(own):
            place = ids[own].astype(np.intp)
            code = (place & (width - 1)) + width
            levels = np.arange(width.bit_length() - 1, 0, -1)[:, None]
            yield own, (place - code + width) + (code >> levels), code >> (levels - 1) & 1
        at = bound


def node_scores(w: dict[str, np.ndarray], h: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' weights, and the score by level for going right at each, with a state for each column."""
    value = w["node"].take(nodes, axis=0)
    scores = w["node_bias"].take(nodes)
    for level, x in enumerate(value):
        scores[level] += np.einsum("nk,nk->n", x, h)
    return value, scores


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logarithm of each target's class and, for head words, of the way to the word in it."""
    head = len(w["node"])
    classes = class_of(head)[ids]
    out = np.empty(len(ids), h.dtype)
    for at in range(0, len(ids), TOGETHER):
        part = slice(at, at + TOGETHER)
        scores, total = class_scores(w, h[part])
        out[part] = np.log(scores[np.arange(len(total)), classes[part]] / total)
    for own, nodes, way in paths(ids, head):
        scores = node_scores(w, h[own], nodes)[1]
        np.negative(scores, out=scores, where=way > 0)
        out[own] -= np.logaddexp(0, scores).sum(axis=0)
    return out


class Sums:
    """Adds up rows of equal places, of a table with ``size`` places, without sorting them."""

    def __init__(self, size: int):
        self.seen, self.number = np.zeros(size, bool), np.zeros(size, np.intp)

    def __call__(self, places: np.ndarray, columns: Iterable[np.ndarray], out: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """The distinct places in order and, for each, its sum of every column."""
        self.seen[places] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        self.number[found] = np.arange(len(found))
        local = self.number[places]
        return found, np.stack([np.bincount(local, x, len(found)) for x in columns], axis=1).astype(out)


class Trainer:
    """Windows of ``STEPS`` tokens in many lanes; states flow on, gradients don't.

    Weights that all tokens share learn by Adam. A word's or a node's row learns at a pace that
    falls with the squares of all its own gradients; rows that a window does not meet stay as they are.
    """

    def __init__(self, flat: np.ndarray, head: int = HEAD, rate: float = RATE):
        self.flat, self.rate, self.turn = flat.copy(), rate, 0
        self.w = unpacked(self.flat, head)
        self.first, self.second = ({n: np.zeros_like(self.w[n]) for n in DENSE} for _ in range(2))
        self.squares = {n: np.zeros(len(x), flat.dtype) for n, x in self.w.items() if n not in DENSE}
        self.inputs, self.nodes = Sums(head + TAILS), Sums(head)
        #: The last window's gradients: what rows of each table it met, and theirs.
        self.slopes: dict[str, tuple[np.ndarray | slice, np.ndarray]] = {}

    @property
    def grad(self) -> np.ndarray:
        """The last window's gradients, with a zero for every weight that it did not meet."""
        out = np.zeros_like(self.flat)
        tables = unpacked(out, len(self.w["node"]))
        for name, (at, slope) in self.slopes.items():
            tables[name][at] = slope
        return out

    def learn(self, stream: np.ndarray, lanes: int = 0) -> np.ndarray:
        """One walk through a stream of token ids; END ends a document and resets the state.

        Returns the tokens that are still to be walked, the first being a target met before.
        """
        lanes = lanes or int(min(LANES, max(8, len(stream) // 400)))
        length = (len(stream) - 1) // lanes
        if length < 1:
            return stream
        inputs = stream[: lanes * length].reshape(lanes, length)
        targets = stream[1 : lanes * length + 1].reshape(lanes, length)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, length, STEPS):
            h = self.window(inputs[:, at : at + STEPS], targets[:, at : at + STEPS], h)
        return stream[lanes * length :]

    def finish(self, stream: np.ndarray) -> None:
        """Walks through all that is left, in as few windows as that takes."""
        stream = self.learn(stream)
        while len(stream) > 1:
            stream = self.learn(stream, max(1, (len(stream) - 1) // STEPS))

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, every = self.w, slice(None)
        g = {name: np.zeros_like(w[name]) for name in DENSE}
        trace, states = [], []
        for t in range(inputs.shape[1]):
            going = (inputs[:, t] != END)[:, None].astype(np.float32)
            before = h * going
            h, z, r, n, own = step(w, inputs[:, t], before)
            trace.append((before, z, r, n, own, going))
            states.append(h)
        flat, ids = np.concatenate(states), targets.T.ravel()
        head, scale = len(w["node"]), np.float32(1 / len(ids))
        classes, back = class_of(head)[ids], np.empty_like(flat)
        for at in range(0, len(ids), TOGETHER):
            part = slice(at, at + TOGETHER)
            p, total = class_scores(w, flat[part])
            p *= (scale / total)[:, None]
            p[np.arange(len(total)), classes[part]] -= scale
            g["class"] += flat[part].T @ p
            g["class_bias"] += p.sum(axis=0)
            back[part] = p @ w["class"].T
        met, sums = [np.zeros(0, np.intp)], [np.zeros((0, HIDDEN + 1), flat.dtype)]
        for own, nodes, way in paths(ids, head):
            state = flat[own]
            value, slope = node_scores(w, state, nodes)
            slope = (sigmoid(slope) - way) * scale
            value *= slope[:, :, None]
            back[own] += value.sum(axis=0)
            wide = slope.astype(float)
            found, total = self.nodes(nodes.ravel(), [*((wide * x).ravel() for x in np.ascontiguousarray(state.T, float)), wide.ravel()], flat.dtype)
            met.append(found)
            sums.append(total)
        found, total = np.concatenate(met), np.concatenate(sums)
        self.slopes = {"node": (found, total[:, :HIDDEN]), "node_bias": (found, total[:, HIDDEN])}
        back = back.reshape(inputs.shape[1], -1, HIDDEN)
        dh = np.zeros_like(h)
        steps = np.zeros((inputs.shape[1], len(h), 3 * HIDDEN), np.float32)
        for t in range(inputs.shape[1] - 1, -1, -1):
            before, z, r, n, own, going = trace[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            steps[t] = np.concatenate([dz, dr, dn], axis=1)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            g["state"] += before.T @ da
            dh = (dh * z + da @ w["state"].T) * going
        columns = np.ascontiguousarray(steps.reshape(-1, 3 * HIDDEN).T, float)
        self.slopes["input"] = self.inputs(inputs.T.ravel(), columns, flat.dtype)
        self.slopes |= {name: (every, slope) for name, slope in g.items()}
        flats = {name: slope.reshape(len(slope), slope[0].size if len(slope) else 1) for name, (_, slope) in self.slopes.items()}
        squares = {name: np.einsum("nk,nk->n", x, x) for name, x in flats.items()}
        scale = 1 / max(float(np.sqrt(sum(x.sum() for x in squares.values()))), 1)
        self.turn += 1
        size = self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn)
        for name, (at, slope) in self.slopes.items():
            if name in DENSE:
                first, second = self.first[name], self.second[name]
                first += 0.1 * (slope * scale - first)
                second += 0.01 * ((slope * scale) ** 2 - second)
                w[name] -= size * first / (np.sqrt(second) + 1e-8)
            else:
                self.squares[name][at] = total = self.squares[name][at] + squares[name] * (scale**2 / flats[name].shape[1])
                pace = (ROWS * self.rate * scale / np.sqrt(total + 1e-20)).astype(slope.dtype)
                w[name][at] -= (slope.T * pace).T
        return h


def scores(w: dict[str, np.ndarray], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log probability of each text of ``ids`` with its end, every text walked in step.

    Texts are ordered by length, so the first rows are those that still go on.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[:-1][order], lengths[order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    tokens = np.full(len(order), END)
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    rows = 0

    def settle() -> None:
        if held:
            logs = log_probabilities(w, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            at = 0
            for _, _, n in held:
                total[:n] += logs[at : at + n]
                at += n
            held.clear()

    n = len(order)
    for t in range(int(length[0]) + 1 if n else 0):
        n = int(np.searchsorted(-length, -t, "right"))
        h = step(w, tokens[:n], h[:n])[0]
        inside = length[:n] > t
        targets = np.where(inside, ids[np.minimum(begin[:n] + t, max(len(ids) - 1, 0))] if len(ids) else END, END)
        held.append((h, targets, n))
        tokens, rows = targets, rows + n
        if rows >= WINDOW_ROWS:
            settle()
            rows = 0
    settle()
    out = np.zeros(len(order))
    out[order] = total
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(h, tail, c): every token of ``texts`` (one text column) with its count, the end included."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ends = 0

        def flushed() -> pa.RecordBatch:
            hashes, tails, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            held[:] = [(found, tails[first], np.bincount(place, counts, len(found)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "tail", "c"])

        for table in tables:
            ends += table.num_rows
            for _, part in blocks(table.column(0)):
                words = Words(part)
                found, first, n = np.unique(words.hashes.view(np.int64), return_index=True, return_counts=True)
                held.append((found, (words.last[first] % TAILS).astype(np.int64), n))
                if sum(len(x[0]) for x in held) > 3_000_000:
                    table = flushed()
                    if table.num_rows > 1_500_000:
                        yield table
                        held.clear()
        if ends:
            held.append((np.asarray([END_HASH]), np.zeros(1, np.int64), np.asarray([ends])))
            yield flushed()

    parts = texts.mapInArrow(count, "h long, tail long, c long")
    return parts.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def rest_of_classes(table: DataFrame, top_tails: np.ndarray, counts: np.ndarray, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail class, the head words left out.

    ``counts`` starts with the end of a text; ``top_tails`` are the classes of the words after it.
    """
    tails, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for row in table.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # at most TAILS rows
        tails[row["tail"]], kinds[row["tail"]] = row["c"], row["n"]
    own = np.concatenate([[0], top_tails]).astype(int)[:head]
    np.subtract.at(tails, own, counts[:head].astype(float))
    np.subtract.at(kinds, own, (counts[:head] > 0).astype(float))
    return tails, kinds


def log_space(tails: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural logarithm of what a class's words and one unseen word share."""
    return np.log(tails + 0.5 * (kinds + 1))


def averaged(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> Model:
    """Each task learns from its texts starting at ``model``; the weights' mean, by tokens walked.

    Tasks send how far weights moved, in half precision; rows no task met are zeros and pack well.
    """

    def learn(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = model.weights()
        trainer, walked, left = Trainer(flat, vocabulary.head), 0, np.zeros(0, np.int32)
        for table in tables:
            stream = [left]
            for ids, _, _, starts in vocabulary.tokens(table.column(0)):
                stream.append(np.insert(ids, starts[:-1], END))
                walked += len(stream[-1])
            left = trainer.learn(np.concatenate(stream))
        if walked:
            trainer.finish(np.append(left, END))
            for at in range(0, len(flat), BLOCK):
                moved = (trainer.flat[at : at + BLOCK] - flat[at : at + BLOCK]).astype(np.float16)
                part = pa.array([moved.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([at]), part, pa.array([float(walked)])], names=["place", "part", "weight"])

    def mean(found: pa.Table) -> pa.Table:
        weights = found["weight"].to_numpy()
        value = sum(w * np.frombuffer(x.as_py(), np.float16).astype(np.float64) for w, x in zip(weights, found["part"], strict=True)) / weights.sum()
        return pa.table({"place": found["place"].slice(0, 1), "part": pa.array([value.astype(np.float16).tobytes()], pa.binary())})

    rows = texts.mapInArrow(learn, "place long, part binary, weight double").groupBy("place").applyInArrow(
        mean, "place long, part binary").toArrow()  # the weights once
    return model.after({place: np.frombuffer(part.as_py(), np.float16) for place, part in zip(rows["place"].to_pylist(), rows["part"], strict=True)})


def likelihoods(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    own = docs.select(F.col(key).alias("key"), tx.whole(text).alias("text"), training.alias("train"))
    train = own.filter("train").select("key", "text")
    table = tx.stored(counted(train.select("text")), "lm-counts")
    sums = table.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    distinct, total = int(sums[0]), int(sums[1])
    top = table.filter(F.col("h") != int(END_HASH)).orderBy(F.desc("c"), "h").limit(LOCAL).toPandas()
    ends = table.filter(F.col("h") == int(END_HASH)).select("c").first()
    hashes = np.concatenate([[END_HASH], top["h"].to_numpy(np.int64)])
    counts = np.concatenate([[ends[0] if ends else 0], top["c"].to_numpy(np.int64)])
    size = head_size(counts)
    vocabulary = Vocabulary(hashes, counts, size)
    head = np.zeros(size)
    head[: min(size, len(counts))] = counts[:size]
    tails, kinds = rest_of_classes(table, top["tail"].to_numpy(int), counts, size)
    model = Model(head, tails)
    part = F.pmod(F.xxhash64("key"), F.lit(8))
    for share in (part == 0, part != 0):
        model = averaged(train.filter(share).select("text"), vocabulary, model)
    shares = log_space(tails, kinds)

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpacked(model.weights(), size)
        for batch in tables:
            n = batch.num_rows
            columns: list[list[np.ndarray]] = [[], [], [], []]
            rest, rest_sizes = [], []
            all_ids, sizes = [], []
            for ids, found, hashes, starts in vocabulary.tokens(batch.column(1)):
                local = np.maximum(found, 0)
                logs = np.where(found >= 0, np.log10(local + 0.5), 0.0)
                tail = ids >= size
                per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])  # noqa: B023, E731
                columns[0].append(per_text(logs))
                columns[1].append(per_text(np.where(tail, logs, 0.0)))
                columns[2].append(per_text(np.where(tail, shares[np.maximum(ids - size, 0)], 0.0)))
                columns[3].append(per_text(found > 0))
                rest.append(hashes[found < 0])
                rest_sizes.append(per_text(found < 0))
                all_ids.append(ids)
                sizes.append(np.diff(starts))
            if not n:
                continue
            base, tail_logs, tail_shares, known = (np.concatenate(x) for x in columns)
            lengths = np.concatenate(sizes)
            logs = scores(w, np.concatenate(all_ids), np.concatenate([[0], np.cumsum(lengths)]))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(rest_sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths + 1), pa.array((known + (counts[0] > 0)).astype(np.int64)),
                 pa.array(base + np.log10(counts[0] + 0.5)), pa.array((logs - tail_shares) / np.log(10) + tail_logs),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest)))],
                names=["key", "n_tokens", "n_known", "base", "score", "rest"])

    key_type = own.schema["key"].dataType.simpleString()
    walked = tx.stored(own.select("key", "text").mapInArrow(
        score, f"key {key_type}, n_tokens long, n_known long, base double, score double, rest array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "lm-scores")
    rare = walked.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times")).join(
        table.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    space = float(np.log10(total + 0.5 * (distinct + 1)))
    return walked.drop("rest").join(rare, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
        (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score"))

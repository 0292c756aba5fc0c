"""Operators over whole tables, against brute force on small ones."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dialogue_lake.llm import gru_lm, iblt, line_crf, mixing, near_dedup, packing
from dialogue_lake.llm import textual as tx

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice("the of and a story river tree house walk sees old new light dark green".split()) + rng.choice(["", "", "s", "ly", str(rng.randrange(400))]) for _ in range(n)]


def shingles(text, size):
    words = WORD.findall((text or "").translate(LETTERS))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(texts, size):
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies():
    """A group of edited copies at all distances, exact copies and strangers."""
    rng, base = random.Random(5), prose(1, 200)
    texts = list(ODD)
    for i in range(60):
        words = list(base)
        for _ in range(i % 20):
            words[rng.randrange(200)] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    return texts + [" ".join(base)] * 5 + [" ".join(base).upper()] + [" ".join(prose(9 + i, 120)) for i in range(20)]


def test_near_duplicates(make, copies):
    got = {r.id: r for r in near_dedup.components_of(make(copies), words=4).collect()}
    assert [got[i].component_id for i in range(len(copies))] == components(copies, 4)
    assert [got[i].n_shingles for i in range(len(copies))] == [len(shingles(t, 4)) for t in copies]
    assert near_dedup.components_of(make([]), words=4).count() == 0


def test_packing(make):
    texts = [*ODD, *[" ".join(prose(i, 20 + 37 * i)) for i in range(60)]]
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {i: np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = packing.packed(make(texts), path("word_bpe_49k.json")).collect()
    covered, filled = {i: [] for i in ids}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, end in [(v, len(ids[k])) for k, v in covered.items()] + [(v, None) for v in filled.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end if end else at <= packing.SEQUENCE
    assert len(filled) <= 1.1 * sum(map(len, ids.values())) / packing.SEQUENCE + 2
    assert packing.packed(make([]), path("word_bpe_49k.json")).count() == 0


def test_linear_program_is_solved():
    demand = np.random.default_rng(2).integers(0, 30, 64)
    patterns, amounts = packing.relaxed(demand.astype(float), 64)
    assert patterns.T @ amounts == pytest.approx(demand.astype(float), abs=1e-6)
    # No pattern is worth more than the sequence it fills, so none can improve the solution.
    assert packing.best_pattern(np.linalg.inv(patterns.T).sum(axis=0), 64)[0] <= 1 + 1e-5
    plan = packing.planned(demand, 64)
    assert (sum(times * pattern for times, pattern in plan) == demand).all()


def test_mixing(make):
    texts = [" ".join(prose(i, 5 + i % 40)) for i in range(300)] + [None, ""]
    sources = [None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}" for i in range(300)] + ["empty", "hot"]
    docs = make(texts, sources=sources)
    rows = mixing.mixed(docs).collect()
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, set(size), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.times <= 3
        taken[r.source] += r.size * r.times
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    repeated = mixing.mixed_rows(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.times if r.size else 1 for r in rows)
    assert mixing.mixed(make([])).count() == 0


def paragraphs(text):
    return {(x, n) for x, total in Counter(re.findall(iblt.PARAGRAPH, text)).items() for n in range(total)}


@pytest.mark.parametrize("many", [8192, 3])
def test_sketches(make, monkeypatch, many):
    """Sparse, null and repeated ids, texts of equal lines in other numbers, against plain sets."""
    monkeypatch.setattr(iblt, "MANY", many)
    texts = [*ODD, *[". ".join(" ".join(prose(i, 7)) for i in range(k, k + 30)) for k in range(12)], "same\ntext", "same\ntext", "same\ntext\ntext"]
    texts += [f"a line {i}\n" * (i % 3 + 1) for i in range(20)]
    ids = [None if i in (4, 9) else 7 if i in (5, 6, 12) or i > 26 else 3 * i + (50000 if i > 8 else 0) for i in range(len(texts))]
    rows = iblt.compared(make(texts, ids)).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.n_chars, r.fingerprint), []).append(r)
    assert len(rows) == len(texts)
    # Every row is followed by some other one, in descending ids.
    by_id = {}
    for i, t in zip(ids, texts, strict=True):
        by_id.setdefault(i, []).append(t or "")
    order = sorted(by_id, key=lambda i: (i is None, -(i or 0)))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for place, i in enumerate(order):
        mine = [r for r in rows if r.doc_id == i]
        assert len(mine) == len(by_id[i])
        possible = [*by_id[i], *by_id[order[(place + 1) % len(order)]]]
        for r in mine:
            fits = []
            for text in by_id[i]:
                for after in possible:
                    third = len(text) // 3
                    changed = text[: len(text) - third] + after[:third]
                    fits.append((len(text), hashlib.sha256(changed.encode()).hexdigest(),
                                 round(like(paragraphs(text), paragraphs(changed)), 9), round(like(paragraphs(text), paragraphs(after)), 9)))
            assert (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) in fits
    same = [r.fingerprint for r, t in ((r, r.doc_id) for r in rows) if t in (ids[23], ids[24], ids[25])]
    assert len(same) == 3 and len(set(same)) == 2


def test_order_of_ids(make):
    texts = ["one. two. three", "four. five", "six. seven. eight", None]
    rows = {r.doc_id: r for r in iblt.compared(make(texts, [5, 100000, -3, 77])).collect()}
    order = [(100000, "four. five", ""), (77, "", "one. two. three"), (5, "one. two. three", "six. seven. eight"), (-3, "six. seven. eight", "four. five")]
    for i, text, after in order:
        third = len(text) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
    assert iblt.compared(make([])).count() == 0
    alone = iblt.compared(make(["a. b. c."])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_two_fingerprints_give_away_what_differs(make, spark):
    texts = ["one\ntwo\nthree\nthree\n", "one\nthree\nfour\n", "", "x", "same", "same", "\n".join(map(str, range(900)))]
    rows = {r.doc_id: r.fingerprint for r in iblt.compared(make(texts)).collect()}
    sets = [set(r.d) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(iblt.digests(F.col("t")).alias("d")).collect()]
    for i in range(len(texts)):
        for j in range(len(texts)):
            many = len(sets[i] ^ sets[j]) > 100
            assert iblt.difference(rows[i], rows[j]) == (None if many else (sets[i] - sets[j], sets[j] - sets[i]))


def test_language_model(make):
    texts = [*ODD, *[" ".join(prose(i, 150)) for i in range(150)]]
    train = F.col("doc_id") % 5 != 1
    rows = {r.doc_id: r for r in gru_lm.likelihoods(make(texts), train).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LETTERS)), None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if i % 5 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert rows[i].base_score == pytest.approx(base) and rows[i].train_tokens == total
        assert (rows[i].n_tokens, rows[i].n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
    assert gru_lm.likelihoods(make([]), train).count() == 0


def test_class_shares_sum_to_one(make):
    words = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(3000)]
    texts = [" ".join(words[: 3000 - 300 * i]) for i in range(10)]
    table = gru_lm.counted(make(texts).select("text"))
    rows = sorted(((r.h, r.tail, r.c) for r in table.collect() if r.h != gru_lm.END_HASH), key=lambda r: (-r[2], r[0]))
    counts = np.asarray([len(texts), *[c for _, _, c in rows]])
    tails, kinds = gru_lm.rest_of_classes(table, np.asarray([t for _, t, _ in rows]), counts)
    sums = np.full(gru_lm.TAILS, 0.5)
    for _, tail, c in rows[gru_lm.HEAD - 1 :]:
        sums[tail] += c + 0.5
    assert sums.max() > 100 and sums / np.exp(gru_lm.log_space(tails, kinds)) == pytest.approx(np.ones(gru_lm.TAILS))


def test_head_grows_with_the_counts_and_every_token_is_walked():
    assert gru_lm.head_size(np.ones(5)) == gru_lm.HEAD
    counts = np.sort(np.random.default_rng(0).integers(gru_lm.RARE, 1000, 20_000))[::-1]
    head = gru_lm.head_size(np.concatenate([counts, np.ones(5000)]))
    assert 20_000 <= head < 20_000 + gru_lm.per_class(head)
    flat = gru_lm.initial(np.ones(head), np.ones(gru_lm.TAILS))
    trainer, met, stream = gru_lm.Trainer(flat, head), [], np.arange(1, 9000)
    window = trainer.window
    trainer.window = lambda inputs, targets, h: met.extend(targets.ravel()) or window(inputs, targets, h)
    left = trainer.learn(stream[:5000])
    trainer.finish(np.concatenate([left, stream[5000:]]))
    assert sorted(met) == list(range(2, 9000))
    w = gru_lm.unpacked(trainer.flat, head)
    assert (w["input"][1:8999] != gru_lm.unpacked(flat, head)["input"][1:8999]).any(axis=1).all()


def test_tasks_are_sent_two_bytes_a_weight():
    head, tails = np.ones(gru_lm.HEAD), np.ones(gru_lm.TAILS)
    first = gru_lm.Model(head, tails)
    flat = first.weights()
    assert (flat == gru_lm.initial(head, tails)).all() and len(pickle.dumps(first)) < len(flat)
    move = np.random.default_rng(2).standard_normal(len(flat)).astype(np.float16)
    moved = first.after({at: move[at : at + 5000] for at in range(0, len(flat), 5000)})
    assert (moved.weights() == flat + move.astype(np.float32)).all()
    again = moved.after({5000: move[:3]})
    assert again.weights()[5000:5003] == pytest.approx(moved.weights()[5000:5003] + move[:3].astype(np.float32), rel=2e-3, abs=2e-3)
    assert (np.delete(again.weights(), range(5000, 5003)) == np.delete(moved.weights(), range(5000, 5003))).all()
    assert len(pickle.dumps(again)) < 2 * len(flat) + 20_000


def test_gradients_are_those_of_the_likelihood():
    flat = gru_lm.initial(np.ones(gru_lm.HEAD), np.ones(gru_lm.TAILS)).astype(np.float64)
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, gru_lm.HEAD + gru_lm.TAILS, (2, 4, 5))
    inputs[1, 2] = gru_lm.END

    def loss(weights):
        w, h, total = gru_lm.unpacked(weights), np.zeros((4, gru_lm.HIDDEN)), 0.0
        for t in range(5):
            h = gru_lm.step(w, inputs[:, t], h * (inputs[:, t] != gru_lm.END)[:, None])[0]
            total -= gru_lm.log_probabilities(w, h, targets[:, t]).sum()
        return total / 20

    trainer = gru_lm.Trainer(flat)
    trainer.rate = 0
    trainer.window(inputs, targets, np.zeros((4, gru_lm.HIDDEN), np.float32))
    grad = trainer.grad.copy()
    for place in [*np.flatnonzero(np.abs(grad) > 1e-4)[::400], int(np.argmax(np.abs(grad)))]:
        step = np.zeros_like(flat)
        step[place] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(grad[place], rel=0.02, abs=1e-5)


def test_chances_sum_to_one_and_a_window_meets_few_rows():
    rng = np.random.default_rng(5)
    counts = np.sort(rng.integers(gru_lm.RARE, 5000, 70_000))[::-1].astype(float)
    head = gru_lm.head_size(counts)
    counts, tails = np.concatenate([counts, np.zeros(head - len(counts))]), rng.integers(1, 99, gru_lm.TAILS).astype(float)
    flat, every = gru_lm.initial(counts, tails), np.arange(head + gru_lm.TAILS)
    shares = np.concatenate([counts, tails]) + 0.5
    still = gru_lm.log_probabilities(gru_lm.unpacked(flat, head), np.zeros((len(every), gru_lm.HIDDEN), np.float32), every)
    assert np.exp(still) == pytest.approx(shares / shares.sum(), rel=1e-3)
    trainer = gru_lm.Trainer(flat, head)
    inputs, targets = rng.integers(0, head + gru_lm.TAILS, (2, 16, 5))
    for _ in range(3):
        h = trainer.window(inputs, targets, np.zeros((16, gru_lm.HIDDEN), np.float32))
    for state in h[:3]:
        moved = gru_lm.log_probabilities(trainer.w, np.tile(state, (len(every), 1)), every)
        assert np.exp(moved.astype(float)).sum() == pytest.approx(1, abs=1e-3) and moved != pytest.approx(still)
    # Of 70,000 words a window moves the nodes above its own only, not whole classes.
    assert 16 < (trainer.w["node"] != gru_lm.unpacked(flat, head)["node"]).any(axis=1).sum() <= 13 * targets.size


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(3)
    good, ties, starts = rng.standard_normal(7), rng.standard_normal((2, 2)), np.asarray([0, 4, 5, 7])
    got, _ = line_crf.forward_backward(good, ties, starts)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        weights = {}
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            weights[tuple(y)] = math.exp(sum(good[a + k] * y[k] for k in range(b - a)) + sum(ties[y[k], y[k + 1]] for k in range(b - a - 1)))
        for k in range(b - a):
            assert got[a + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / sum(weights.values()))


def test_quality_scores(make, spark):
    texts = [" ".join(prose(i, 60)) if i % 2 else " ".join(f"{w}$$$" for w in prose(i, 60)) for i in range(80)] + ODD
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = make(texts)
    rows = {r.doc_id: r.s for r in docs.select("doc_id", line_crf.scored(docs, labels).alias("s")).collect()}
    assert all((rows[i] > 0.5) == (i % 2 == 1) for i in range(80)) and all(0 <= x <= 1 for x in rows.values())
    nothing = labels.filter("false")
    assert {r.s for r in docs.select(line_crf.scored(docs, nothing).alias("s")).collect()} == {0.5}


def test_pipeline(make, copies, tmp_path):
    docs = make([*copies, 'x token = "0123456789abcdef0123456789abcdef" ' + " ".join(prose(77, 60))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark, at = docs.sparkSession, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        if name == "near_dedup":
            before = {r.doc_id: r.text for r in at.collect()}
            places = sorted(before)
            roots = components([before[i] for i in places], 5)
            assert sorted(r.doc_id for r in after.collect()) == [i for k, i in enumerate(places) if roots[k] == k]
        if name == "secret_scan":
            assert after.filter("text like '%0123456789abcdef%'").count() == 0 and after.count() == at.count()
        at = tx.stored(after, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in at.collect()}

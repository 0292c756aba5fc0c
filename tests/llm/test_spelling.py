"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dialogue_lake.llm import spelling

from .conftest import ODD

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LETTERS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, n_near[w], words.get(forms[w])))
    return out


def edit(rng, word, letters="abcdeé÷Àst"):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def texts(seed, n_words=30, n_texts=80):
    """Words, their edited forms and edited forms of those, each rarer than the one before."""
    rng = random.Random(seed)
    words, weights = [], []
    for _ in range(n_words):
        forms = ["".join(rng.choice("abcdeé÷Àst") for _ in range(rng.randint(6, 9)))]
        forms += [edit(rng, forms[0]) for _ in range(2)]
        forms += [edit(rng, forms[1]) for _ in range(2)]
        words += forms
        weights += [rng.choice([150, 400]), 30, 20, 3, 3]
    return [" ".join(rng.choice([w, w, w.upper()]) for w in rng.choices(words, weights, k=150)) for _ in range(n_texts)]


def results(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_comparison(make, monkeypatch, small):
    if small:
        for name, value in (("SAMPLE", 40), ("SAMPLE_LEAF", 4), ("LEAF", 8), ("SMALL", 2), ("POINTS", 3), ("QUESTIONS", 5), ("CHUNK", 200)):
            monkeypatch.setattr(spelling, name, value)
    own = texts(3) + list(ODD) * 6 + ["yz" * 3000 + "q " + "yz" * 3000 + " "] * 6 + ["listen silent tinsel enlist listens " * 5]
    ids = [None if i == 5 else i // 2 for i in range(len(own))]
    expected = plain(list(zip(ids, own, strict=True)))
    assert sum(1 for r in expected if r[1]) > 10 and any(r[1] != r[2] for r in expected if r[1])
    assert results(spelling.variants(make(own, ids))) == sorted(expected, key=repr)


@pytest.mark.parametrize("own", [[], [None, ""], ["short words only"], ["single " * 7]])
def test_few_words(make, own):
    assert results(spelling.variants(make(own))) == sorted(plain(list(enumerate(own))), key=repr)


def test_tree_finds_all_points_within_the_radius():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (500, spelling.WIDTH)) * (rng.random((500, spelling.WIDTH)) < 0.15)
    got = {(int(i), int(j)) for a, b in spelling.pairs_within(points, points, 2) for i, j in zip(a, b, strict=True)}
    distance = np.abs(points[:, None] - points).sum(axis=2)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= 2)), strict=True))
    tree = spelling.Tree(points[:200], 5)
    rows, leaves = tree.within(points, 0)
    assert sorted(rows) == list(range(500))
    asked, near_leaves = tree.within(points, 2)
    home = dict(zip(rows.tolist(), leaves.tolist(), strict=True))
    reached = set(zip(asked.tolist(), near_leaves.tolist(), strict=True))
    assert all((i, home[j]) in reached for i, j in got)
    assert len(reached) < 0.7 * 500 * tree.leaves

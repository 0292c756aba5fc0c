"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from dialogue_lake.llm import repeated_bytes

from .conftest import ODD

WINDOW = 400


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + WINDOW] for d in data for i in range(len(d) - WINDOW + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - WINDOW + 1):
            if seen[d[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = b"\x01" * WINDOW
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def results(df):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))) for r in df.collect()]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def passages(seed, n=60):
    """Texts made of shared and own parts, edited copies, and parts about as long as a window."""
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (60, 75, 78, 80, 90, 150, 400)]
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(0, 60)) + rng.choice(shared) + prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            text += rng.choice(shared) + rng.choice(["", rng.choice(shared)])
        if i % 4 == 0 and out:
            other = rng.choice(out)
            at = rng.randrange(len(other) + 1)
            text = other[:at] + rng.choice(["", "q", "Q!"]) + other[at + rng.randint(0, 2) :]
        out.append(text)
    return out


@pytest.mark.parametrize("few", [1000, 2])
def test_equals_all_windows(make, monkeypatch, few):
    monkeypatch.setattr(repeated_bytes, "FEW", few)
    monkeypatch.setattr(repeated_bytes, "STEP", 3000)
    rng = random.Random(1)
    own = [*ODD, *passages(2), "a" * 700, "xy" * 450 + "z", "x" * 399, prose(rng, 2000), "line one of it\n" * 60, prose(rng, 90)]
    own += [own[-1], own[-1] + "!", None]
    ids = [i // 2 if i % 7 else None for i in range(len(own))]
    expected = plain(own)
    assert sum(1 for x in expected if 0 < x[1] < x[0]) > 20
    got = results(repeated_bytes.deduplicated(make(own, ids)))
    assert sorted(got, key=repr) == sorted(zip(ids, expected, strict=True), key=repr)


@pytest.mark.parametrize("own", [[], [None, ""], ["b" * 400], ["b" * 401], ["ab" * 300, "ab" * 300]])
def test_small_tables(make, own):
    got = results(repeated_bytes.deduplicated(make(own)))
    assert sorted(got, key=repr) == sorted(enumerate(plain(own)), key=repr)


def test_a_very_long_text_is_cut_into_parts(make, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "STEP", 1 << 14)
    rng = random.Random(9)
    long = prose(rng, 20000)
    at = len(long) // 2
    own = [long, long[at : at + 3000], prose(rng, 30) + long[-900:]]
    got = results(repeated_bytes.deduplicated(make(own)))
    assert sorted(got) == sorted(enumerate(plain(own)))

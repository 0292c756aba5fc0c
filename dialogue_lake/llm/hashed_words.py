"""Words of many texts at once as 64-bit hashes, from the bytes of an Arrow column.

A word is a run of bytes other than blanks and line breaks, A-Z in lower case. Its hash is
a polynomial over its bytes, taken from running sums over the whole block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """hashes: of all words of a block; starts: the first word of each text, and the end;
    begin: each word's first byte; last: its last byte, as a value."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first, cut = inside.copy(), np.zeros(len(data) + 1, bool)
        cut[ends] = True
        first[1:] &= ~inside[:-1] | cut[1:-1]
        final = inside.copy()
        final[:-1] &= ~inside[1:] | cut[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(final) + 1
        lower = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
        powers = np.cumprod(np.full(len(data), BASE))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((lower + np.uint64(1)) * powers, out=sums[1:])
        back = np.cumprod(np.full(len(data), INVERSE))
        own = (sums[end] - sums[begin]) * back[begin]
        self.hashes = mixed(own + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.begin = begin
        self.starts = np.searchsorted(begin, ends)
        self.last = lower[end - 1] if len(end) else np.zeros(0, np.uint8)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``size`` words in a row, text by text, and where each text starts.

        A shorter text that has words is one shingle.
        """
        counts = np.diff(self.starts)
        n = np.where(counts >= size, counts - size + 1, counts > 0)
        starts = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(counts)), n)
        at = self.starts[:-1][text] + np.arange(starts[-1]) - starts[:-1][text]
        upto = self.starts[1:][text]
        padded = np.concatenate([self.hashes, np.zeros(size, np.uint64)])
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            part = np.where(at + k < upto, padded[at + k], np.uint64(k + 1))
            total = mixed(total * BASE + part)
        return total, starts


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a column of about ``limit`` bytes, whole texts each, with their places."""
    sizes = pa.compute.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    at = 0
    for length in np.unique(group, return_counts=True)[1] if len(sizes) else []:
        yield at, texts.slice(at, int(length))
        at += int(length)

"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split where white space follows another character: byte-level BPE never makes a
token across such a place, so the parts' lengths add up. Parts met before come from a
bounded cache; new ones are encoded in batches of bounded bytes, however long the texts
are. A missing text is empty and has no tokens; rows and other columns stay as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
CACHE_PARTS = 400_000
CACHED_LENGTH = 64

PART = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
#: Marks a part after which a cut isn't safe; far above any count of tokens.
UNSAFE = 1 << 40


def tokenizer(path: str):
    """The tokenizer of a file; it keeps to one thread, as Spark runs a task on every core."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def batches(parts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """``parts`` in lists of about ``limit`` bytes; a longer part comes alone."""
    held, size = [], 0
    for part in parts:
        own = len(part.encode())
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield held


class Counter:
    """Counts tokens of texts; one lives in a task."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        self.encode, self.batch_bytes = tokenizer(path).encode_batch_fast, batch_bytes
        self.known: dict[str, int] = {}

    def lengths(self, parts: list[str]) -> Iterator[tuple[str, int]]:
        for batch in batches(parts, self.batch_bytes):
            yield from zip(batch, (len(x) for x in self.encode(batch, add_special_tokens=False)), strict=True)

    def counts(self, texts: list[str]) -> list[int]:
        found: list[int] = []
        for text in texts:
            parts = PART.findall(text)
            new = {x for x in parts if x not in self.known}
            if new:
                if len(self.known) > CACHE_PARTS:
                    self.known.clear()
                    new = set(parts)
                # Other white space than ASCII's at a part's end could join the next part's.
                self.known.update((x, UNSAFE if x[-1].isspace() and x[-1] not in " \t\n\r\v\f" else n) for x, n in self.lengths(sorted(new)))
            total = sum(map(self.known.__getitem__, parts))
            if total >= UNSAFE:
                total = sum(n for _, n in self.lengths([text]))
            found.append(total)
            for x in new:
                if len(x) > CACHED_LENGTH:
                    del self.known[x]
        return found


def n_tokens(text: Column, path: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """The number of tokens of ``text`` by the tokenizer file at ``path``, which every executor has."""

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path, batch_bytes)
        for column in columns:
            found: list[int] = []
            for start in range(0, len(column), 256):
                found += counter.counts([x or "" for x in column.slice(start, 256).to_pylist()])
            yield pa.array(found, pa.int64())

    return count(text)

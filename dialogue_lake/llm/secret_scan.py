"""Secret scans: base patterns, and strings that look random to two Markov models.

Characters of a string are explained by two first-order chains, one trained on labelled
random strings and one on labelled ordinary identifiers. A string whose mean
log-likelihood ratio is above a threshold is a secret; the shorter it is, the higher the
threshold. Strings of few different characters are repetitions, not random. Where base
spans cover a candidate wholly, they stay alone.

A missing text is empty and has no spans. Rows are scanned one by one, whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns of the contract, in the order of their kinds.
KINDS = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
#: Strings of SHORTEST characters with a letter, or of LONG: shorter numbers are dates, calls or amounts.
SHORTEST, LONG = 12, 20
CANDIDATE = re.compile(
    rf"(?<![A-Za-z0-9+/_=-])(?:(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{SHORTEST},}}|[0-9+/_=-]{{{LONG},}})(?![A-Za-z0-9+/_=-])")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: For LONG strings; STEEPER is added for each character less.
THRESHOLD, STEEPER = 0.4, 0.1
SPANS = "array<struct<kind:string,start:int,end:int>>"

PARTS = (
    "get set user name list item value index count file path data type node state event update create delete remove read write load save "
    "parse format string number array object table column row key id time date start end size length width height error message handler "
    "request response client server config option default result status code text line word page document source target input output "
    "the of and to that with this from have not are was which their about there other these would into more only some than them over "
    "und der die nicht eine werden durch nach über sein que para como está pour dans avec leur cette être"
).split()


def labelled_samples(n: int = 4000) -> list[tuple[str, bool]]:
    """(string, is it random): strings of four alphabets, and identifiers in four styles.

    Both follow from digests of running numbers, so every run trains the same models.
    """
    alphabets = (ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:64], ALPHABET[26:62])
    samples = []
    for i in range(n):
        digest = hashlib.sha512(str(i).encode()).digest()
        letters = alphabets[i % 4]
        samples.append(("".join(letters[x % len(letters)] for x in digest[: 20 + i % 40]), True))
        chosen = [PARTS[(digest[2 * k] * 256 + digest[2 * k + 1]) % len(PARTS)] for k in range(3 + i % 5)]
        style = i // 4 % 4
        if style == 2:
            text = "".join(x.title() for x in chosen)
        else:
            text = ("_", "-", "", "/")[style].join(chosen)
        samples.append((text + (str(digest[60] % 100) if i % 3 == 0 else ""), False))
    return samples


def trained(samples: list[tuple[str, bool]]) -> np.ndarray:
    """Log ratios of the transition probabilities, random against ordinary; the first row starts a string."""
    n = len(ALPHABET)
    places = {c: i for i, c in enumerate(ALPHABET)}
    counts = np.full((2, n + 1, n), 0.5)
    for text, is_random in samples:
        before = n
        for c in text:
            if c in places:
                counts[int(is_random), before, places[c]] += 1
                before = places[c]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


class Scanner:
    def __init__(self, ratios: np.ndarray, threshold: float = THRESHOLD):
        self.ratios, self.threshold = ratios, threshold
        self.places = np.full(128, -1)
        self.places[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio of the characters of a candidate."""
        codes = self.places[np.frombuffer(text.encode(), np.uint8)]
        return float(self.ratios[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes].mean())

    def is_random(self, text: str) -> bool:
        if 4 * len(set(text)) < min(len(text), 2 * LONG):
            return False
        return self.score(text) > self.threshold + STEEPER * max(0, LONG - len(text))

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", *m.span()) for m in KINDS["assign"].finditer(text) if len(m[1]) >= 8]
        found += [("access", *m.span()) for m in KINDS["access"].finditer(text) if len(m[0]) >= 16]
        return found + [("hex", *m.span()) for m in KINDS["hex"].finditer(text)]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind as listed, the model's kind last."""
        base = self.base(text)
        found = [
            ("random", *m.span()) for m in CANDIDATE.finditer(text)
            if self.ratios is not None and self.is_random(m[0])]
        if base and found:
            # Unions of base spans by start; a candidate is covered if one union holds it.
            unions: list[list[int]] = []
            for start, end in sorted((start, end) for _, start, end in base):
                if unions and start <= unions[-1][1]:
                    unions[-1][1] = max(unions[-1][1], end)
                else:
                    unions.append([start, end])
            at = np.searchsorted([x[0] for x in unions], [x[1] for x in found], "right") - 1
            found = [x for x, i in zip(found, at, strict=True) if i < 0 or unions[i][1] < x[2]]
        order = {kind: i for i, kind in enumerate((*KINDS, "random"))}
        return sorted(base + found, key=lambda x: (x[1], order[x[0]]))


def secret_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """Spans (kind, start, end) of each text in code points, end exclusive."""
    ratios = trained(labelled_samples())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(ratios, threshold)
        for column in columns:
            found = []
            for start in range(0, len(column), 256):
                found += [
                    [{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(x or "")]
                    for x in column.slice(start, 256).to_pylist()]
            yield pa.array(found, kind)

    return scan(text)


def redacted(text: Column, threshold: float = THRESHOLD, mark: str = "[secret]") -> Column:
    """Each text with ``mark`` in place of its secrets; overlapping spans become one mark."""
    ratios = trained(labelled_samples())

    @F.arrow_udf("string")
    def redact(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(ratios, threshold)
        for column in columns:
            found = []
            for start in range(0, len(column), 256):
                for text in column.slice(start, 256).to_pylist():
                    spans = scanner.spans(text or "")
                    parts, at = [], 0
                    for _, begin, end in spans:
                        if begin >= at:
                            parts += [text[at:begin], mark]
                        at = max(at, end)
                    found.append("".join([*parts, text[at:]]) if spans else text)
            yield pa.array(found, pa.string())

    return redact(text)

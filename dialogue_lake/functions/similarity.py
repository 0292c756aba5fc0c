"""String similarity and the small assignment problem, as Arrow functions.

Spark spreads the rows; each function only works on one Arrow batch at a time.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio_of(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), the LCS found with one integer as a bit row."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


#: Pairs that are compared together; the longest string that fits into one whole number as a bit row.
TOGETHER, BITS = 1 << 13, 63


def characters(texts: list[str], alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, or places in ``alphabet`` (0: not there); the text and the place in it of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if alphabet is not None:
        at = np.minimum(np.searchsorted(alphabet, points), max(len(alphabet) - 1, 0))
        points = np.where(alphabet[at] == points, at + 1, 0) if len(alphabet) else np.zeros(len(points), np.int64)
    starts = np.cumsum(lengths) - lengths
    return points, np.repeat(np.arange(len(texts)), lengths), np.arange(len(points)) - np.repeat(starts, lengths)


#: Letters from rare to frequent. Any order is right; this one keeps the lists of an index short.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "
#: Bits of a bag element: occurrence, then code point, then how rare it is.
OCCURRENCE, POINT = 32, 21


def bags_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The ordered bags of all texts in a row, where each starts, and two bit sets of every bag.

    Frequent letters have bits of their own, in one set for their first and in the other for
    their second occurrence; all other elements share the bits that are left.
    """
    point, text, _ = characters(texts)
    point = point[np.lexsort((point, text))].astype(np.int64)
    at = np.arange(len(point))
    fresh = np.ones(len(point), bool)
    fresh[1:] = (np.diff(point) != 0) | (np.diff(text) != 0)
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1
    rank = np.zeros(128, np.int64)
    rank[[ord(c) for c in RARE_FIRST]] = np.arange(len(RARE_FIRST)) + 1
    known, common = np.where(point < 128, rank[point & 127], 0), len(RARE_FIRST)
    rarity = np.maximum(known - 13 * (nth - 1), 0)
    element = (rarity << (OCCURRENCE + POINT)) | (point << OCCURRENCE) | nth
    spread = ((point << 16) + nth).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread = (((spread ^ (spread >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)
    sets = []
    for own in (1, 2):
        bit = np.where((known > 0) & (nth == own), known - 1, common + spread % (64 - common))
        bits = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(bits, text, (np.uint64(1) << bit.astype(np.uint64)).view(np.int64))
        sets.append(bits)
    return element[np.lexsort((element, text))], np.searchsorted(text, np.arange(len(texts) + 1)), sets


@F.arrow_udf(T.StructType().add("bag", T.ArrayType(T.LongType())).add("first", T.LongType()).add("second", T.LongType()))
def character_bag(texts: pa.Array) -> pa.Array:
    """The ordered bag of a string, one long for each character, and its bit sets."""
    elements, starts, (first, second) = bags_of(texts.fill_null("").to_pylist())
    bags = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(elements))
    return pa.StructArray.from_arrays([bags, pa.array(first), pa.array(second)], names=["bag", "first", "second"])


def short_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio_of`` for many pairs, character after character of ``a`` for all of them at once; none of ``b`` over ``BITS``."""
    (ia, ua), (ib, ub) = pd.factorize(np.asarray(a, object)), pd.factorize(np.asarray(b, object))
    alphabet = np.unique(characters(list(ub))[0])
    point, text, place = characters(list(ub), alphabet)
    masks = np.zeros((len(ub), len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(masks, (text, point), np.uint64(1) << place.astype(np.uint64))
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    point, text, place = characters(list(ua), alphabet)
    letters = np.zeros((int(na.max()), len(ua)), np.int64)
    letters[place, text] = point
    order = np.argsort(-na, kind="stable")
    ia, ib, longest = ia[order], ib[order], na[order]
    row = full = (np.uint64(1) << nb[order].astype(np.uint64)) - np.uint64(1)
    row = row.copy()
    for t in range(len(letters)):
        n = int(np.searchsorted(-longest, -t))
        held = row[:n]
        hit = held & masks[ib[:n], letters[t, ia[:n]]]
        row[:n] = ((held + hit) | (held - hit)) & full[:n]
    both = na[order] + nb[order]
    out = np.empty(len(a))
    out[order] = np.where(both > 0, 2 * (nb[order] - np.bitwise_count(row).astype(np.int64)) / np.maximum(both, 1), 1.0)
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), TOGETHER):
        x, y = a[at : at + TOGETHER], b[at : at + TOGETHER]
        short = [n for n, (p, q) in enumerate(zip(x, y, strict=True)) if len(p) <= 8 * BITS and len(q) <= BITS]
        part = out[at : at + TOGETHER]
        if short:
            part[short] = short_ratios([x[n] for n in short], [y[n] for n in short])
        for n in set(range(len(x))).difference(short):
            part[n] = indel_ratio_of(x[n], y[n])
    return out


def lexical_scores(a: list[str], b: list[str]) -> np.ndarray:
    plain = indel_ratios(a, b)
    # Texts of one token equal their sorted tokens, blanks at the ends apart.
    moved = [n for n, (x, y) in enumerate(zip(a, b, strict=True)) if " " in x or " " in y or x.split() != [x] or y.split() != [y]]
    ordered = plain.copy()
    ordered[moved] = indel_ratios([token_sorted(a[n]) for n in moved], [token_sorted(b[n]) for n in moved])
    return 0.75 * plain + 0.25 * ordered


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios([x or "" for x in a], [x or "" for x in b]))


@F.pandas_udf(T.DoubleType())
def lexical_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Three quarters plain ratio, one quarter ratio of the sorted tokens."""
    return pd.Series(lexical_scores(list(a), list(b)))


VOWELS = "aeiou"
_PLAIN = {"l": "l", "m": "m", "n": "n", "r": "r", "f": "f", "j": "j", "b": "b",
          "q": "k", "v": "f", "z": "s"}


def metaphone_of(text: str) -> str:
    """Lawrence Philips' Metaphone code of a word, in capitals; accented letters count as plain ones."""
    s = re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", text.lower()))
    if s[:2] in ("ae", "gn", "kn", "pn", "wr"):
        s = s[1:]
    elif s[:1] == "x":
        s = "s" + s[1:]
    elif s[:2] == "wh":
        s = "w" + s[2:]
    code: list[str] = []
    i = 0
    while i < len(s):
        c, before, after = s[i], s[i - 1 : i] if i else "", s[i + 1 : i + 2]
        rest = s[i:]
        i += 1
        if c == before and c != "c":
            continue
        if c in VOWELS:
            if i == 1:
                code.append(c)
        elif c in _PLAIN:
            if not (c == "b" and before == "m" and not after):
                code.append(_PLAIN[c])
        elif c == "c":
            if rest.startswith("cia") or (rest.startswith("ch") and before != "s"):
                code.append("x")
                i += rest.startswith("ch")
            elif rest.startswith("ch"):
                code.append("k")
                i += 1
            elif after and after in "eiy":
                if before != "s":
                    code.append("s")
            else:
                code.append("k")
        elif c == "d":
            if after == "g" and s[i + 1 : i + 2] and s[i + 1] in "eiy":
                code.append("j")
                i += 1
            else:
                code.append("t")
        elif c == "g":
            if after == "h":
                if s[i + 1 : i + 2] and s[i + 1] not in VOWELS:
                    continue
                if i + 1 < len(s):
                    code.append("k")
                    i += 1
            elif after == "n":
                if rest in ("gn", "gned"):
                    continue
                code.append("k")
            elif after and after in "eiy" and before != "g":
                code.append("j")
            else:
                code.append("k")
        elif c == "h":
            if after and after in VOWELS and before not in set("csptg"):
                code.append("h")
        elif c == "k":
            if before != "c":
                code.append("k")
        elif c == "p":
            if after == "h":
                code.append("f")
                i += 1
            else:
                code.append("p")
        elif c == "s":
            if after == "h":
                code.append("x")
                i += 1
            elif rest.startswith(("sio", "sia")):
                code.append("x")
            else:
                code.append("s")
        elif c == "t":
            if rest.startswith(("tia", "tio")):
                code.append("x")
            elif after == "h":
                code.append("0")
                i += 1
            elif not rest.startswith("tch"):
                code.append("t")
        elif c in "wy":
            if after and after in VOWELS:
                code.append(c)
        elif c == "x":
            code.append("ks")
    return "".join(code).upper()


@F.pandas_udf(T.StringType())
def metaphone(values: pd.Series) -> pd.Series:
    """Code of a compact (normalised, space-free) form; use on distinct strings."""
    return values.map(lambda v: None if v is None else metaphone_of(v))


def best_assignment(matrix: list[list[int]]) -> list[int]:
    """Column per row with the largest total; -1 where a row stays free.

    Zero cells are never assigned. Among equally good assignments the first in row order
    wins, smaller columns first and free last: each cell's value is followed, as lower
    digits of one whole number, by the row's preference, so one exact optimum settles both.
    Rows enter one by one along the cheapest chain of moves (Hungarian method).
    """
    rows, columns = len(matrix), len(matrix[0]) if matrix else 0
    unit = (columns + 1) ** rows
    # Each row also has the choice of the columns past the last: they stand for "free".
    cost = [
        [-v * unit - (columns - c) * (columns + 1) ** (rows - 1 - r) for c, v in enumerate(line)] + [0] * rows
        for r, line in enumerate(matrix)]
    holder: dict[int, int] = {}
    of_row, of_column = [0] * rows, [0] * (columns + rows)
    for new in range(rows):
        nearest: dict[int, tuple[int, int | None]] = {}
        done: dict[int, int] = {}
        row, via, walked = new, None, 0
        while True:
            for c, price in enumerate(cost[row]):
                length = walked + price - of_row[row] - of_column[c]
                if c not in done and (c not in nearest or length < nearest[c][0]):
                    nearest[c] = (length, via)
            via = min((c for c in nearest if c not in done), key=lambda c: nearest[c][0])
            walked = done[via] = nearest[via][0]
            if via not in holder:
                break
            row = holder[via]
        of_row[new] += walked
        for c, length in done.items():
            if c in holder:
                of_row[holder[c]] += walked - length
            of_column[c] -= walked - length
        while via is not None:
            before = nearest[via][1]
            holder[via] = new if before is None else holder[before]
            via = before
    chosen = [-1] * rows
    for c, r in holder.items():
        if c < columns and matrix[r][c] > 0:
            chosen[r] = c
    return chosen


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def assign_rows(matrices: pd.Series) -> pd.Series:
    return pd.Series([best_assignment([list(map(int, r)) for r in m]) for m in matrices])

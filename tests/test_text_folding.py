"""Folding in the JVM against Python's, and what is left for Python workers."""

import re
import time
import unicodedata

from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx


def test_folding_equals_python(spark):
    plain = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{tx.PLAIN}]", c)]
    texts = [f"A{c}b {c}" for c in plain] + ["".join(plain), "", "STRASSE Straße ẞ", "ﬁn ①", "e\u0301 É", "İI ſ Σς", "a\u0085", "a\u2028", "日本 ﾊﾝ", "𝐀😀", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", tx.fold(F.col("t")).alias("f"))
    want = {n: None if t is None else unicodedata.normalize("NFKC", t).casefold() for n, t in enumerate(texts)}
    assert {r.n: r.f for r in rows.collect()} == want and len(plain) > 190


def test_plain_latin_text_stays_in_the_jvm(spark):
    texts = spark.createDataFrame([("Café – Größe “x”",), ("ascii",), ("Ωmega",), (None,)], "t string")
    assert texts.filter(F.col("t").rlike(f"[^{tx.PLAIN}]")).collect() == [("Ωmega",)]


def test_kinds_of_change(spark):
    pairs = [(["not", "7", "x"], ["7", "x"]), (["may", "go"], ["may", "stay"]), (["friday"], ["monday"]), (["7", "8"], ["8", "7"]), ([], [])]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    flags = tx.safety_flags(F.col("a"), F.col("b"))
    got = [tuple(r) for r in rows.select(*[flags[f"{k}_changes"] for k in ("number", "negation", "date_time", "modality")]).collect()]
    assert got == [(False, True, False, False), (False,) * 4, (False, False, True, False), (True, False, False, False), (False,) * 4]


def test_words_are_put_together_in_one_walk(spark):
    def joined(tokens):
        out, before = "", " "
        for t in tokens:
            out += "" if t is None else t if before is not None and before[-1:].isspace() or t[:1].isspace() else f" {t}"
            before = t
        return out

    cases = [["a", " b", "c ", "d", "", "e\n", "f", "\tg"], ["", "x"], [" ", "x"], ["x"], [], ["a", None, "b", None, " c"], [None, "a"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, t array<string>").select("n", tx.render_words(F.col("t")).alias("r"))
    assert {r.n: r.r for r in rows.collect()} == {n: joined(c) for n, c in enumerate(cases)}
    # An array made by an expression is made once, not once for every word.
    start = time.time()
    many = spark.range(1).select(tx.render_words(F.array_sort(F.transform(F.sequence(F.col("id"), F.lit(20_000)), lambda i: F.format_string("%06d", i)))).alias("r"))
    assert many.first().r == " ".join(f"{i:06d}" for i in range(20_001)) and time.time() - start < 60

"""Verdicts on edits look at the words that a span touches only, and miss nothing by that."""

import random

from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import edits as ed
from dialogue_lake.operators import terms as tm


def test_the_touched_words_decide_as_the_whole_text_does(spark):
    rng = random.Random(6)
    pieces = ["not", "may", "7", "3.5%", "$", "alpha", "be'ta", "ﬁve", "é", "10:30", "n't", "no", "0", "a-7", " ", "\n", "ß", "̈", ".", "-"]
    rows = []
    for i in range(1500):
        text = "".join(rng.choice(pieces) + rng.choice(["", "", " ", " ", "  "]) for _ in range(rng.randint(1, 9)))
        a = rng.randint(0, len(text))
        b = rng.randint(a, len(text))
        rows.append((i, text, a, b, text[a:b], rng.choice([*pieces, text[a:b], "alpha 7", ""])))
    df = spark.createDataFrame(rows, "id int, text string, char_start bigint, char_end bigint, observed string, replacement string").withColumns({
        **{c: F.lit("x") for c in ("match_type", "scope", "category", "domain")}, **{c: F.lit(1.0) for c in ("lexical", "phonetic", "semantic")},
        "candidate_names": F.array().cast("array<string>")})
    edited = F.concat(F.expr("substr(text, 1, char_start)"), "replacement", F.expr("substr(text, char_end + 1)"))
    changed = (tx.protected_signature(F.col("observed")) != tx.protected_signature(F.col("replacement"))) | (
        tx.protected_signature(F.col("text")) != tx.protected_signature(edited))
    shaped = F.length("replacement") > 160
    judged = ed.edit_verdicts(df)
    got = judged.select("id", F.coalesce(F.col("rejection") == "protected_meaning", F.lit(False)).alias("got"), (changed & ~shaped & ~F.col(
        "replacement").rlike(r"[\n\r\t]")).alias("want")).collect()
    assert [r.id for r in got if r.got != r.want] == [] and 300 < sum(r.got for r in got) < 1300
    # A signature is made of the touched words, not of the text.
    plan = judged._jdf.queryExecution().analyzed().toString()
    assert "substring_index" in plan


def test_spans_longer_than_any_form_are_not_normalised(spark, monkeypatch):
    said = ["B&O", "Kuber-netes", "kubernetes rules", "a. b. c", "ｋubernetes", "node.js and kubernetes together", "..........................ai"]
    utterances = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "meeting_id bigint, utt_idx bigint, text string")
    entries = spark.createDataFrame([(f"e{i}", n, "global", 0.5, [], []) for i, n in enumerate(["b and o", "kubernetes", "abc", "ai"])],
                                    "entry_id string, canonical string, scope string, priority double, aliases array<string>, asr_aliases array<string>")
    spans, variants = tm.ngram_spans(utterances), tm.variant_table(entries)
    whole = tm.normal_forms(spans).join(variants.withColumnRenamed("variant_compact", "compact"), "compact").join(spans, "observed")
    looked = []
    real = tm.normal_forms
    monkeypatch.setattr(tm, "normal_forms", lambda s: looked.extend(r.observed for r in s.select("observed").collect()) or real(s))
    found = tm.exact_candidates(spans, variants)
    key = ["utt_idx", "char_start", "char_end", "entry_id"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect())) and found.count() >= 5
    assert "kubernetes rules" not in looked and "Kuber-netes" in looked

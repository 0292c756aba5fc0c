import itertools
import random

import regex

from dialogue_lake.functions import similarity as sim
from dialogue_lake.operators import metrics as me
from dialogue_lake.operators import terms as tm


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio_equals_dynamic_programme():
    random.seed(3)
    for _ in range(300):
        a, b = ("".join(random.choice("abcd ") for _ in range(random.randint(1, 90))) for _ in range(2))
        assert abs(sim.indel_ratio_of(a, b) - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-12


def test_metaphone_known_codes():
    known = {"thumb": "0M", "knight": "NT", "phone": "FN", "school": "SKL", "which": "WX", "judge": "JJ"}
    assert {w: sim.metaphone_of(w) for w in known} == known


def test_close_forms_lose_nothing_against_brute_force(spark):
    random.seed(5)
    words = ["".join(random.choice("aeiklmnrstß é") for _ in range(random.randint(1, 12))).strip() or "a" for _ in range(120)]
    words += ["banana", "bananas", "anbana", "aaaaaaaa", "aaaaaaa", "x", "xy", "don't stop"]
    spans = sorted({w[:2] + w[3:] for w in words} | set(words[:40]) | {f"{a} {b}" for a, b in zip(words, words[1:])})
    forms = sorted(set(words))
    expected = set()
    for a in spans:
        for b in forms:
            lexical = 0.75 * sim.indel_ratio_of(a, b) + 0.25 * sim.indel_ratio_of(sim.token_sorted(a), sim.token_sorted(b))
            code = sim.metaphone_of(a.replace(" ", ""))
            sound = sim.indel_ratio_of(code, sim.metaphone_of(b.replace(" ", ""))) if code else 0
            if lexical >= 0.78 or sound >= 0.88:
                expected.add((a, b))
    got = tm.close_forms(
        spark.createDataFrame([(s,) for s in spans], "normalized string"),
        spark.createDataFrame([(f,) for f in forms], "variant_normalized string")).collect()
    assert {(r.normalized, r.variant_normalized) for r in got} == expected and len(got) == len(expected)


def test_assignment_prefers_first_of_equal_optima():
    assert sim.best_assignment([[5, 5], [5, 5]]) == [0, 1]
    assert sim.best_assignment([[0, 0], [3, 0]]) == [-1, 0]
    assert sim.best_assignment([[4, 3], [4, 0], [0, 0]]) == [1, 0, -1]


def test_assignment_equals_trying_all():
    random.seed(9)
    for _ in range(150):
        rows, columns = random.randint(1, 4), random.randint(1, 4)
        table = [[random.randint(0, 3) for _ in range(columns)] for _ in range(rows)]
        free = columns
        tried = [p for p in itertools.product(range(columns + 1), repeat=rows) if len({c for c in p if c < free}) == sum(c < free for c in p)]
        total = lambda p: sum(table[r][c] for r, c in enumerate(p) if c < free)
        most = max(map(total, tried))
        first = min(p for p in tried if total(p) == most)
        assert sim.best_assignment(table) == [c if c < free and table[r][c] else -1 for r, c in enumerate(first)]
    many = [[5 if (r * 7) % 40 == c else 1 for c in range(40)] for r in range(40)]
    assert sim.best_assignment(many) == [(r * 7) % 40 for r in range(40)]
    assert sim.best_assignment([]) == []


def test_word_error_rate(spark):
    rows = [("a b c", "a x c d"), ("", ""), ("", "a"), ("It's fine.", "its FINE")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, reference string, hypothesis string")
    got = {r.id: (r.word_errors, r.wer) for r in me.word_error_rate(df).collect()}
    assert got == {0: (2, 0.666667), 1: (0, 0.0), 2: (1, None), 3: (0, 0.0)}


def test_greedy_spans(spark):
    rows = [(1, 0, 0, 8, "exact", 0.9, "x", 0, 1), (1, 0, 5, 12, "exact", 0.95, "y", 1, 2), (1, 0, 14, 18, "fuzzy", 0.99, "z", 3, 3),
            (1, 0, 13, 18, "exact", 0.5, "w", 3, 3)]
    df = spark.createDataFrame(rows, "meeting_id bigint, utt_idx bigint, char_start bigint, char_end bigint, match_type string, score double, "
                                     "entry_id string, first_word bigint, last_word bigint")
    assert sorted(r.entry_id for r in tm.choose_spans(df).collect()) == ["w", "y"]


def test_ngram_spans_equal_a_plain_scan(spark):
    rows = [(1, 0, "Yes. C++ and  node.js, don't"), (1, 1, ""), (1, 2, None), (1, 3, "..."), (2, 0, "one"), (2, 1, "é x\U0001F600y z\n# a"),
            (3, 0, "word " * 3000)]
    token = regex.compile(r"[\p{L}\p{N}_]+(?:[.'’+-][\p{L}\p{N}_]+)*(?:\+\+|#|\*)?")
    expected = []
    for meeting, utterance, text in rows:
        places = [m.span() for m in token.finditer(text or "")]
        expected += [(meeting, utterance, i, n, places[i][0], places[i + n - 1][1], text[places[i][0] : places[i + n - 1][1]])
                     for i in range(len(places)) for n in range(1, 5) if i + n <= len(places)]
    df = spark.createDataFrame(rows, "meeting_id bigint, utt_idx bigint, text string")
    got = [tuple(r) for r in tm.ngram_spans(df).collect()]
    assert sorted(got) == sorted(expected)


def test_candidate_pairs_by_kind_of_form(spark):
    said = ["banana", "bananna", "7b", "7c", "kubernetes", "kubernets", "ai", "al", "data", "banana"]
    spans = spark.createDataFrame([(1, i, 0, len(s), s) for i, s in enumerate(said)], "meeting_id bigint, utt_idx bigint, char_start bigint, char_end bigint, observed string")
    names = ["banana", "7b", "kubernetes", "ai", "data lake"]
    glossary = spark.createDataFrame([(f"t{i}", n, "global", 0.5, [], []) for i, n in enumerate(names)],
                                     "entry_id string, canonical string, scope string, priority double, aliases array<string>, asr_aliases array<string>")
    variants = tm.variant_table(glossary)
    got = sorted((r.utt_idx, r.canonical, r.is_exact) for r in tm.candidate_pairs(spans, variants).collect())
    # Digits and short forms only meet their equals, and a name never adds unsaid words.
    assert got == [(0, "banana", True), (1, "banana", False), (2, "7b", True), (4, "kubernetes", True), (5, "kubernetes", False), (6, "ai", True),
                   (9, "banana", True)]
    assert tm.candidate_pairs(spans.limit(0), variants).count() == 0 and tm.candidate_pairs(spans, variants.limit(0)).count() == 0

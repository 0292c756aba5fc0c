"""Cases in which rows were once lost, misordered or misjudged."""

from pyspark.sql import functions as F

from dialogue_lake.functions import text as tx
from dialogue_lake.operators import audit, claims, edits, graph
from dialogue_lake.operators import terms as tm
from dialogue_lake.plans import catalog
from dialogue_lake.plans.views import Views


def test_budget_keeps_every_request(spark):
    rows = [(1, p, n) for n, p in enumerate(["a", "a", "b", "odd", None, "a", "b", "a", "b"])]
    found = audit.budget_rank(spark.createDataFrame(rows, "meeting_id bigint, purpose string, request_no bigint"), {"a": 3, "b": 2}, 4).collect()
    assert len(found) == len(rows)
    by = {r.request_no: (r.purpose_no, r.call_no, r.within_budget, r.reason) for r in found}
    assert by == {
        0: (1, 1, True, None), 1: (2, 2, True, None), 2: (1, 3, True, None), 3: (1, None, False, "unknown_purpose"),
        4: (1, None, False, "unknown_purpose"), 5: (3, 4, True, None), 6: (2, 5, False, "total_budget"),
        7: (4, None, False, "purpose_budget"), 8: (3, None, False, "purpose_budget")}


def test_ids_past_six_digits_stay_in_order(spark):
    rows = [(1, "decisions", "x", ["utt_1000000"], "k1"), (1, "decisions", "y", ["utt_1000001", "utt_999999"], "k2"), (1, "decisions", "z", [], "k3")]
    items = spark.createDataFrame(rows, "meeting_id bigint, section string, item_id string, evidence_ids array<string>, identity string")
    found = {r.item_id: (r.final_id, r.evidence_ids) for r in claims.finalize_items(items).collect()}
    assert found == {"z": ("dec_0001", []), "y": ("dec_0002", ["utt_999999", "utt_1000001"]), "x": ("dec_0003", ["utt_1000000"])}


def test_strict_json_looks_at_every_level(spark):
    cases = {
        '{"a": {"k": 1}, "k": 2}': True, '{"a": {"k": 1, "k": 2}}': False, '{"k": 1, "k": 2}': False, '{"a": NaN}': False,
        '{"a": {"b": NaN}}': False, '{"a": "x {y}"}': True, '{"a": 1': False, "[1]": False, '{"a": [{"k": 1}, {"k": 2}]}': True}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "doc string")
    found = {r.doc: r.ok for r in df.select("doc", tx.strict_json(F.col("doc")).alias("ok")).collect()}
    assert found == {**cases, None: False}


def test_ambiguous_marks_are_compared_as_names_are(spark):
    rows = [("e1", "C-x", "tool", "global", None, ["C-x"], ["C-x"]), ("e2", "cx", "tool", "global", None, ["c x"], ["C X"]),
            ("e3", "Qy", "tool", "global", None, ["Qy"], ["qy"]), ("e4", "q-y", "tool", "global", None, ["q-y"], [])]
    df = spark.createDataFrame(rows, "entry_id string, canonical string, category string, scope string, sense string, variants array<string>, ambiguous array<string>")
    found = {(r.entry_id, r.rule) for r in tm.glossary_violations(df).collect()}
    assert found == {("e3", "unmarked_collision"), ("e4", "unmarked_collision")}


def test_several_chunks_make_several_requests(spark):
    rows = [(1, i, f"utt_{i:06d}", f"s{i % 2}", "w" * 100) for i in range(30)]
    said = spark.createDataFrame(rows, "meeting_id bigint, utt_idx bigint, utterance_id string, speaker_id string, text string")
    chunks = claims.build_chunks(said, max_chars=2200)
    spans = sorted((r.first_utt, r.last_utt) for r in chunks.collect())
    # A turn takes 312 characters of a request with its blank, and what is around them 123.
    assert spans[0] == (0, 5) and spans[1] == (4, 9) and spans[-1][1] == 29
    asked = audit.extraction_requests(chunks, said).collect()
    assert sorted(r.n_utterances for r in asked) == sorted(b - a + 1 for a, b in spans)


def test_original_is_supported_outside_ascii(spark):
    row = [("STRASSE", "Gasse", "die STRASSE hier", 4, 11, "fuzzy", "project", "place", "technology", 1.0, 1.0, 1.0, "Straße")]
    df = spark.createDataFrame(row, "observed string, replacement string, text string, char_start bigint, char_end bigint, match_type string, scope string, "
                                    "category string, domain string, lexical double, phonetic double, semantic double, name string")
    df = df.withColumn("candidate_names", F.array(tx.comparable(F.col("name"))))
    assert edits.edit_verdicts(df).first().rejection == "original_supported"


def test_pairs_past_the_budget_stay_and_join_threads(spark):
    rows = [(1, f"evt_{i:06d}", f"topic{i}", [f"u{i}"], i * 1000, i * 1000 + 500, i) for i in range(150)]
    events = spark.createDataFrame(rows, "meeting_id bigint, event_id string, text string, evidence_ids array<string>, start_ms bigint, end_ms bigint, utt_idx bigint")
    numbered = graph.number_events(events)
    pairs, counts = graph.relation_candidates(numbered)
    found = sorted((r.pair_no, r.src_n, r.dst_n, r.within_budget) for r in pairs.collect())
    assert found == [(i, i, i + 1, i <= 100) for i in range(1, 150)] and counts.first().pairs == 149
    assert {r.issue_id for r in graph.issue_threads(numbered, pairs).collect()} == {"issue_0001"}
    assert pairs.filter("within_budget").count() == 100


def test_utterances_past_the_budget_stay(spark):
    said = spark.createDataFrame([(1, i, "" if i == 3 else "x") for i in range(90)] + [(2, 0, "y")], "meeting_id bigint, utt_idx bigint, text string")
    ranked, total = audit.event_candidates(said)
    kept = sorted((r.utt_idx, r.candidate_no, r.within_budget) for r in ranked.filter("meeting_id = 1").collect())
    assert kept == [(i, i + (i < 3), i + (i < 3) <= 80) for i in range(90) if i != 3]
    assert {r.meeting_id: r.truncated for r in total.collect()} == {1: True, 2: False}


def test_terms_past_the_budget_stay(spark):
    docs = spark.createDataFrame([("a", " ".join(f"part-{i}" for i in range(300)))], "source_id string, text string")
    known = spark.createDataFrame([("unseen",)], "canonical string")
    found = tm.extract_terms(docs, known).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 301)) and sum(r.within_budget for r in found) == 256


def test_accented_words_of_both_tables_are_coded_whole(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "Étion nährung")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "garçon"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.token: r.code for r in catalog.QUERIES["b08_phonetic_code"](Views(spark, str(tmp_path))).collect()}
    assert found == {"étion": "EXN", "nährung": "NRNK", "garçon": "KRKN"}

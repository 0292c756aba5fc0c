"""Rows of one category of the review queue do not compute the others."""

import __spark_entry__ as entry
from dialogue_lake.operators import review
from dialogue_lake.plans import catalog_reports
from dialogue_lake.plans.views import Views


def test_a_filtered_queue_computes_its_own_part(spark, monkeypatch):
    whole = catalog_reports.review(Views(spark, entry.SMOKE)).filter("category = 'Semantic'")
    want = sorted(tuple(r) for r in whole.collect())

    def unasked(*_):
        raise AssertionError("another category was computed")

    monkeypatch.setattr(catalog_reports, "utterance_reliability", unasked)
    monkeypatch.setattr(catalog_reports, "coverage_result", unasked)
    part = catalog_reports.review(Views(spark, entry.SMOKE), "Semantic")
    assert sorted(tuple(r) for r in part.collect()) == want and want
    assert entry.queries()["c20_review_filter"](spark, entry.SMOKE).count() == len(want)


def test_parts_keep_their_rank(spark):
    utterances = spark.createDataFrame([(1, "u", 0, 5)], "meeting_id bigint, utterance_id string, start_ms bigint, end_ms bigint")
    rows = spark.createDataFrame([(1, "r", "t", "u")], "meeting_id bigint, record_id string, title string, utterance_id string")
    found = review.review_queue(utterances, {"Evidence": None, "Speaker": rows}).collect()
    assert [(r.category_rank, r.category, r.start_ms) for r in found] == [(2, "Speaker", 0)]

from dialogue_lake.operators import attribution as at

TURNS = "meeting_id bigint, turn_id string, speaker_id string, start_ms bigint, end_ms bigint"
WORDS = "meeting_id bigint, seg_idx bigint, segment_id string, word_index bigint, start_ms bigint, end_ms bigint, text string"


def attributed(spark, turns, words):
    t = spark.createDataFrame([(1, f"t{i}", *x) for i, x in enumerate(turns)], TURNS)
    w = spark.createDataFrame([(1, 0, "s", i, *x, f"w{i}") for i, x in enumerate(words)], WORDS)
    rows = at.attribute_words(w, t).collect()
    return [(r.speaker_id, r.method, r.overlap_fraction) for r in sorted(rows, key=lambda r: r.word_index)]


def test_methods_ties_and_borders(spark):
    turns = [("b", 0, 1000), ("a", 1000, 2000)]
    words = [(100, 400), (900, 1100), (1000, 1000), (2050, 2090), (2150, 2190), (2201, 2300), (2000, 2000)]
    assert attributed(spark, turns, words) == [
        ("b", "overlap", 1.0), ("b", "overlap", 0.5), ("a", "overlap", None), ("a", "tolerance", 0.0),
        ("a", "nearest", 0.0), (None, "unknown", 0.0), ("a", "tolerance", None)]


def test_sum_over_turns_of_one_speaker_wins(spark):
    turns = [("a", 0, 100), ("b", 100, 280), ("a", 280, 400)]
    assert attributed(spark, turns, [(0, 400)]) == [("a", "overlap", 0.55)]


def test_gap_uses_previous_end_and_unknown_speakers_group(spark):
    rows = [
        (1, 0, "s", 0, 0, 300, "one", "a", False), (1, 0, "s", 1, 1300, 1400, " two", "a", False),
        (1, 0, "s", 2, 2401, 2500, "three", "a", True), (1, 0, "s", 3, 2500, 2600, "x", None, False),
        (1, 0, "s", 4, 2600, 2700, "y", None, False)]
    words = spark.createDataFrame(rows, WORDS + ", speaker_id string, overlap_present boolean")
    got = sorted(at.assemble_utterances(words).collect(), key=lambda r: r.utterance_no)
    assert [(r.text, r.speaker_id, r.overlap_present) for r in got] == [
        ("one two", "a", False), ("three", "a", True), ("x y", None, False)]


def test_word_to_segment_never_goes_back(spark):
    words = spark.createDataFrame([(1, 0, 0, 900, 1300), (1, 0, 1, 950, 1000), (1, 0, 2, 9000, 9100)],
                                  "meeting_id bigint, chunk bigint, word_no bigint, start_ms bigint, end_ms bigint")
    segments = spark.createDataFrame([(1, 0, 0, 0, 1000), (1, 0, 1, 1000, 2000)],
                                     "meeting_id bigint, chunk bigint, seg_idx bigint, start_ms bigint, end_ms bigint")
    got = {r.word_no: (r.seg_idx, r.compatible) for r in at.words_to_segments(words, segments).collect()}
    assert got[0] == (1, True) and got[1] == (1, True) and got[2][1] is False

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, gaps, joins, ordered, quality


def classified(words, ms, before="x", **advice):
    df = ordered.gap_rows(words({"p": [(before, 0, 1), ("y", 1 + ms / 1000, 3)]}))
    for k, v in advice.items():
        df = df.withColumn(k, F.lit(v))
    return gaps.classify_gaps(df).first()


@pytest.mark.parametrize("ms, kind", [(49, "micro"), (51, "short"), (151, "medium"), (401, "natural"), (601, "sentence")])
def test_types(words, ms, kind):
    assert classified(words, ms).gap_type == kind


@pytest.mark.parametrize("ms, before, action, confidence", [
    (300, "x", "review", 0.5), (100, "de", "fill", 0.85), (100, "x", "fill", 0.75), (20, "x", "fill", 0.95), (700, "x", "keep", 0.95), (450, "x.", "keep", 0.85), (450, "x", "review", 0.6),
    (300, "x.", "keep", 0.8), (300, "de", "fill", 0.8), (100, "x!", "keep", 0.7), (-100, "de", "fill", 0.99),
])
def test_actions(words, ms, before, action, confidence):
    g = classified(words, ms, before)
    assert (g.action, g.confidence, g.needs_expansion) == (action, confidence, ms <= 0)


def test_advice(words):
    assert classified(words, 300, recommendation="keep", advice_confidence=0.9).confidence == 0.9
    assert classified(words, 300, recommendation="fill", advice_confidence=0.7).action == "fill"
    assert classified(words, 300, recommendation="analyze", advice_confidence=0.95).action == "review"
    # advice outranks punctuation
    assert classified(words, 100, "x.", has_pitch_reset=False).action == "fill"


def test_counts_and_events(words):
    rows = ordered.gap_rows(words({"p": [("a.", 0, 1), ("b", 1.7, 2), ("c", 2.02, 3), ("d", 2.9, 4)]}))
    c = gaps.classify_gaps(rows)
    assert {(r.gap_type, r.n, r.kept, r.filled) for r in gaps.type_counts(c).collect()} == {("sentence", 1, 1, 0), ("micro", 2, 0, 2)}
    assert gaps.summary_map(gaps.type_counts(c)).first().by_type["micro"].n == 2
    a = gaps.action_counts(c).first()
    assert (a.total, a.kept, a.filled, a.review) == (3, 1, 2, 0)
    p = gaps.heuristic_prosody(rows)
    assert p.count() == 2
    assert {(r.event_type, r.confidence) for r in gaps.prosody_events(p).collect()} == {("pitch_reset", 0.7), ("sentence_end", 0.8)}
    matched = joins.match_advice(rows, p)
    assert {(r.gap_index, r.pg_idx) for r in matched.collect()} == {(0, 0), (1, 1), (2, None)}
    q = quality.quality(words({"p": [("a.", 0, 1), ("b", 1.7, 2), ("c", 2.02, 3), ("d", 2.9, 4)]}), c, p).first()
    assert (q.word_count, q.gaps_preserved, q.gaps_filled, q.prosody_preserved_score) == (4, 1, 2, 0.5)


def issue_set(df):
    return {(r.word_idx, r.type, r.severity) for r in df.collect()}


def test_issues(words, spark):
    df = words({"p": [("coração", 0, 0.048), ("b", 0.04, 0.3), ("c", 0.9, 2.6), ("d.", 2.7, 2.8), ("e", 3.5, 4.0)]})
    durations = spark.createDataFrame([("p", 10.0)], "page_id string, duration double")
    assert issue_set(checks.find_issues(df, durations)) == {
        (0, "too_short", "error"), (0, "syllable_mismatch", "error"), (1, "overlap", "error"), (2, "large_gap", "warning"), (2, "too_long", "warning"), (4, "round_timestamps", "warning"), (4, "alignment_drift", "warning"),
    }
    counts = checks.issue_counts(checks.find_issues(df)).where("type = 'too_short'").first()
    assert (counts.n, counts.errors, counts.warnings) == (1, 1, 0)


def test_untimed_titles_are_skipped(words):
    df = words({"p": [("t", 0, 0), ("a", 5, 5.3)]}).withColumn("is_title", F.col("word_idx") == 0)
    assert issue_set(checks.find_issues(df)) == set()


def test_cross_validation(words):
    first = words({"p": [(w, i, i + 0.5) for i, w in enumerate("abcdefghij")]})
    second = words({"p": [(w, i + 0.03, i + 0.53) for i, w in enumerate("abcdefghij")]})
    v = checks.cross_validate(joins.nearest_position_join(first, second)).orderBy("word_idx").collect()
    assert all(r.matched and r.final_confidence == 0.98 for r in v) and v[2].final_start == pytest.approx(2.015)
    far = words({"p": [("z", i, i + 1) for i in range(9)] + [("a", 9, 10)]})
    r = joins.nearest_position_join(first, far).where("word_idx = 0").first()
    assert r.second_idx is None
    m = checks.mean_deviation(checks.cross_validate(joins.nearest_position_join(first, far))).first()
    assert (m.matched, m.unmatched, m.average_deviation_ms) == (0, 10, 0.0)


def test_nearest_ties_and_sharing(words):
    first = words({"p": [("x", 0, 1), ("a", 1, 2), ("x", 2, 3), ("x", 3, 4)]})
    second = words({"p": [("q", 0, 1), ("x", 1, 2), ("q", 2, 3), ("x", 3, 4), ("q", 4, 5)] + [("q", k, k + 1) for k in range(5, 12)]})
    got = {r.word_idx: r.second_idx for r in joins.nearest_position_join(first, second).collect()}
    assert got == {0: 1, 1: None, 2: 1, 3: 3}


def test_corrections(words, spark):
    df = words({"p": [("Um", 0, 1), ("dois", 1, 2)]})
    schema = "page_id string, seq int, word_index int, word string, corrected_start double, corrected_end double, confidence double"
    c = spark.createDataFrame([("p", 0, 0, "UM!", 0.1, 0.9, 0.8), ("p", 1, 0, "um", 0.2, 0.8, 0.7), ("p", 2, 1, "tres", 5.0, 6.0, 0.9), ("p", 3, 1, "dois", 5.0, 6.0, 0.5)], schema)
    assert [(r.start, r.end, r.corrected) for r in joins.apply_corrections(df, c).orderBy("word_idx").collect()] == [(0.2, 0.8, True), (1.0, 2.0, False)]
    more = spark.createDataFrame([("p", 0, 0, "um", 0.3, 0.7, 0.85), ("p", 1, 9, "x", 1.0, 2.0, 0.85)], schema)
    merged = {(r.word_index, r.corrected_start, r.replaced) for r in joins.merge_corrections(c, more).collect()}
    assert merged == {(0, 0.3, True), (0, 0.2, False), (1, 5.0, False), (9, 1.0, True)} and joins.merge_corrections(c, more).count() == 5

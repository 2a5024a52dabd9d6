"""Queries on documents' words deal the texts out by page once; no window or join deals words again."""

import os

import pytest

from tessera.operators import align, checks, gaps, joins, ordered, quality
from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def dealt_again(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    return "ENSURE_REQUIREMENTS" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", """
    mean_deviation nearest_match prosody_band_match validated_merge advice_words cross_validate gap_classify_advised site_pages html_pages preserved_score quality_rollup apply_corrections
""".split())
def test_dealt_once(spark, name):
    assert not dealt_again(catalog.queries()[name](spark, SF))


def test_nearest_keeps_each_row(spark):
    """Rows with equal numbers, blank words and words without a page have one result each; without a second word, none."""
    schema = "page_id string, word_idx int, word string, start double, end double"
    first = spark.createDataFrame([("p", 0, "a", 0.0, 1.0), ("p", 0, "a", 5.0, 6.0), ("p", 1, "--", 1.0, 2.0), (None, 0, "a", 0.0, 1.0), ("q", 0, "a", 0.0, 1.0)], schema)
    second = spark.createDataFrame([("p", 0, "A.", 0.5, 1.5), ("p", 1, "..", 1.0, 2.0), (None, 0, "a", 0.0, 1.0)], schema)
    got = sorted((r.page_id or "", r.word_idx, r.start, r.second_idx, r.second_start) for r in joins.nearest_position_join(first, second, reach=1.0).collect())
    assert got == [("", 0, 0.0, None, None), ("p", 0, 0.0, 0, 0.5), ("p", 0, 5.0, 0, 0.5), ("p", 1, 1.0, None, None), ("q", 0, 0.0, None, None)]


def test_near_is_less_than_the_width(spark):
    left = spark.createDataFrame([("p", 1.0), ("p", None), (None, 1.0), ("q", 1.0)], "page_id string, at double")
    right = spark.createDataFrame([("p", 1.25), ("p", 1.125), ("p", 0.875), ("p", 0.75), ("p", None), (None, 1.0)], "page_id string, t double")
    got = {(r.page_id, r.at): sorted(x.t for x in r.near) for r in joins.near_rows(left, right, "at", "t", 0.25, "near").collect()}
    assert got == {("p", 1.0): [0.875, 1.125], ("p", None): [], (None, 1.0): [], ("q", 1.0): []}


def test_first_near_advice(spark, words):
    """Near in both ends comes first, then the smaller number; of several words that end near, the first."""
    rows = ordered.gap_rows(words({"p": [("a", 0, 1), ("b", 2, 3), ("c", 3, 4)]})).where("gap_index = 0")
    told = spark.createDataFrame([("p", k, "x", "y", 1.0 + s, e, 1000.0, False, False, False, "keep", 0.9) for k, s, e in ((0, 0.05, 9.0), (1, 0.02, 2.05), (2, 0.01, 2.0))],
        "page_id string, pg_idx int, word_before string, word_after string, gap_start double, gap_end double, duration_ms double, has_breath boolean, has_pitch_reset boolean, is_sentence_boundary boolean, recommendation string, advice_confidence double")
    assert [r.pg_idx for r in joins.match_advice(rows, told).collect()] == [1]
    own = joins.advice_words(told.drop("word_before", "word_after").where("pg_idx = 0"), words({"p": [("a", 0, 1), ("b", 0.5, 1.01), ("c", 3, 4)]})).first()
    assert (own.word_before, own.word_after) == ("a", "b")
    assert quality.preserved_score(told, gaps.classify_gaps(rows).withColumnRenamed("action", "_a").selectExpr("*", "'keep' AS action")).first().prosody_preserved_score == 1.0


def test_merge_by_page(spark, words):
    df = words({"p": [("a", 0, 1), ("b", 1, 2)], "q": [("a", 0, 1)]}, confidence=0.5)
    v = checks.cross_validate(joins.nearest_position_join(df, words({"p": [("a", 0.02, 1.02), ("b", 1.04, 2.04)]})))
    got = sorted((r.page_id, r.word_idx, round(r.start, 3), r.confidence) for r in joins.merge_validated(df, v).collect())
    assert got == [("p", 0, 0.01, 0.98), ("p", 1, 1.02, 0.98), ("q", 0, 0.0, 0.5)]


def test_aligned_words_stay_dealt(spark):
    """Tables that are dealt by page give aligned words without a join or another exchange."""
    ref = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b")], "page_id string, ref_idx int, token string").repartition(3, "page_id")
    heard = spark.createDataFrame([("p", 4, "a", 1.0, 2.0, 0.9)], "page_id string, word_idx int, word string, start double, end double, confidence double").repartition(3, "page_id")
    steps = spark.createDataFrame([("p", 0, 0, 4, "match"), ("p", 1, 1, None, "deletion"), ("p", 2, None, 7, "insertion")], align.ALIGNMENT).repartition(3, "page_id")
    out = align.aligned_words(steps, ref, heard)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not dealt_again(out)
    assert sorted((r.ref_idx, r.word, r.start, r.confidence, r.status) for r in out.collect()) == [(0, "a", 1.0, 0.9, "matched"), (1, "b", 0.0, 0.3, "needs_verification")]

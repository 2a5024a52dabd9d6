import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered


def times(df):
    out = {}
    for r in df.orderBy("page_id", "word_idx").collect():
        out.setdefault(r["page_id"], []).append((round(r["start"], 9), round(r["end"], 9)))
    return out


def test_gaps_and_post_pause(words):
    df = words({"a": [("x", 0, 1), ("y", 1.1, 2), ("z", 2.6, 3)], "b": [("x", 0, 1)]})
    assert [(r.gap_index, r.word_before, r.word_after, round(r.duration_ms, 6)) for r in ordered.gap_rows(df).orderBy("gap_index").collect()] == [(0, "x", "y", 100.0), (1, "y", "z", 600.0)]
    assert [r.word for r in ordered.post_pause_words(df).collect()] == ["z"]


@pytest.mark.parametrize("page, want", [
    ([("x", 0, 1), ("y", 0.9, 2)], [(0, 1), (1.01, 2)]),
    ([("x", 0, 1), ("y", 0.95, 1.05)], [(0, 0.94), (0.95, 1.05)]),
    ([("x", 0.96, 1), ("y", 0.95, 1.05)], [(0.96, 0.94), (0.95, 1.05)]),
])
def test_overlap_cases(words, page, want):
    assert times(ordered.repair_overlaps(words({"p": page})))["p"] == [tuple(map(float, x)) for x in want]


def test_minimum_duration(words):
    got = times(ordered.minimum_duration(words({"p": [("x", 0, 0.1), ("y", 0.15, 0.5), ("z", 1, 1.05)]})))["p"]
    assert got == [(0.0, 0.14), (0.15, 0.5), (1.0, 1.2)]


@pytest.mark.parametrize("page, want", [([("x", 0, 1), ("y", 1.1, 2)], [(0, 1.05), (1.05, 2)]), ([("x", 0, 0.05), ("y", 0.13, 1)], [(0, 0.05), (0.13, 1)])])
def test_midpoints(words, page, want):
    df = words({"p": page}).withColumn("fill", F.lit(True))
    assert times(ordered.fill_midpoints(df))["p"] == [tuple(map(float, x)) for x in want]


def slow_interpolation(rows, total, keep=0.15, guess=0.3):
    """As the blueprint words it: each missing word spreads all of its run that is left, again and again."""
    rows = [dict(r) for r in rows]
    for i, r in enumerate(rows):
        if not r["missing"]:
            continue
        before = next((rows[j]["end"] for j in range(i - 1, -1, -1) if rows[j]["end"] > 0), 0.0)
        after = next((rows[j]["start"] for j in range(i + 1, len(rows)) if rows[j]["start"] > 0), total)
        run = [r]
        for x in rows[i + 1 :]:
            if not x["missing"]:
                break
            run.append(x)
        free = after - before if after - before > 0 else guess * len(run)
        rate, at = free / sum(x["syl"] for x in run), before
        for x in run:
            x["start"], x["end"] = at, at + max(keep, x["syl"] * rate)
            at = x["end"]
    return [(x["start"], x["end"]) for x in rows]


def test_interpolation(spark, words):
    df = words({"p": [("a", 0, 0)] * 3}).withColumns({"missing": F.lit(True), "syllables": F.lit(1), "duration": F.lit(3.0)})
    assert times(ordered.interpolate(df))["p"] == [(0.0, 1.0), (1.0, 1.5), (1.5, 3.0)]
    r, data, want = random.Random(3), [], {}
    for p in range(60):
        t, rows = 0.0, []
        for i in range(r.randint(1, 14)):
            missing = r.random() < 0.5
            start, end = (0.0, 0.0) if missing else (t + r.random() * 0.2, t + 0.3 + r.random())
            t = t if missing else end
            rows.append({"missing": missing, "start": start, "end": end, "syl": r.randint(1, 4)})
            data.append((f"{p:02}", i, "w", start, end, 1.0, missing, rows[-1]["syl"], 20.0))
        want[f"{p:02}"] = slow_interpolation(rows, 20.0)
    df = spark.createDataFrame(data, "page_id string, word_idx int, word string, start double, end double, confidence double, missing boolean, syllables int, duration double")
    got = times(ordered.interpolate(df))
    for p, rows in want.items():
        assert [x for pair in got[p] for x in pair] == pytest.approx([x for pair in rows for x in pair], abs=1e-8)


def test_neighbours_and_runs(words):
    df = words({"p": [("a", 0, 0), ("b", 1, 2), ("c", 0, 0), ("d", 0, 0), ("e", 3, 4)]})
    got = ordered.runs(ordered.timed_neighbours(df, F.lit(9.0)), F.col("end") == 0).orderBy("word_idx").collect()
    assert [(r.prev_end, r.next_start) for r in got] == [(0.0, 1.0), (0.0, 3.0), (2.0, 3.0), (2.0, 3.0), (2.0, 9.0)]
    assert got[2].run_id == got[3].run_id != got[0].run_id and got[1].run_id is None


def test_empty(words):
    df = words({})
    assert ordered.repair_overlaps(df).count() == ordered.gap_rows(df).count() == ordered.minimum_duration(df).count() == 0

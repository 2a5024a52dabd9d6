import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, ordered, walks

WORDS = "page_id string, word_idx int, word string, line_break_after boolean"
REF = "page_id string, ref_idx int, token string, is_line_end boolean"


def clean(w):
    return re.sub(r"[^\w]", "", (w or "").lower())


def slow_walk(words, ref):
    """One word after another; (line_break_after, ref_idx) of each."""
    out, at = [], 0
    for w, old in words:
        hit = next((k for k in range(5) if at + k < len(ref) and clean(ref[at + k][0]) == clean(w)), None)
        out.append((ref[at + hit][1], at + hit) if hit is not None else (bool(old), None))
        at += 1 if hit is None else hit + 1
    return out


@pytest.mark.parametrize("part", [256, 3])
def test_pointer_walk(spark, monkeypatch, part):
    monkeypatch.setattr(folds, "PART", part)
    r = random.Random(part)
    pages = {}
    for k in range(30):
        ref = [(r.choice(["Olá,", "mundo", "a", "e", "é.", "--", "casa"]), r.random() < 0.2) for _ in range(r.randint(0, 30))]
        heard = [(w.upper(), r.choice([None, True, False])) for w, _ in ref if r.random() > 0.15]
        for _ in range(r.randint(0, 6)):
            heard.insert(r.randint(0, len(heard)), (r.choice(["xx", "a", "...", ""]), None))
        pages[f"p{k}"] = (heard, ref)
    pages["long"] = ([("a", None)] * 900, [("a", i % 7 == 6) for i in range(890)])
    words = spark.createDataFrame([(p, i, w, old) for p, (h, _) in pages.items() for i, (w, old) in enumerate(h)], WORDS).repartition(3)
    ref = spark.createDataFrame([(p, i, t, e) for p, (_, x) in pages.items() for i, (t, e) in enumerate(x)], REF).repartition(3)
    got = {(x.page_id, x.word_idx): (x.line_break_after, x.ref_idx) for x in walks.walk_line_breaks(words, ref).collect()}
    assert got == {(p, i): v for p, (h, x) in pages.items() for i, v in enumerate(slow_walk(h, x))}


def test_prompts(spark):
    r = random.Random(2)
    rows = [(f"p{k}", i, "w" * r.randint(1, 30), i * 0.5, i * 0.5 + 0.25, i < 2) for k in range(5) for i in range(r.randint(1, 120))]
    rows = [(*x[:3], 0.0, 0.0, True) if x[5] and x[0] == "p1" else x for x in rows]
    words = spark.createDataFrame(rows, "page_id string, word_idx int, word string, start double, end double, is_title boolean").repartition(3)
    found = walks.prompts(words, 40, F.length("word")).collect()
    want = {}
    for p, i, w, s, e, _ in rows:
        if (p, i) not in {("p1", 0), ("p1", 1)}:
            own = want.setdefault(p, [[0, []]])
            if own[-1][0] and own[-1][0] + len(w) > 40:
                own.append([0, []])
            own[-1][0] += len(w)
            own[-1][1].append(f"{i} {w} {s:.3f} {e:.3f} {(e - s) * 1000:.1f}")
    assert {(x.page_id, x.prompt): (x.cost, x.text) for x in found} == {(p, k): (c, "\n".join(t)) for p, parts in want.items() for k, (c, t) in enumerate(parts)}
    assert all(x.cost <= 40 and x.n_words == x.text.count("\n") + 1 for x in found)
    alone = walks.prompts(words.limit(1), 0, F.lit(9)).collect()
    assert [(x.prompt, x.n_words) for x in alone] == [(0, 1)]


def slow_fold(rows, step):
    start, end = [x[0] for x in rows], [x[1] for x in rows]
    step(start, end)
    return list(zip(start, end, strict=True))


def slow_repair(start, end):
    for i in range(len(start) - 1, 0, -1):
        gap = start[i] - end[i - 1]
        if gap < 0.01:
            need = 0.01 - gap
            if (end[i] - start[i]) - need >= 0.15:
                start[i] += need
            else:
                end[i - 1] = start[i] - 0.01


def slow_midpoints(fill):
    def step(start, end):
        for k in range(len(start) - 1):
            middle = (end[k] + start[k + 1]) / 2
            if fill[k] and middle - start[k] >= 0.15 and end[k + 1] - middle >= 0.15:
                end[k] = start[k + 1] = middle

    return step


def slow_interpolate(start, end, missing, weight, total):
    last, k, n = 0.0, 0, len(start)
    while k < n:
        if not missing[k]:
            last = end[k] if end[k] > 0 else last
            k += 1
            continue
        stop = next((j for j in range(k, n) if not missing[j]), n)
        after = next((start[j] for j in range(stop, n) if not missing[j] and start[j] > 0), total)
        left, at, rate = sum(weight[k:stop]), last, 0.0
        for j in range(k, stop):
            if j == k:
                room = after - at if after - at > 0 else 0.3 * (stop - k)
            elif j == stop - 1:
                room = after - at if after - at > 0 else 0.3
            else:
                room = max(0.15, weight[j] * rate)
            rate = room / left
            start[j], end[j], at = at, at + max(0.15, weight[j] * rate), at + max(0.15, weight[j] * rate)
            left -= weight[j]
        last, k = at, stop


def test_windows_and_scans_equal_folds(spark):
    """Overlap repair, midpoints and interpolation against loops over each page, with overlaps, ties and runs of all kinds."""
    r = random.Random(8)
    rows = []
    for p in range(40):
        t = 0.0
        for i in range(r.randint(1, 40)):
            t += r.choice([0.0, 0.05, 0.1, 0.3, 0.5])
            end = t + r.choice([0.05, 0.1, 0.155, 0.16, 0.2, 0.4, 0.9])
            gone = r.random() < 0.4
            quiet = r.random() < 0.1
            rows.append((f"p{p}", i, "w", 0.0 if quiet else t, 0.0 if quiet else end, 0.9, r.choice([True, True, False, None]), gone, r.randint(1, 4), 12.0))
            t = end if r.random() < 0.7 else t
    df = spark.createDataFrame(rows, "page_id string, word_idx int, word string, start double, end double, confidence double, fill boolean, missing boolean, syllables int, duration double").repartition(3)
    pages = {}
    for x in rows:
        pages.setdefault(x[0], []).append(x)
    got = lambda out: {(x.page_id, x.word_idx): (x.start, x.end) for x in out.collect()}
    want = lambda step: {(p, x[1]): v for p, own in pages.items() for x, v in zip(own, slow_fold([(y[3], y[4]) for y in own], lambda s, e: step(own, s, e)), strict=True)}
    assert got(ordered.repair_overlaps(df)) == want(lambda own, s, e: slow_repair(s, e))
    assert got(ordered.fill_midpoints(df)) == want(lambda own, s, e: slow_midpoints([x[6] for x in own])(s, e))
    filled = ordered.interpolate(df)
    assert filled.columns == df.columns and got(filled) == want(lambda own, s, e: slow_interpolate(s, e, [x[7] for x in own], [x[8] for x in own], 12.0))
    assert "Python" not in filled._jdf.queryExecution().executedPlan().toString()


def test_scan_of_nothing(spark):
    df = spark.sql("SELECT array() AS none, cast(null AS array<int>) AS gone, array(1, 2, 3) AS some")
    step = lambda s, x: F.struct((s["n"] + x).alias("n"))
    zero = F.struct(F.lit(0).alias("n"))
    row = df.select(folds.scan(F.col("none").cast("array<int>"), zero, step).alias("a"), folds.scan(F.col("gone"), zero, step).alias("b"), folds.scan(F.col("some"), zero, step).alias("c")).first()
    assert row.a == [] and row.b is None and [x.n for x in row.c] == [1, 3, 6]

import datetime
import random

import pytest

from tessera.operators import align, playback
from tessera.streaming.highlight import highlight_stream, pauses


def slow_moves(scores):
    """Cell by cell, as the rules say."""
    m, n = len(scores), len(scores[0])
    best = {(0, 0): 0}
    move = {(0, 0): None}
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                options = [best[i - 1, j - 1] + scores[i - 1][j - 1], best[i - 1, j] + (-1 if move[i - 1, j] == 2 else -4), best[i, j - 1] + (-1 if move[i, j - 1] == 3 else -4)]
                best[i, j] = max(options)
                move[i, j] = options.index(max(options)) + 1
            elif i or j:
                best[i, j], move[i, j] = -4 - (i + j - 1), 2 if i else 3
    return move


def slow_similarity(a, b):
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    x, y = align._sound(a), align._sound(b)
    return max(0.8 * len(set(a) & set(b)) / len(set(a) | set(b)), edits(a, b), 1.0 if x == y else edits(x, y))


def slow_steps(scores):
    move, i, j, out = slow_moves(scores), len(scores), len(scores[0]), []
    while i or j:
        out.append((i - 1 if move[i, j] != 3 else -1, j - 1 if move[i, j] != 2 else -1))
        i, j = i - (move[i, j] != 3), j - (move[i, j] != 2)
    return out[::-1]


@pytest.mark.parametrize("pairs", [1 << 18, 7])
def test_pair_scores(monkeypatch, pairs):
    monkeypatch.setattr(align, "PAIRS", pairs)
    r = random.Random(3)
    words = ["", "a", "hora", "ora", "chão", "xão", "casa", "caça", "passo", "paço", "queijo", "kejo", "abab", "ab", "h", "hh", "x" * 300, "x" * 299 + "y", "né", "ção"]
    words += ["".join(r.choice("abçhrsão") for _ in range(r.randint(1, 9))) for _ in range(60)]
    words += [w[:2] + r.choice("aeo") + w[3:] for w in words]
    words = list(dict.fromkeys(words))
    want = [[next((score for least, score in align.SCORES if slow_similarity(x, y) >= least), align.MISMATCH) for y in words[::-1]] for x in words]
    assert align.pair_scores(words, words[::-1]).tolist() == want


@pytest.mark.parametrize("moves", [1 << 26, 40, 1])
def test_moves_by_antidiagonals(monkeypatch, moves):
    """Whole pages at once, and strip by strip."""
    monkeypatch.setattr(align, "MOVES", moves)
    r = random.Random(1)
    for _ in range(80):
        ref, trans = [r.choice("aab bb ab ba c".split()) for _ in range(r.randint(1, 12))], [r.choice("aab bb ab ba c".split()) for _ in range(r.randint(1, 12))]
        scores = align.pair_scores(ref, trans).tolist()
        assert list(zip(*(x.tolist() for x in align.alignment(ref, trans)), strict=True)) == slow_steps(scores)


def test_large_page_in_little_memory(monkeypatch):
    """Memory is that of a strip and of pairs of distinct words, not of all pairs."""
    import tracemalloc

    monkeypatch.setattr(align, "MOVES", 1 << 18)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    ref = [r.choice(vocabulary) for _ in range(3000)]
    trans = [w for w in ref if r.random() > 0.05]
    tracemalloc.start()
    i, j = align.alignment(ref, trans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i[i >= 0]) == list(range(3000)) and sorted(j[j >= 0]) == list(range(len(trans))) and sum(ref[a] == trans[b] for a, b in zip(i, j, strict=True) if a >= 0 <= b) > 0.97 * len(trans)
    assert peak < 12e6


def test_align_udtf(spark):
    """The table function gives what align() gives, from SQL."""
    r = random.Random(5)
    pages = {f"p{k}": ([r.choice("o gato viu a lua azul".split()) for _ in range(r.randint(0, 12))], [r.choice("o gato vio a lua".split()) for _ in range(r.randint(0, 12))]) for k in range(20)}
    ref = spark.createDataFrame([(p, 2 * i, w) for p, (x, _) in pages.items() for i, w in enumerate(x)], "page_id string, ref_idx int, token string")
    heard = spark.createDataFrame([(p, 3 * i, w) for p, (_, y) in pages.items() for i, w in enumerate(y)], "page_id string, word_idx int, word string")
    align.register_align(spark)
    got = spark.sql("SELECT * FROM align_words(TABLE(SELECT * FROM {sides}) PARTITION BY page_id)", sides=align.sides(ref, heard).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, align.align(ref, heard).collect()), key=str)


def test_alignment_rules():
    assert align.align_words([], ["a", "b"]) == [(None, 0, "insertion"), (None, 1, "insertion")]
    assert align.align_words(["a"], []) == [(0, None, "deletion")]
    same = "o gato viu a lua".split()
    assert align.align_words(same, same) == [(i, i, "match") for i in range(5)]
    ops = align.align_words("o gato preto viu a lua".split(), "o gato viu a bela lua".split())
    assert [i for i, _, _ in ops if i is not None] == list(range(6)) and [j for _, j, _ in ops if j is not None] == list(range(6))
    assert (2, None, "deletion") in ops and (None, 4, "insertion") in ops


def test_align_table(spark):
    ref = spark.createDataFrame([("p", 0, "Olá,"), ("p", 1, "mundo"), ("q", 0, "só")], "page_id string, ref_idx int, token string")
    heard = spark.createDataFrame([("p", 0, "ola", 0.0, 1.0, 0.9), ("r", 0, "x", 0.0, 1.0, 0.9)], "page_id string, word_idx int, word string, start double, end double, confidence double")
    a = align.align(ref, heard)
    assert {(r.page_id, r.ref_idx, r.trans_idx, r.op) for r in a.collect()} == {("p", 0, 0, "match"), ("p", 1, None, "deletion"), ("q", 0, None, "deletion"), ("r", None, 0, "insertion")}
    w = {(r.page_id, r.word_idx): r for r in align.aligned_words(a, ref, heard).collect()}
    assert w["p", 0].word == "Olá," and w["p", 0].confidence == pytest.approx(0.9 * 2 / 3) and w["p", 1].confidence == 0.3


def slow_highlight(ticks):
    """(t, action, from, to) one tick after another."""
    current = previous = -1
    for t, now in ticks:
        if now == current:
            continue
        known = max(current, previous)
        if now >= 0 and known >= 0 and now > known + 1:
            yield t, "read", known + 1, now - 1
        if current >= 0:
            yield t, "read", current, current
        if now >= 0:
            yield t, "active", now, now
            if now < current:
                yield t, "clear", now + 1, current
        current, previous = now, current


def test_highlight(spark):
    r = random.Random(7)
    pages = {f"s{k}": [(i / 10, r.choice([-1, -1, 0, 1, 2, 3, 7, 8])) for i in range(r.randint(0, 60))] for k in range(12)}
    pages["fixed"] = [(0.0, 0), (0.1, 0), (0.2, -1), (0.3, 3), (0.4, 1)]
    df = spark.createDataFrame([(s, t, t, "tick", w) for s, x in pages.items() for t, w in x], "session_id string, at double, t double, kind string, word_idx int").repartition(3)
    got = sorted((x.session_id, x.t, x.action, x.from_idx, x.to_idx) for x in playback.player_changes(df).collect())
    assert got == sorted((s, *x) for s, ticks in pages.items() for x in slow_highlight(ticks))
    fixed = [(0.0, "active", 0, 0), (0.2, "read", 0, 0), (0.3, "read", 1, 2), (0.3, "active", 3, 3), (0.4, "read", 3, 3), (0.4, "active", 1, 1), (0.4, "clear", 2, 3)]
    assert [x[1:] for x in got if x[0] == "fixed"] == sorted(fixed)


def test_point_in_interval(spark, words):
    df = words({"p": [("a", 0, 1), ("b", 1, 2), ("c", 3, 4)]})
    ticks = spark.createDataFrame([("p", t) for t in (0.0, 0.99, 1.0, 2.5, 3.0, 4.0)], "page_id string, t double")
    from tessera.operators.joins import point_in_interval

    assert [r.word_idx for r in point_in_interval(ticks, df).orderBy("t").collect()] == [0, 0, 1, -1, 2, -1]


EVENTS = "session_id string, at timestamp, t double, kind string, word_idx int"


def player_events(r, sessions):
    """Ticks, plays from the start, ends, and pauses of a few minutes."""
    start, rows = datetime.datetime(2024, 1, 1), []
    for s in range(sessions):
        at = start + datetime.timedelta(seconds=r.randint(0, 30))
        for _ in range(r.randint(1, 40)):
            at += datetime.timedelta(milliseconds=r.choice([100, 250, 1000, 1000, 400_000]))
            kind = r.choice(["tick"] * 8 + ["play", "ended"])
            rows.append((f"s{s}", at, r.choice([0.0, 0.05, 0.5, 3.25]), kind, r.choice([-1, 0, 1, 2, 5, 6]) if kind == "tick" else None))
    return rows


def test_player_rules(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), 0.2, "tick", 0), ("a", at(1), 0.6, "tick", 1), ("a", at(2), 1.5, "ended", None), ("a", at(3), 0.05, "play", None), ("a", at(4), 0.3, "tick", 2), ("a", at(400), 0.4, "tick", 5)]
    got = sorted((x.at, x.action, x.from_idx, x.to_idx) for x in playback.player_changes(spark.createDataFrame(rows, EVENTS), 300).collect())
    assert got == sorted([(at(0), "active", 0, 0), (at(1), "read", 0, 0), (at(1), "active", 1, 1), (at(2), "read", 1, 1), (at(3), "clear", 0, 1), (at(4), "active", 2, 2), (at(4), "read", 2, 2), (at(400), "active", 5, 5), (at(400), "read", 5, 5)])


def test_stream_of_shuffled_batches_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(11)
    rows = sorted(player_events(r, 6), key=lambda x: x[1])
    # each event comes within the watermark of what came before it
    rows = [x for _, x in sorted(((x[1] + datetime.timedelta(seconds=r.uniform(0, 9)), x) for x in rows), key=lambda y: y[0])]
    end = rows[-1][1] + datetime.timedelta(days=1)
    folder = tmp_path / "in"
    folder.mkdir()
    read = spark.readStream.schema(EVENTS).parquet(str(folder))
    q = highlight_stream(read, "10 seconds", 300).writeStream.format("memory").queryName("lit").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k in range(0, len(rows) + 1, 25):
            spark.createDataFrame(rows[k : k + 25] or [("end", end, 0.0, "other", None)], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        for _ in range(2):
            spark.createDataFrame([("end", end, 0.0, "other", None)], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()
    own = lambda df: sorted((x.session_id, x.at, x.t, x.action, x.from_idx, x.to_idx) for x in df.collect())
    want = own(playback.player_changes(spark.createDataFrame(rows, EVENTS), 300))
    assert own(spark.table("lit")) == want and {x[3] for x in want} == {"active", "read", "clear"}


def test_pauses(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (1, TIMESTAMP_NTZ '2024-01-01 00:20:00'), (1, TIMESTAMP_NTZ '2024-01-01 02:00:00') AS t(user_id, ts)")
    assert sorted(r.n for r in pauses(df).collect()) == [1, 2]

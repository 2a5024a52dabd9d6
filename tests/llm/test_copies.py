"""The n-gram join, repeat removal, components and the pipeline, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, packed, quality, suffixes
from tessera.llm import components as components_module
from tessera.llm.components import components


def brute_links(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else (t or ""))
    n = len(rows)
    alike = lambda a, b: a == b if isinstance(a, str) or isinstance(b, str) else 5 * len(a & b) >= 4 * len(a | b)
    near = [[j for j in range(n) if j != i and alike(sets[i], sets[j])] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in near[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return collections.Counter((rows[i][0], least.get(find(i)), len(near[i]), len({sets[j] for j in near[i]} - {sets[i]})) for i in range(n))


def near_copies(seed=1, groups=12, most=9):
    r = random.Random(seed)
    rows, key = [], 0
    for _ in range(groups):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, most)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"e{r.randint(0, 99)}"
            rows.append((key, " ".join(own)))
            key += 1
    return rows + [(key, None), (key + 1, ""), (key + 2, " \n"), (key + 3, "a b"), (key + 4, "a\tb"), (key + 4, "a\tb"), (None, rows[0][1]), (None, "only here and nowhere else at all")]


@pytest.mark.parametrize("bucket, cluster", [(2048, 500_000), (3, 150)])
def test_join(spark, monkeypatch, bucket, cluster):
    monkeypatch.setattr(jaccard, "BUCKET_PART", bucket)
    monkeypatch.setattr(jaccard, "CLUSTER_PART", cluster)
    rows = near_copies()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = collections.Counter(tuple(r) for r in jaccard.link_documents(df, "doc_id", "text").collect())
    assert got == brute_links(rows)


def test_join_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_documents(df, "doc_id", "text").count() == 0
    one = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.link_documents(one, "doc_id", "text").collect()} == {(1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 0, 0)}


def test_pruning_keeps_what_reaches_the_threshold():
    fewest = {n: jaccard.least_matches(n, 0.8, 1e-6) for n in (32, 64, 128)}
    from math import comb

    for n, m in fewest.items():
        # a pair of similarity 0.8 is dropped about as seldom as the tolerance says
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-4
        # one of 0.3 seldom passes
        assert sum(comb(n, k) * 0.3**k * 0.7 ** (n - k) for k in range(m, n + 1)) < (0.2 if n == 32 else 0.02)


def test_first_of_classes(spark):
    rows = near_copies(3)
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, kept_text string, other string")
    kept = jaccard.first_of_classes(df, "doc_id", "text")
    assert kept.columns == df.columns
    got = collections.Counter(r.doc_id for r in kept.collect())
    want = {i for i, c, _, _ in brute_links(rows) if i == c and i is not None}
    assert set(got) - {None} == want and max(got.values()) == 1 and got[None] == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_that_come_as_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components_module, "written", lambda df, name: rounds.append(name) or common.written(df, name))
    edges = [(10 * k + j, 10 * k) for k in range(20) for j in (1, 2, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {10 * k + j: 10 * k for k in range(20) for j in range(4)}
    assert len(rounds) == 1


@pytest.mark.parametrize("hot", [0, 3, 1024])
def test_totals(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(k % 7 and k % 3, k) for k in range(50)]
    got = common.with_total(spark.createDataFrame(rows, "a long, b long"), "a", F.min("b"), "m").collect()
    assert sorted((x.a, x.b, x.m) for x in got) == sorted((a, b, min(y for x, y in rows if x == a)) for a, b in rows)


def test_groups_across_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batch = pa.record_batch({"a": pa.array(keys, pa.int64()), "n": pa.array(range(10), pa.int64())})
    for size in range(1, 11):
        parts = [batch.slice(k, size) for k in range(0, 10, size)]
        got = list(jaccard.whole_groups(parts, ("a",)))
        assert [x for t in got for x in t["n"].to_pylist()] == list(range(10))
        assert sum(len(set(t["a"].to_pylist())) for t in got) == 4


def shuffled_bytes(spark):
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_candidates_are_not_shuffled(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=40))
    rows = [(k, " ".join(word() for _ in range(1000))) for k in range(100)]
    rows.append((100, rows[0][1] + " one more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.link_documents(df, "doc_id", "text").collect()}
        shuffled = shuffled_bytes(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: (0, 1) if k in (0, 100) else (k, 0) for k in range(101)}
    assert shuffled < 1_000_000  # of 4 MB of texts


def brute_repeats(rows):
    seen, out = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [400, 3000, 1 << 22])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(packed, "BLOCK_BYTES", block)
    r = random.Random(4)
    passage = ["".join(r.choices("abcdé ", k=n)) for n in (99, 100, 101, 160, 400)]
    rows = []
    for i in range(90):
        rows.append((i, "".join(r.choice([r.choice(passage), r.choice(passage)[r.randint(0, 30) :], "".join(r.choices("xyz ", k=r.randint(0, 120)))]) for _ in range(r.randint(0, 6)))))
    rows += [(200, None), (201, ""), (202, "q" * 700), (203, "q" * 150), (204, "ab" * 300), (None, passage[4]), (206, rows[5][1] * 2)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, block string").repartition(4)
    got = collections.Counter(tuple(x) for x in suffixes.remove_repeats(df, "doc_id", "text").collect())
    assert got == brute_repeats(rows)


def test_repeats_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(df, "doc_id", "text").count() == 0
    # of equal rows with one key, one keeps its bytes
    twice = spark.createDataFrame([(1, "z" * 300 + "y" * 100)] * 2, "doc_id long, text string")
    got = sorted(x.n_removed for x in suffixes.remove_repeats(twice, "doc_id", "text").collect())
    assert got[1] == 400 > got[0]


def test_repeats_with_other_keys(spark):
    """Keys that aren't whole numbers, in their own order; an extra column with a name used inside; a null in each column."""
    rows = [("b", "k" * 120 + "m" * 90, 1), ("a10", "k" * 120, None), ("a9", "m" * 130, 2), (None, "k" * 120, 3), ("c", None, 4), ("ç", "k" * 130, 5)]
    df = spark.createDataFrame(rows, "name string, data string, rank int").repartition(3)
    order = {k: i for i, (k, _, _) in enumerate(sorted(rows, key=lambda x: (x[0] is None, (x[0] or "").encode())))}
    want = {k[0]: k[1:] for k in brute_repeats([(order[k], t) for k, t, _ in rows])}
    got = {x["name"]: tuple(x)[1:] for x in suffixes.remove_repeats(df, "name", "data").collect()}
    assert {order[k]: v for k, v in got.items()} == want


def test_queries_leave_no_blocks_behind(spark, tmp_path):
    from tessera.llm import queries

    spark.createDataFrame([(i, f"a b c {i % 3} " * 20) for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    out = {n: queries.queries()[n](spark, str(tmp_path)) for n in ("op7_lm", "op9_repeats")}
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [df.count() for df in out.values()] == [20, 20] and out["op9_repeats"].where("n_removed > 0").count() > 0


def test_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    assert suffixes.SEED + suffixes.PERIOD - 1 == suffixes.WINDOW


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    rows = []
    for i in range(160):
        words = [f"w{r.randint(0, 900)}" for _ in range(90)]
        bad = i % 5 == 0
        text = " ".join(w + "#*#" if bad else w for w in words)
        rows.append((i, text, "en", f"s{i % 3}" if i % 2 else "big", len(text)))
    secret = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows += [(500, rows[1][1], "en", "big", 1), (501, rows[2][1] + f' token = "{secret}"', "de", None, 2), (502, None, None, None, None), (503, "", "en", "big", 0), (504, rows[3][1], None, "s1", 3), (504, rows[3][1], None, "s1", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name.replace(' ', '-')}")
        docs = spark.read.schema(out.schema).parquet(f"{sf}/{name.replace(' ', '-')}")
        seen[name] = docs
    ids = lambda name: sorted(x.doc_id for x in seen[name].select("doc_id").collect())
    clean = [i for i in range(160) if i % 5]
    assert ids("quality rules") == sorted(clean + [500, 501, 504, 504])
    # 501 has a few words more than 2 and is linked to it
    assert ids("n-gram Jaccard join") == clean
    assert seen["secret scans"].where(F.col("text").contains(secret)).count() == 0
    mixed = collections.Counter(ids("source mixing"))
    assert set(mixed) == set(clean) and max(mixed.values()) <= 2
    last = seen["byte-level BPE"]
    text = {x.doc_id: x.text for x in seen["source mixing"].collect()}
    assert all(hashlib.sha256(text[x.doc_id].encode()).hexdigest() == x.decoded_sha256 for x in last.collect()) and last.count() == sum(mixed.values())
    assert corpus_pipeline.run(spark, sf).count() == last.count()
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    assert quality.STATS


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in each column, repeated rows and a very long text, given to each stage itself."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    plain = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    long = plain(200_000)
    secret = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    one = plain(80)
    rows = [
        (1, one, None, None, None), (2, None, "en", "a", 5), (2, None, "en", "a", 5), (3, "", None, "b", 0), (None, plain(70), "en", "a", 1), (None, plain(70), "en", None, 1),
        (4, long, "de", "b", 9), (5, f'{plain(60)} token = "{secret}"', None, None, None), (1, one, None, None, None), (6, one, "en", "b", 2),
    ]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages, out = dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        out[name] = stage(spark, docs, sf).collect()
    ids = lambda name: sorted(x.doc_id or 0 for x in out[name])
    assert ids("quality rules") == [0, 0, 1, 1, 4, 5, 6]
    # null and empty are the same text, 1 stands for its copies
    assert ids("n-gram Jaccard join") == [0, 0, 1, 2, 4, 5]
    assert len(out["secret scans"]) == len(rows) and {x.text is None for x in out["secret scans"] if x.doc_id == 2} == {True} and not any(secret in (x.text or "") for x in out["secret scans"])
    assert {x.n_chars for x in out["secret scans"] if x.doc_id == 5} == {len(rows[7][1]) - len(secret) + len("[SECRET]")}
    assert set(ids("source mixing")) == {0, 1, 2, 3, 4, 5, 6} and max(collections.Counter(ids("source mixing")).values()) <= 4
    text = {x.doc_id: x.text for x in docs.collect()}
    assert len(out["byte-level BPE"]) == len(rows)
    for x in out["byte-level BPE"]:
        want = text[x.doc_id] if x.doc_id else None
        assert x.n_tokens == len(x.ids) and (not x.doc_id or x.decoded_sha256 == hashlib.sha256((want or "").encode()).hexdigest())


def test_mixed_rows_stand_in_order(spark, tmp_path):
    """The mixing stage orders an epoch's rows by their keys over all its files, which hold about as many rows each."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, f"a b {i}", "en", f"s{i % 3}", 5) for i in range(1998)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    key = lambda i, e: hashlib.md5(f"17:{e}:{i}".encode()).hexdigest()
    assert [x.doc_id for x in rows] == sorted(range(1998), key=lambda i: key(i, 0)) and [x.part for x in rows] == sorted(x.part for x in rows)
    sizes = collections.Counter(x.part for x in rows).values()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * min(sizes)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_bands(similarity):
    """Pairs of sets of an exact similarity share a band and survive the pruning: 0.8 all but one in a thousand at most."""
    r = random.Random(int(similarity * 100))
    fewest = {n: jaccard.least_matches(n, jaccard.THRESHOLD, jaccard.TOLERANCE) for n in range(jaccard.BATCH, jaccard.COMPARED + 1, jaccard.BATCH)}
    found = total = 0
    for _ in range(40):
        texts = []
        for _ in range(25):
            # texts of 200 n-grams each, the first words of both differ
            both = round(2 * 200 * similarity / (1 + similarity))
            tail = [f"t{r.randrange(10**9)}" for _ in range(both + 4)]
            texts += [" ".join([f"{side}{r.randrange(10**9)}" for _ in range(200 - both)] + tail).encode() for side in "ab"]
        _, sizes, bands, values = jaccard.sketches(texts)
        assert set(sizes) == {200}
        for k in range(0, 50, 2):
            total += 1
            found += bool((bands[k] == bands[k + 1]).any()) and len(jaccard.surviving(values, k, np.array([k + 1]), fewest)[0]) == 1
    print(f"recall at {similarity}: {found} of {total}")
    assert found >= 0.995 * total


def test_unrelated_long_texts_are_dropped():
    """The compared bytes of unrelated texts of 200 000 words agree as seldom as those of short ones."""
    r = random.Random(5)
    texts = [" ".join(f"{r.randrange(10**9)}" for _ in range(200_000)).encode() for _ in range(2)]
    values = jaccard.sketches(texts)[3]
    assert (values[0] == values[1]).sum() <= 6

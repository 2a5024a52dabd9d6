"""Hard negatives, ranked search and WARC archives, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import lexical, negatives, warc

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string"


def brute_negatives(rows, every=10):
    least = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        least[i] = min(least.get(i, row), row)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in sorted(k for k in least if k % every == 0):
        s = {i: score(least[a][1], v) for i, (_, v) in least.items() if i != a}
        same = sorted((i for i in s if least[i][0] == least[a][0]), key=lambda i: (-s[i], i))[:5]
        for p in same:
            wrong = sorted((i for i in s if least[i][0] != least[a][0] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]), key=lambda i: (-s[i], i))[:10]
            out += [(a, p, k, i, s[p], s[i]) for k, i in enumerate(wrong, 1)]
    return collections.Counter(out)


def clustered(n, width, seed):
    """Vectors around centres, some repeated, of any length; few labels, one of them hot."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    x = centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, width))
    x[::9] = x[0]
    labels = np.where(r.random(n) < 0.4, 3, r.integers(0, 5, n))
    return [(i, [float(c) for c in v], int(k), 1, "x") for i, (v, k) in enumerate(zip(x.astype(np.float32), labels, strict=True))]


@pytest.mark.parametrize("block, leaf, bucket", [(40, 60, 8), (8192, 16384, 128)])
def test_negatives(spark, monkeypatch, block, leaf, bucket):
    for name, value in (("BLOCK_ROWS", block), ("LEAF_ROWS", leaf), ("BUCKET_ROWS", bucket), ("BATCH", 7), ("SAMPLE_NUMBERS", 8 * leaf)):
        monkeypatch.setattr(negatives, name, value)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0], 1, 1, "x"), (1000, None, 1, 1, "x"), (1010, [1.0, None], 1, 1, "x"), (1020, [nan, 1.0], 1, 1, "x"), (1030, [1.0, -inf], 1, 1, "x"), (1040, [1.0] * 8, None, 1, "x"), (1050, [], 2, None, None), (1060, [2.0, 1.0], 77, 1, "x"), (1070, [-1.0] * 8, 78, 1, "x"), (1071, [1.0] * 8, 78, 1, "x")]
    rows = clustered(500, 8, 5)
    rows += odd + rows[:30] + [(20, [0.5] * 8, 0, 1, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.mine_negatives(df, "vec_id", "embedding", "label", F.col("id") % 10 == 0)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_negatives_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine_negatives(empty, "vec_id", "embedding", "label", F.col("id") % 10 == 0).count() == 0
    # vectors of zeros: scores of 0 are windows of their own, ties go by id
    rows = [(i, [0.0, 0.0], i % 2, 1, "x") for i in range(30)]
    got = negatives.mine_negatives(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label", F.col("id") % 10 == 0)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_negatives(rows)
    large = spark.createDataFrame([(0, [1e30, 0.0], 1, 1, "x")], VECTORS)
    with pytest.raises(ValueError, match="too large"):
        negatives.mine_negatives(large, "vec_id", "embedding", "label", F.col("id") % 10 == 0)


def test_tree_prunes_and_keeps_all(monkeypatch):
    """A search of one window looks at few rows of well separated ones, and finds what a scan finds."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 16)
    r = np.random.default_rng(2)
    x = (r.normal(size=(20, 6))[r.integers(0, 20, 4000)] * 300 + 3 * r.normal(size=(4000, 6))).astype(np.int64)
    space = negatives.Space(float((x**2).sum(1).max()), np.zeros((0, 7)), np.zeros(0))
    tree = negatives.Tree.unpacked(negatives.Tree.of(np.arange(4000), x, space).packed()).ready()
    read = []
    rows = tree._floats

    class Counted:
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop - at.start)
            return rows[at]

    tree._floats = Counted()
    for k in range(40):
        q = x[97 * k]
        s = x @ q
        lo, hi = int(0.3 * s.max()), int(0.8 * s.max())
        want = sorted((-int(v), i) for i, v in enumerate(s) if lo <= v <= hi)[:10]
        assert tree.search(q, [{"lo": lo, "hi": hi, "kth": None}], 10, space, -1) == [want]
    assert sum(read) < 0.3 * 40 * 4000


TEXTS = "doc_id long, text string, n long, score long"


def brute_search(rows, items, k):
    terms = lambda t: re.findall(lexical.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, query in items:
        own = []
        for i, c in docs:
            m = 75 + 25 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(query) if c[t])
            if s > 0:
                own.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(own)[:k], 1)]
    return collections.Counter(out)


def test_search(spark, monkeypatch):
    for name, value in (("SHARD_POSTINGS", 400), ("BATCH", 3), ("TURN", 2), ("PIECE", 50)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Ünïcode", "ÄB", "ab", "AB", "x2"]
    rows = [(i, r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(200)]
    rows += [(i + 1000, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (None, rows[6][1]), (7, None), (8, ""), (9, " .,!"), (10, " ".join(r.choice(words) for _ in range(60_000)))]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(12)] + [(90, None), (91, ""), (92, "nosuchword"), (93, rows[3][1]), (94, "ab AB ÄB ünïcode"), (None, "w1")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], TEXTS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.rank_texts(docs, "doc_id", "text", asked, "item_id", "text", 5)
    assert collections.Counter(tuple(x) for x in got.collect()) == brute_search(rows, [x for x in items if x[0] is not None], 5)


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], TEXTS)
    assert lexical.rank_texts(none, "doc_id", "text", items, "item_id", "text").count() == 0
    docs = spark.createDataFrame([(1, "b c", 1, 1)], TEXTS)
    assert lexical.rank_texts(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_threshold_stops_early():
    """Lists whose first postings decide are not read to their ends."""
    names = [b"rare", b"often"]
    tfs = [[50, 1] if i < 30 else [1] for i in range(5000)]
    shard = lexical.Shard.of([60] * 5000, [b"rare often" if i < 30 else b"often" for i in range(5000)], tfs, 5000, 300_000)
    assert shard.names == names
    looked = []
    plain = shard.scores
    shard.scores = lambda docs, weights: looked.append(len(docs)) or plain(docs, weights)
    docs, scores = shard.search([(0, 5000), (1, 1)], 20)
    assert docs == list(range(20)) and scores == sorted(scores, reverse=True) and sum(looked) < 500


PAGES = "page_id long, url string, html string, payload string, first int"


def brute_pages(rows, least):
    own = [(i, t or "") for i, _, t in rows]
    firsts = {}
    for i, t in own:
        if i is not None:
            firsts[t] = min(firsts.get(t, i), i)
    out = []
    for i, t in own:
        b = t.encode()
        first = firsts.get(t) if len(b) >= least else None
        again = first is not None and first != i
        out.append((str(i) if i is not None else None, "revisit" if again else "response", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), str(first) if again else None))
    return collections.Counter(out)


@pytest.mark.parametrize("least, size", [(0, 8 << 20), (4, 3000)])
def test_archives(spark, monkeypatch, least, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    r = random.Random(6)
    page = lambda n: "<p>" + " ".join(f"w{r.randint(0, 99)}" for _ in range(n)) + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://a/{i}?x=ä b\r\nX: 1", page(r.randint(0, 90))) for i in range(150)]
    rows += [(i + 500, None, rows[7][2]) for i in range(60)] + [(200, "u", None), (201, "u", ""), (202, "", "abc"), (203, "u", "abc"), (204, "u", "äöü"), (3, "u", rows[7][2]), (3, "u", rows[7][2]), (None, "u", rows[7][2]), (None, "u", "alone"), (205, "u", page(50_000))]
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], PAGES).repartition(3)
    archives = warc.write_archives(df, "page_id", "url", "html", min_bytes=least, dictionary=warc.train_dictionary(df, "html", size=2000))
    found = warc.read_archives(archives).collect()
    assert not any(x.problem for x in found) and {x.record_type for x in found} == {"warcinfo", "response", "revisit"}
    name = lambda x: None if x.startswith("urn:uuid:") else x
    assert collections.Counter((name(x.record_id), x.record_type, x.payload_bytes, x.payload_digest, x.refers_to) for x in found if x.record_type != "warcinfo") == brute_pages(rows, least)
    texts = {(str(i), (t or "").encode()) for i, _, t in rows}
    assert all((x.record_id, bytes(x.payload)) in texts if x.record_type == "response" else bytes(x.payload) == b"" for x in found if name(x.record_id) and x.record_type != "warcinfo")
    assert {x.uri for x in found if x.record_id in ("7", "202")} == {"http://a/7?x=ä%20b%0D%0AX:%201", "about:blank"}
    for a in archives.collect():
        magic, n = struct.unpack_from("<II", a.content)
        held = bytes(a.content[8 : 8 + n])
        assert magic == warc.DICTIONARY_FRAME and zstandard.ZstdCompressionDict(zstandard.decompress(held)).dict_id()


def test_archives_without_dictionary_or_rows(spark):
    df = spark.createDataFrame([(1, "u", "a", "", 1)], PAGES)
    assert [x.record_type for x in warc.read_archives(warc.write_archives(df, "page_id", "url", "html")).collect()] == ["warcinfo", "response"]
    assert warc.write_archives(df.limit(0), "page_id", "url", "html").count() == 0


def test_bad_archives(spark, tmp_path):
    """What is wrong with a record is said, and the others are read; files of other writers are read too."""
    ok = warc.record("response", "urn:uuid:1", "2020-01-01T00:00:00Z", warc.http(3, b"abc"), Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{warc.base32_sha1(b'abc')}")
    z = lambda x: zstandard.compress(x)
    flipped = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(ok))
    flipped[-1] ^= 1
    cases = {
        "short": z(ok[:-1]), "version": z(ok.replace(b"WARC/1.1", b"WARC/9.9")), "length": z(ok.replace(b"Content-Length: ", b"Content-Length: x", 1)), "more": z(ok + ok), "type": z(ok.replace(b"WARC-Type", b"Type")),
        "payload": z(ok.replace(b"abc\r\n", b"abd\r\n")), "http": z(ok.replace(b"Content-Length: 3", b"Content-Length: 2")), "flipped": bytes(flipped), "text": z(b"no headers"), "revisit": z(warc.record("revisit", "a", "b", b"")),
    }
    whole = b"".join([z(ok), *cases.values(), struct.pack("<II", 0x184D2A53, 2) + b"xx", z(ok)])
    rows = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(z(ok) + z(ok)[:-5])), ("c", bytearray(b"plain")), ("d", None), ("e", bytearray())], "archive string, content binary")
    found = warc.read_archives(rows, strict=False).collect()
    good = {(x.archive, x.position) for x in found if not x.problem}
    assert good == {("a", 0), ("a", len(cases) + 1), ("b", 0)} and len(found) == len(cases) + 2 + 2 + 1
    assert all(x.record_id == "urn:uuid:1" and bytes(x.payload) == b"abc" for x in found if not x.problem)
    with pytest.raises(Exception, match="record 1"):
        warc.read_archives(rows.where("archive = 'a'")).collect()
    (tmp_path / "x.warc.zst").write_bytes(z(ok))
    assert warc.read_archives(warc.load_archives(spark, str(tmp_path))).select("payload_bytes").collect()[0][0] == 3

"""Telephony columns, quality rules, toxicity, byte-level BPE, and n-gram scores."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, lm, packed, quality, telephony, toxicity

ODD = [(1, "Um texto é curto"), (2, None), (3, ""), (4, "a" * 5000), (5, "a b\n" * 400), (5, "a b\n" * 400), (None, "sem chave"), (7, "x y\x0bz\x0c!"), (8, "日本語 🙂 text")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 0) for i, t in ODD], "doc_id long, text string, key string, n_words int")


def slow_adpcm(block):
    """One block, sample by sample."""
    steps, moves = telephony.STEPS.tolist(), telephony.MOVES.tolist()
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = steps[index]
            move = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            now = max(-32768, min(32767, now - move if nibble & 8 else now + move))
            index = max(0, min(88, index + moves[nibble & 7]))
            out.append(now)
    return out


def test_codecs():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124) and len(set(mu.tolist())) == 255
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256) and len(set(a.tolist())) == 256
    blocks = np.random.default_rng(1).integers(0, 256, (7, 192), dtype=np.uint8)
    got = np.array(list(telephony.adpcm_decode(blocks))).T
    assert got.tolist() == [slow_adpcm(b.tolist()) for b in blocks]
    x = np.random.default_rng(2).integers(-20000, 20000, 400).astype(np.int16)
    for up, down in ((2, 1), (1, 2), (3, 2)):
        y = telephony.resample(x, up, down)
        h = telephony.lowpass(up, down)
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        slow = np.convolve(wide, h)[len(h) // 2 :][::down][: len(y)]
        assert len(y) == -(-400 * up // down) and np.abs(np.clip(np.rint(slow), -32768, 32767) - y).max() <= 1
    assert telephony.parse_wav(telephony.wav(b"abc", 7, 8000)) == (7, 1, 8000, 1, b"abc")


def slow_resample(x, up, down):
    h = telephony.lowpass(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[len(h) // 2 :][::down][: -(-len(x) * up // down)]


@pytest.mark.parametrize("up, down, n", [(2, 1, 5000), (320, 441, 900), (3, 2, 1), (16000, 11025, 700), (1, 3, 4000), (2, 1, 0)])
def test_resampling_in_pieces(monkeypatch, up, down, n):
    monkeypatch.setattr(telephony, "PIECE", 700)
    x = np.random.default_rng(3).integers(-9000, 9000, n).astype(np.int16)
    y = telephony.resample(x, up, down)
    g = np.gcd(up, down)
    want = slow_resample(x, up // g, down // g) if n else np.empty(0)
    assert len(y) == len(want) and (not n or np.abs(want - y).max() <= 0.51)


def slow_feature(payload):
    """The feature of a stored mu-law payload, sample by sample."""
    def levels(name, x):
        return f"{name}_n={len(x)} {name}_sum={sum(x)} {name}_energy={sum(v * v for v in x)} {name}_flips={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))} {name}_peak={max(map(abs, x))}"

    mu, a = ([int(v) for v in telephony.TABLES[tag][np.frombuffer(payload, np.uint8)]] for tag in (7, 6))
    loud = [abs(v) for k in range(0, len(payload), 192) for v in slow_adpcm(payload[k : k + 192])]
    pcm = [int(v) for v in np.clip(np.rint(slow_resample(np.array(mu), 2, 1)), -32768, 32767)]
    return f"tag=7 rate=8000 {levels('mu', mu)} {levels('a', a)} adpcm_abs={sum(loud)} adpcm_peak={max(loud)} {levels('pcm', pcm)}"


def test_media_files_of_all_formats(spark, monkeypatch):
    monkeypatch.setattr(telephony, "PIECE", 500)
    raw = [bytes(np.random.default_rng(k).integers(0, 256, n, dtype=np.uint8)) for k, n in enumerate((0, 1, 191, 192, 193, 3000))]
    rows = [(k, x, "a", "b") for k, x in enumerate(raw)] + [(9, None, "a", "b"), (5, raw[5], "c", "d")]
    df = spark.createDataFrame(rows, "k int, samples binary, pcm string, n_bytes string")
    for tag in (6, 7, 17):
        stored = telephony.store_telephony(df, "k", "samples", tag)
        got = telephony.expand_media(stored, "k").collect()
        for r in got:
            data = telephony.padded(bytes(rows[[x[0] for x in rows].index(r.k)][1] or b""))
            assert telephony.parse_wav(r.media)[0] == tag and telephony.parse_wav(r.media)[4] == data and r.problem is None
            if tag == 17:
                x = [v for k in range(0, len(data), 192) for v in slow_adpcm(data[k : k + 192])]
            else:
                x = telephony.TABLES[tag][np.frombuffer(data, np.uint8)].tolist()
            y = telephony.samples_of(r.pcm)
            assert y[:2] == (1, 16000) and np.abs(np.clip(slow_resample(np.array(x), 2, 1), -32768, 32767) - y[2]).max() <= 0.51
    # its own result, 8-bit PCM, odd rates, a cut block, stereo, noise and null are read or named
    odd = [telephony.wav(bytes(100), 1, 11025), telephony.wav(bytes(90), 1, 44100, 16), telephony.wav(bytes(500), 17, 8000, block=256), telephony.wav(bytes(8), 2, 8000), b"RIFF", None]
    odd.append(odd[0][:22] + b"\x02" + odd[0][23:])
    table = spark.createDataFrame([(k, x, 5) for k, x in enumerate(odd)], "k int, media binary, n_bytes long")
    got = {r.k: r for r in telephony.expand_media(table, "k").collect()}
    assert [got[k].pcm is not None for k in range(7)] == [True, True, True, False, False, False, False]
    assert [got[k].problem is None for k in range(7)] == [True, True, True, False, False, True, False]
    assert len(telephony.samples_of(got[2].pcm)[2]) == 2 * (505 + (244 - 4) * 2 + 1)
    read = {r.k: r for r in telephony.media_features(telephony.expand_media(table.where("k < 3 or k = 5"), "k"), "k").collect()}
    assert read[0].payload_bytes == 100 and read[5].media_sha256 is None and read[5].feature is None and read[1].pcm_bytes == 44 + 14 + 2 * 17 * 2 - 2 * 17 * 2 + len(telephony.samples_of(got[1].pcm)[2]) * 2


def test_telephony(spark, odd):
    stored = telephony.store_telephony(odd, "doc_id", "text")
    got = telephony.media_features(telephony.expand_media(stored, "doc_id"), "doc_id").collect()
    want = collections.Counter()
    for i, t in ODD:
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want[i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert {hashlib.sha256(r.media).hexdigest() for r in stored.collect()} == {r.media_sha256 for r in got}
    for r in got:
        pay = telephony.padded((dict(ODD[::-1])[r.doc_id] or "").encode())
        assert r.feature.startswith(slow_feature(pay) + " pcm_crc=") and r.pcm_bytes > 4 * len(pay)
    none = odd.limit(0)
    assert telephony.media_features(telephony.expand_media(telephony.store_telephony(none, "doc_id", "text"), "doc_id"), "doc_id").count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    twice = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|<\n\t\x0b\x0cé日", max_size=60))
def test_counts_property(text):
    assert quality.count_text(text.encode())[:5] == slow_stats(text)


def test_text_stats(spark, odd):
    got = collections.Counter(tuple(r)[:6] for r in quality.text_stats(odd, "doc_id", "text").collect())
    assert got == collections.Counter((i, *slow_stats(t)) for i, t in ODD)


def labelled(spark, n=400):
    r = random.Random(5)
    rows = []
    for i in range(n):
        good = i % 4 > 0
        words = [r.choice(["sol", "mar", "casa", "vento", "rio"]) + r.choice(["", ",", "."]) + str(r.randint(0, 99)) for _ in range(80)]
        rows.append((i, " ".join(w if good or r.random() < 0.5 else w + "###" for w in words), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_rules(spark, odd):
    df = labelled(spark)
    rules = quality.train_rules(df.where("doc_id < 300"), df.select("doc_id", "quality"), "doc_id", "text", "quality")
    assert rules and rules[0][0].rate == "symbol_rate"
    verdicts = quality.text_stats(df.where("doc_id >= 300"), "doc_id", "text").select("doc_id", quality.verdict(rules).alias("v")).join(df, "doc_id")
    assert verdicts.where((F.col("v") > 0) == (F.col("quality") == 1)).count() == 0
    # the same rules by numpy and by Spark
    rows = quality.text_stats(df, "doc_id", "text").select("*", quality.verdict(rules).alias("v")).collect()
    x = quality.rates([r[1:-1] for r in rows])
    assert [r["v"] > 0 for r in rows] == np.logical_or.reduce([quality.covers(rule, x, len(rows)) for rule in rules]).tolist()
    assert quality.learn_rules([], []) == [] and quality.learn_rules([[1] * 9] * 10, [True] * 10) == []
    kept = quality.filter_rows(odd, "text", ~quality.base_failed())
    assert kept.columns == odd.columns and kept.count() == 0 and quality.filter_rows(odd, "text", F.col("n_words") > 2).count() == 5
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train_rules(df, no_labels, "doc_id", "text", "quality") == []


def test_string_kernel():
    words = ["moron", "mor*on", "xyzzy"]
    word, cell, weight = toxicity.subsequences(words)
    vec = [collections.Counter() for _ in words]
    for w, c, v in zip(word, cell, weight, strict=True):
        vec[w][c] += v
    for v in vec[:2]:
        assert sum(x * x for x in v.values()) == pytest.approx(1.0, rel=0.1)
    # against the definition: all subsequences of four symbols that span six at most
    from itertools import combinations

    def slow(a, b):
        def feats(w):
            w, out = "\x02" + w + "\x03", collections.Counter()
            for c in combinations(range(len(w)), 4):
                if c[-1] - c[0] < 6:
                    out["".join(w[k] for k in c)] += 0.5 ** (c[-1] - c[0] - 3)
            return out

        x, y = feats(a), feats(b)
        return sum(v * y[k] for k, v in x.items())

    kernel, _, _ = toxicity.nystrom(words, words)
    assert kernel[0, 1] == pytest.approx(slow("moron", "mor*on") / math.sqrt(slow("moron", "moron") * slow("mor*on", "mor*on")), abs=0.02)
    assert kernel[0, 1] > 0.2 > kernel[0, 2]


def test_toxicity(spark, odd):
    r = random.Random(6)
    rows = []
    for i in range(700):
        bad = i % 5 == 0
        words = ["".join(r.choices(["the", "an", "or", "in", "sh", "re"], k=r.randint(1, 4))) for _ in range(60)]
        if bad:
            for _ in range(2):
                words.insert(r.randint(0, 59), r.choice(["stupid", "worthless", "moron", "pathetic"]))
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df, df.where("doc_id < 500").select("doc_id", "toxic"), "doc_id", "text", "toxic")
    scored = toxicity.score_toxicity(df.where("doc_id >= 500"), "doc_id", "text", model).join(df, "doc_id")
    assert scored.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 195
    a, b = model.texts(["re the st*upid an or in sh", "re the shore an or in sh"])
    assert a > 0.5 > b
    got = toxicity.score_toxicity(odd, "doc_id", "text", model).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score_toxicity(odd.limit(0), "doc_id", "text", model).count() == 0
    empty = toxicity.train_toxicity(df, df.limit(0).select("doc_id", "toxic"), "doc_id", "text", "toxic")
    assert max(empty.texts(["a b", None])) < 1e-6
    folds = {x.doc_id: x.f for x in df.select("doc_id", toxicity.fold("doc_id", 5).alias("f")).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == f for i, f in folds.items())


def test_toxicity_letters_apart():
    """Insults with a mark or blank after each letter keep most of the kernel, and are found in texts."""
    for gapped in ("i*d*i*o*t", "i d i o t", "i..d..i..o..t", "ixdxixoxt", "id io t"):
        assert toxicity.nystrom([gapped], ["idiot"], True)[0][0, 0] > 0.5, gapped
    assert toxicity.nystrom(["i*d*i*o*t"], ["pathetic"], True)[0][0, 0] < 0.1
    # without marks both readings are the same
    for a, b in zip(toxicity.subsequences(["stupid", "shore"]), toxicity.subsequences(["stupid", "shore"], True), strict=True):
        assert a == pytest.approx(b)
    assert toxicity._letters("i**d*io") == ("idio", [1, 3, 5, 6]) and toxicity._units("an i d i o t shore") == ["an", "i", "d", "i", "o", "t", "shore", "i d i o t", "an i d i", "i d i o", "d i o t"]
    r = random.Random(8)
    known = ["a", "an", "or", "in", "it", "the", *("".join(r.choices(["the", "an", "or", "in", "sh", "re"], k=r.randint(2, 4))) for _ in range(150))]
    plain = lambda n: r.choices(known, k=n)
    insults = ["stupid", "worthless", "moron", "pathetic", "idiot"]
    texts = [" ".join([*plain(30), *(r.choices(insults, k=2) if i % 5 == 0 else []), *plain(30)]) for i in range(600)]
    model = toxicity.train(texts, [i % 5 == 0 for i in range(600)])
    for w in insults:
        gapped = [" ".join(w), "*".join(w), ".".join(w), "-".join(w), "_".join(w), "~".join(w), "x".join(w), " ".join(w[i : i + 2] for i in range(0, len(w), 2)), ". ".join(w)]
        for g, score in zip(gapped, model.texts([" ".join([*plain(30), g, *plain(30)]) for g in gapped]), strict=True):
            assert score > 0.5, (g, score)
    clean = [" ".join(plain(60)) for _ in range(40)] + ["or a a in a b c d e f or", "state-of-the-art e.g. a/b/c re-in-sh 1.2.3.4.5", "a " * 50, "", "* . -"]
    assert sum(x > 0.5 for x in model.texts(clean)) <= 1


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_lines(path), special_tokens={})


def test_bpe_cuts(tokenizer):
    path, pattern, want = tokenizer
    codec = bpe.Codec(bpe.rank_lines(path), pattern)
    r = random.Random(7)
    for size in (0, 1, 40, 900, 4000):
        for alphabet in ("ab c", " \n", "a", "é日 's1!\t", "it's don't 12 \n\n  x"):
            text = "".join(r.choices(alphabet, k=size))
            parts = list(codec.pre_tokens(text, 64, 16))
            assert size < 900 or alphabet in ("a", " \n") or len(parts) > 3
            assert [t for p in parts for t in p] == codec.pattern.findall(text)
            ids = codec.encode(text)
            assert ids == want.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_cuts_after_white_space(tokenizer):
    """No piece ends in white space, which the pattern splits by what follows it."""
    path, pattern, want = tokenizer
    codec = bpe.Codec(bpe.rank_lines(path), pattern)
    r = random.Random(9)
    for gap in (" \u00a0", "\u00a0\u00a0", " \u2003", "\n\n", "\t\t", " \n\t", "\u3000 \u00a0"):
        for _ in range(20):
            text = "".join(gap + "".join(r.choices("abé日", k=r.randint(1, 6))) for _ in range(400))
            parts = list(codec.pre_tokens(text, 64, 16))
            assert len(parts) > 3 and not any(p[-1].isspace() for p in parts[:-1])
            assert [t for p in parts for t in p] == codec.pattern.findall(text)
    for text in (" \u00a0word" * 6000, "x" * 50_000 + " y" * 9000 + " " * 40_000, "ab1 " * 100_000):
        assert len(text) > bpe.CHUNK and codec.encode(text) == want.encode_ordinary(text)


def test_bpe(spark, odd, tokenizer):
    path, pattern, want = tokenizer
    got = collections.Counter(tuple(r) for r in bpe.encode_bpe(odd, "doc_id", "text", path, pattern).drop("ids").collect())
    expected = collections.Counter()
    for i, t in ODD:
        ids = want.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected
    back = bpe.decode_bpe(bpe.encode_bpe(odd, "doc_id", "text", path, pattern), "doc_id", "ids", path)
    assert sorted(r.data.decode() for r in back.collect()) == sorted(t or "" for _, t in ODD)
    assert bpe.encode_bpe(odd.limit(0), "doc_id", "text", path, pattern).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.binary(max_size=3))
def test_packing(values, more):
    v = np.array(values, np.uint64)
    assert packed.unpack(packed.pack(v) + more).tolist() == values
    d = packed.pack(np.sort(v), True)
    assert packed.unpack(d + more).tolist() == sorted(values) and packed.packed_size(d) == len(d)


@given(st.lists(st.integers(0, 3) | st.integers(0, 2**64 - 1) | st.integers(2**63, 2**63 + 5), max_size=60))
def test_distinct_hashes(values):
    v = np.array(values, np.uint64)
    keys, first, own = lm.distinct(v)
    assert keys.tolist() == sorted(set(values)) and keys[own].tolist() == values and v[first].tolist() == keys.tolist()


def test_packed_numbers_of_every_width():
    for width in range(1, 65):
        v = np.array([0, 2**width - 1, 2 ** (width - 1), 1], np.uint64)
        assert packed.unpack(packed.pack(v)).tolist() == v.tolist()
        assert packed.unpack(packed.pack(np.sort(v), True)).tolist() == sorted(v.tolist())


def test_arcs_are_known_by_the_numbers_of_their_ngrams(monkeypatch):
    """A walk of pieces scores tokens as one walk does."""
    r = random.Random(4)
    texts = [" ".join(r.choices("a b c d e f".split(), k=k)).encode() for k in (0, 1, 2, 700, 3)]
    row = {"keys": pa.array(range(len(texts))), "ranks": np.arange(len(texts), dtype=np.uint64).tobytes(), "lengths": np.array([len(x) for x in texts], np.int64).tobytes(), "data": b"".join(texts)}
    t = lm.Tokens(packed.Block(row), 7, 2)
    counts = [t.learned(k) for k in range(3)]
    automaton = lm.Automaton(t, counts, int(t.learn.sum()), int((counts[0] > 0).sum()), int((~t.out).sum()), np.full((2, 64), 0.5))
    assert len(automaton.arc2) == len(t.grams[1][0]) and len(automaton.arc3) == len(t.grams[2][0])
    whole = automaton.walk(t)
    for segment in (1, 2, 5, 10_000):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        assert np.allclose(automaton.walk(t), whole)


def slow_scores(rows, out):
    """Scores of the automaton, by dictionaries of n-grams and one token after the other."""
    toks = [(i, ["<s>", *re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split(), "</s>"]) for i, t in rows]
    grams = [collections.Counter(tuple(ws[k - m : k + 1]) for i, ws in toks if not out(i) for k in range(1, len(ws)) if k >= m) for m in range(3)]
    texts = sum(not out(i) for i, _ in rows)
    n, v = sum(grams[0].values()), len(grams[0])
    uni = lambda w: (grams[0][w,] + 1) / (n + v + 1)
    count = lambda h: texts if h == ("<s>",) else grams[len(h) - 1][h]
    cells = collections.Counter()
    place = lambda x: int(np.clip(np.rint(np.log2(x)) + lm.MIDDLE, 1, lm.BINS - 1)) if x > 0 else 0
    for i, ws in toks:
        for k in range(1, len(ws)) if not out(i) else ():
            one, two = count((ws[k - 1],)), count((ws[k - 2], ws[k - 1])) if k > 1 else 0
            p = grams[0][ws[k],] / (n + v)
            if one > 1:
                r2 = place((grams[1][ws[k - 1], ws[k]] - 1) / (one - 1) / p)
                cells[int(math.log2(one - 1)) * lm.BINS + r2] += 1
                if two > 1:
                    r3 = place((grams[2][ws[k - 2], ws[k - 1], ws[k]] - 1) / (two - 1) / p)
                    cells[64 * lm.BINS + ((int(math.log2(two - 1)) * 64 + int(math.log2(one - 1))) * lm.BINS + r3) * lm.BINS + r2] += 1
    w = lm.fit_weights(np.array(sorted(cells.items())))

    def prob(h, x):
        if not h:
            return uni(x)
        c = count(h)
        b = w[len(h) - 1, int(math.log2(c))] if c else 0.0
        return (b * grams[len(h)][(*h, x)] / c if c else 0.0) + (1 - b) * prob(h[1:], x)

    score = lambda ws: sum(math.log10(prob(tuple(ws[max(0, k - 2) : k]), ws[k])) for k in range(1, len(ws)))
    base = lambda ws: sum(math.log10(uni(x)) for x in ws[1:])
    return collections.Counter((i, out(i), len(ws) - 1, sum(grams[0][x,] > 0 for x in ws[1:]), n, round(base(ws), 6), round(score(ws), 6)) for i, ws in toks), w


@pytest.mark.parametrize("block, segment, kind", [(1 << 23, 256, "long"), (500, 3, "string")])
def test_lm(spark, monkeypatch, block, segment, kind):
    monkeypatch.setattr(packed, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["the cat", "a DOG", "runs.", "fast", "zebra" + str(i % 50)], k=r.randint(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (201, ""), (None, "the cat")]
    if kind == "string":
        rows = [(None if i is None else f"é{i}", t) for i, t in rows]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], f"doc_id {kind}, text string, score double").repartition(3)
    got = lm.score_texts(df, "doc_id", "text").collect()
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    want, weights = slow_scores(rows, out)
    assert collections.Counter((*tuple(x)[:5], round(x.base_score, 6), round(x.score, 6)) for x in got) == want and (weights > 0).sum() > 4
    held = [x for x in got if x.held_out and x.n_tokens > 5]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert lm.score_texts(df.limit(0), "doc_id", "text").count() == 0


def test_lm_probabilities_sum_to_one():
    """From one state, over all words and the unseen one, with the weights that the automaton uses."""
    counts, pairs, b = {"a": 5, "b": 3, "c": 2}, {"b": 3, "c": 1, "a": 1}, 0.4
    n, v = sum(counts.values()), len(counts)
    p = {w: (k + 1) / (n + v + 1) for w, k in counts.items()} | {"?": 1 / (n + v + 1)}
    assert sum(b * pairs.get(w, 0) / 5 + (1 - b) * q for w, q in p.items()) == pytest.approx(1.0)
    assert lm.fit_weight(np.array([0.0, 50.0]), np.array([10, 10])) == pytest.approx(0.49, abs=0.02)
    assert lm.fit_weight(np.array([0.0]), np.array([10])) == 0.0

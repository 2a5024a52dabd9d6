"""Scores of texts under a word n-gram model, as a weighted automaton with failure arcs.

States are the empty history, each word, and each pair of neighbouring words that the training texts hold. A state has an
arc for each word that follows it there, to the longest history that then stands, and one failure arc to the
history without its first word. A block numbers its n-grams, and an n-gram's number names its arc. An n-gram's probability is smoothed by the shorter ones':

    p(w) = (c(w) + 1) / (N + V + 1),
    p(w | h) = b(h) c(hw) / c(h) + (1 - b(h)) p(w | h without its first word);

the arc of a word that follows h carries p(w | h), the failure arc 1 - b(h), so a word that never
followed h gets the second term. One unseen word is reckoned with, so probabilities sum to 1. The weight b
is fitted for each power of two of c(h), for words and for pairs, by leaving each training token out of the counts it is
predicted from. A text is walked once from left to right: the walk carries the state, follows failure arcs until
a word has an arc, and adds logarithms up, the text's end as a last token.

Counts come from the whole training corpus: blocks of text send their distinct words, pairs and triples
to hash buckets, which add them up and answer with totals (see packed). So the automaton is spread over buckets,
each block builds the part that its texts walk, and nothing of the model is broadcast but a weight for each
power of two. Words are compared by 64-bit hashes, pairs and triples by 40 bits beyond their bucket's: of n of
them, about n^2 / 2^(41 + bucket bits) share a hash, fewer than one in a million at any size.

Keys may be of any type. Null and empty texts are an end only. Rows with a null key are scored, never learned from, and count
as held out. Without training texts N and V are 0. Repeated rows count as often as they occur; equal texts have equal scores. Extra
columns are left out, whatever their names. A long text is a block of its own, and a task holds about 200 bytes for each of its words. Empty
tables give empty tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import mix64, word_hashes, written

END, START = np.uint64(0x5F9B3C1D2E4A6871), np.uint64(0x1B56C4E9A3D7F205)
STEP = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of n-grams, and bytes of their hashes beyond the bucket's bits.
WORDS, PAIRS, TRIPLES = range(3)
WIDTHS = (8, 5, 5)
#: Powers of two of ratios that are told apart, and the place of 1 among them.
BINS, MIDDLE = 64, 24
#: Tokens of a text that are walked beside those of others; the state at each start is carried over.
SEGMENT = 256


def held_out(keys: list, folds: int, fold: int) -> np.ndarray:
    return np.array([k is None or zlib.crc32(str(k).encode()) % folds == fold for k in keys], bool)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, a place of each, the number of each value's hash).

    Places ride in the low bits of what is sorted, as plain sorting is much faster than sorting places. Only
    if hashes that differ share all other bits, places are sorted.
    """
    n = len(values)
    bits = np.uint64(max(1, (max(1, n) - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort(values & ~mask | np.arange(n, dtype=np.uint64)) & mask).astype(np.int64)
    flat = values[order]
    if (flat[1:] < flat[:-1]).any():
        order = np.argsort(values)
        flat = values[order]
    new = np.ones(n, bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    own = np.empty(n, np.int64)
    own[order] = np.cumsum(new) - 1
    return flat[new], order[new], own


class Tokens:
    """The tokens of a block's texts, each text's end included, and the n-grams that end at each."""

    def __init__(self, block: packed.Block, folds: int, fold: int):
        n = len(block.lengths)
        data = np.full(len(block.data) + n, 10, np.uint8)
        for k, (a, size) in enumerate(zip(block.starts.tolist(), block.lengths.tolist(), strict=True)):
            data[a + k : a + k + size] = LOWER[block.data[a : a + size]]
        starts, hashes = word_hashes(data)
        # tokens of a document: its words, then its end
        counts = np.diff(np.searchsorted(starts, np.append(block.starts, len(block.data)) + np.arange(n + 1)))
        self.counts = counts + 1
        self.last = np.cumsum(self.counts) - 1
        self.first = self.last - counts
        self.tokens = np.empty(len(starts) + n, np.uint64)
        self.tokens[self.last] = END
        word = np.ones(len(self.tokens), bool)
        word[self.last] = False
        self.tokens[word] = hashes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = START
        pairs = mix64(before * STEP + self.tokens)
        # a triple ends at every token but a text's first
        self.later = np.ones(len(self.tokens), bool)
        self.later[self.first] = False
        at = np.flatnonzero(self.later)
        triples = mix64(pairs[at - 1] * STEP + (self.tokens[at] ^ START))
        self.out = held_out(block.keys.to_pylist(), folds, fold)
        self.learn = np.repeat(~self.out, self.counts)
        #: Of each kind: distinct hashes, the number of each token's, a token at which each is met.
        self.grams = []
        for values, places in ((self.tokens, None), (pairs, None), (triples, at)):
            keys, first, own = distinct(values)
            self.grams.append((keys, own, first if places is None else places[first]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else values[:0]

    def learned(self, kind: int) -> np.ndarray:
        """How often training texts of this block hold each distinct n-gram."""
        keys, own, _ = self.grams[kind]
        return np.bincount(own, self.learn[self.later] if kind == TRIPLES else self.learn, len(keys)).astype(np.int64)


def totals(keys: list[np.ndarray], extra: list[bytes | None], block: np.ndarray) -> list[bytes]:
    """The sum of each hash's counts over all messages. The first answer also tells how many hashes have counts, and their sum."""
    sizes = np.array([len(k) for k in keys])
    flat, counts = np.concatenate(keys), np.concatenate([packed.unpack(x) for x in extra]).astype(np.int64)
    own = distinct(flat)[2]
    sums = np.bincount(own, counts).astype(np.int64)
    out = [packed.pack(x) for x in np.split(sums[own], np.cumsum(sizes)[:-1])]
    told = int((sums > 0).sum()).to_bytes(8, "big") + int(sums.sum()).to_bytes(8, "big")
    return [told + out[0], *(bytes(16) + x for x in out[1:])]


def fit_weight(ratio: np.ndarray, n: np.ndarray) -> float:
    """The b in 0..0.999 under which sum n log(1 + b (ratio - 1)) is greatest."""
    slope = lambda b: float((n * (ratio - 1) / (1 + b * (ratio - 1))).sum())
    lo, hi = 0.0, 0.999
    if slope(lo) <= 0:
        return 0.0
    if slope(hi) >= 0:
        return hi
    for _ in range(50):
        lo, hi = ((lo + hi) / 2, hi) if slope((lo + hi) / 2) > 0 else (lo, (lo + hi) / 2)
    return lo


def level(counts: np.ndarray) -> np.ndarray:
    """The power of two of counts from 1."""
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def binned(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.rint(np.log2(ratio)) + MIDDLE, 1, BINS - 1), 0).astype(np.int64)


def unbinned(place: np.ndarray) -> np.ndarray:
    return np.where(place > 0, 2.0 ** (place - MIDDLE), 0.0)


class Automaton:
    """The states and arcs that a block's texts can reach.

    State 0 has no history; then come the block's distinct words, a text's start, and its distinct pairs.
    counts: of each distinct word, pair and triple of the block in the whole training corpus.
    """

    def __init__(self, t: Tokens, counts: list[np.ndarray], tokens: int, types: int, texts: int, weights: np.ndarray):
        (_, word, _), (_, pair, pair_at), (_, triple, triple_at) = t.grams
        n1, n2, n3 = counts
        self.width = width = len(n1)
        start, pairs = width + 1, width + 2
        first = np.zeros(len(t.tokens), bool)
        first[t.first] = True
        p1 = (n1 + 1) / (tokens + types + 1)
        self.root = np.log10(p1), np.where(n1 > 0, 1 + np.arange(width), 0)
        # pairs: the state they leave, the word they add
        second = word[pair_at]
        left = np.where(first[pair_at], start, 1 + word[np.maximum(pair_at - 1, 0)])
        history = np.where(left == start, texts, np.append(n1, 0)[np.minimum(left - 1, width)])
        b1 = np.where(history > 0, weights[0][level(history)], 0.0)
        p2 = b1 * n2 / np.maximum(history, 1) + (1 - b1) * p1[second]
        # triples: the pair they leave, the word they add, the pair they lead to
        before, then = pair[triple_at - 1], pair[triple_at]
        b2 = np.where(n2[before] > 0, weights[1][level(n2[before])], 0.0)
        p3 = b2 * n3 / np.maximum(n2[before], 1) + (1 - b2) * p2[then]
        # a history's arcs are its n-grams that training texts hold, and are known by their numbers: a token's own pair or triple
        # is the arc that its word takes from the pair or word before it. An n-gram without an arc weighs 1
        self.arc2, self.arc3 = (np.log10(np.where(n > 0, p, 10.0)) for n, p in ((n2, p2), (n3, p3)))
        self.word, self.pair, self.triple = word, pair, np.zeros(len(t.tokens), np.int64)
        self.triple[t.later] = triple
        self.pairs = pairs
        # failure arcs: from a pair to its second word, from a word or a start to no history
        gone = lambda n, w: np.log10(1 - np.where(n > 0, w[level(n)], 0.0))
        self.fail = np.concatenate((np.zeros(width + 2, np.int64), 1 + second))
        self.loss = np.concatenate(([0.0], gone(n1, weights[0]), gone(np.array([texts]), weights[0]), gone(n2, weights[1])))
        self.start = start if texts else 0
        #: The state that each token leads to, by which walks that start inside a text take over.
        self.after = np.where(n2[pair] > 0, pairs + pair, self.root[1][word])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, next states) of the tokens at these places, read in states."""
        pair = self.pair[at]
        gain, after = np.zeros(len(state)), self.pairs + pair
        open_ = np.ones(len(state), bool)
        # arcs of pairs, then those of words and starts; what finds none follows its failure arc
        for arc, number, has in ((self.arc3, self.triple[at], state >= self.pairs), (self.arc2, pair, None)):
            weight = arc[number] if len(arc) else np.ones(len(state))
            here = open_ & (state > 0) if has is None else has
            hit = here & (weight <= 0)
            gain += np.where(hit, weight, 0.0)
            open_ &= ~hit
            fails = here & ~hit
            gain += np.where(fails, self.loss[state], 0.0)
            state = np.where(fails, self.fail[state], state)
        word = self.word[at]
        return gain + np.where(open_, self.root[0][word], 0.0), np.where(open_, self.root[1][word], after)

    def walk(self, t: Tokens) -> np.ndarray:
        """The log probability of each token: all texts are walked beside each other, long ones segment by segment."""
        pieces = -(-t.counts // SEGMENT)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(t.first, pieces) + SEGMENT * number
        size = np.minimum(SEGMENT, np.repeat(t.counts, pieces) - SEGMENT * number)
        state = np.where(number == 0, self.start, self.after[np.maximum(begin - 1, 0)])
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], state[order]
        out = np.empty(len(t.tokens))
        for k in range(int(size.max(initial=0))):
            on = int(np.searchsorted(-size, -k, "left"))
            out[begin[:on] + k], state[:on] = self.step(state[:on], begin[:on] + k)
        return out


def fit_weights(cells: np.ndarray) -> np.ndarray:
    """Weights of words' and pairs' histories by the power of two of their counts, from (cell, n) rows of a tally."""
    weights = np.zeros((2, 64))
    code, n = cells[:, 0], cells[:, 1]
    two = code < 64 * BINS
    for k in np.unique(code[two] // BINS):
        mine = two & (code // BINS == k)
        weights[0, k] = fit_weight(unbinned(code[mine] % BINS), n[mine])
    rest, n = code[~two] - 64 * BINS, n[~two]
    r2, r3, one, own = rest % BINS, rest // BINS % BINS, rest // BINS**2 % 64, rest // BINS**2 // 64
    b = weights[0, one]
    ratio = unbinned(r3) / (b * unbinned(r2) + 1 - b)
    for k in np.unique(own):
        weights[1, k] = fit_weight(ratio[own == k], n[own == k])
    return weights


def score_texts(df: DataFrame, key: str, text: str, folds: int = 7, fold: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of df.

    Rows whose crc32(key as text) modulo `folds` is `fold` aren't learned from. Runs jobs at once.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = packed.bucket_bits(size)
    blocks = packed.stored_blocks(packed.as_blocks(df, key, text), size)

    def ask(batches):
        for row in packed.rows_of(batches):
            t = Tokens(packed.Block(row), folds, fold)
            for kind in (WORDS, PAIRS, TRIPLES):
                keys, counts = t.grams[kind][0], t.learned(kind)
                short = packed.low(keys, bits, WIDTHS[kind])
                out = [(3 * b + kind, row["block"], packed.pack(short[s], True), packed.pack(counts[s])) for b, s in packed.messages(keys, bits)]
                if out:
                    yield packed.notes(out)

    answers = written(packed.answered(blocks.mapInArrow(ask, packed.NOTE), totals, states=False), "lm-counts")
    told = lambda at: F.coalesce(F.sum(F.conv(F.hex(F.substring("keys", at, 8)), 16, 10).cast("long")), F.lit(0))
    types, tokens = answers.where("bucket % 3 = 0").agg(told(1), told(9)).first()

    def counts_of(row: dict, t: Tokens) -> tuple[list[np.ndarray], int]:
        """Counts of the block's distinct words, pairs and triples, and of training texts: as many end as start."""
        found: list[list] = [[], [], []]
        for n in row["notes"] or ():
            found[n["bucket"] % 3].append(packed.unpack(n["keys"][16:]).astype(np.int64))
        out = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        return out, int(out[WORDS][t.grams[WORDS][1][t.last[0]]])

    def tally(batches):
        for row in packed.rows_of(batches):
            t = Tokens(packed.Block(row), folds, fold)
            (n1, n2, n3), texts = counts_of(row, t)
            word, pair, triple = (g[1] for g in t.grams)
            c1, c2 = n1[word], n2[pair]
            history = np.empty_like(c1)
            history[1:] = c1[:-1]
            history[t.first] = texts
            on = t.learn & (history > 1)
            r2 = np.zeros(len(c1), np.int64)
            r2[on] = binned((c2[on] - 1) / (history[on] - 1) / (c1[on] / (tokens + types)))
            one = level(history - 1)
            at = np.flatnonzero(t.later)
            c3, own = n3[triple], c2[at - 1]
            also = on[at] & (own > 1)
            at, c3, own = at[also], c3[also], own[also]
            r3 = binned((c3 - 1) / (own - 1) / (c1[at] / (tokens + types)))
            code = np.concatenate((one[on] * BINS + r2[on], 64 * BINS + ((level(own - 1) * 64 + one[at]) * BINS + r3) * BINS + r2[at]))
            cells, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    joined = packed.with_notes(blocks, answers)
    weights = np.zeros((2, 64))
    if tokens:
        weights = fit_weights(np.array([tuple(r) for r in joined.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()], np.int64).reshape(-1, 2))

    def walk(batches):
        for row in packed.rows_of(batches):
            block = packed.Block(row)
            t = Tokens(block, folds, fold)
            counts, texts = counts_of(row, t)
            c, n = counts[WORDS][t.grams[WORDS][1]], len(block.lengths)
            base = t.sums(np.log10((c + 1) / (tokens + types + 1)))
            score = t.sums(Automaton(t, counts, tokens, types, texts, weights).walk(t))
            columns = [block.keys, pa.array(t.out), pa.array(t.counts, pa.int64()), pa.array(t.sums((c > 0).astype(np.int64)), pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = df.schema[key].dataType.simpleString()
    out = joined.mapInArrow(walk, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)

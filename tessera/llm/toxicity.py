"""Toxicity by a gapped subsequence string kernel and a support vector machine.

The kernel of two words sums, over subsequences of four symbols that span at most six, a weight
that halves with each skipped symbol, so an insult with a character put in or left out still has
most of its subsequences. A word that holds marks, every second symbol the same, or letters that
stand apart ("i d i o t") is also read by its letters only, a mark or blank between two counting as
one skipped symbol; the higher of the two scores holds. The kernel of a sentence with a landmark is the sum over its words.

The machine is trained on the sentences of labelled texts, each with its text's label. Landmarks are words of
these sentences: those over whose subsequences the mean embeddings of both labels differ most, and an even choice
of the rest. They give the Nyström map K(sentence, landmarks) K(landmarks)^-1/2. As not every sentence of a
toxic text is toxic, the machine is fitted again with those sentences of toxic texts that it finds
toxic. Its weights fold into one table of subsequence weights, so a text
is scored without visiting the landmarks again. A text's score is a logistic function of what its words score.

Training reads ``max_docs`` labelled texts at most, taken by hash of the key, and from these
``max_sentences`` sentences of at most LONGEST characters for each label, taken by hash; scoring reads every whole text. Null and empty texts
are scored like a text without words. With labels of one kind only, or none, every score is the share
of label 1 (0 if there are none). Repeated rows count once in training; of several labels of a key the highest counts.
Equal texts have equal scores, and a score of exactly 0.5 counts as toxic in the query. Columns beyond key and text are left out, whatever their
names. Rows are scored in slices of SLICE bytes, and of a very long text CHUNK symbols at a time. Empty tables give empty tables.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sizes_of, slices, written

LENGTH, SPAN, DECAY = 4, 6, 0.5
PATTERNS = [((0, *p), DECAY ** (p[-1] + 1 - LENGTH)) for p in itertools.combinations(range(1, SPAN), LENGTH - 1)]
#: Words that have letters apart: by marks, or by one symbol at every second place.
APART, SECOND = re.compile(r"[^\W_][\W_]+[^\W_]"), re.compile(r"(?s)^.(.)(?:.\1){2,}.?$")
MARKS = re.compile(r"[\W_]+")
#: Words of at most SHORT letters next to each other are joined, WINDOW at a time; single letters over the whole run.
SHORT, WINDOW = 2, 4
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Subsequences are hashed into so many cells.
CELLS = 1 << 18
#: Symbols of a word that are looked at per call, and bytes of texts that are scored together, to bound memory.
CHUNK, SLICE = 1 << 18, 4 << 20
#: Words of a training sentence, and its characters, at most.
SENTENCE, LONGEST = 24, 1000
FULL_STOP = re.compile(r"(?<=[.!?])[ \t\r\n\x0b\x0c]+|\n+")


def _letters(word: str) -> tuple[str, list[int]]:
    """A word's letters and digits and their places, where marks between two of them count as one place."""
    if SECOND.search(word):
        return word[::2], list(range(1, len(word) + 1, 2))
    parts = [x for x in MARKS.split(word) if x]
    return "".join(parts), [i + k for i, k in enumerate((k for k, x in enumerate(parts) for _ in x), 1)]


def subsequences(words: Sequence[str], apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, cell, weight) of each subsequence; a word is lower-cased and has marks at its ends. A word's weights are scaled to length 1 as if all of its subsequences differed.

    With `apart`, marks inside a word are skipped and never symbols, so six letters with a mark after each span eleven.
    """
    marked = [EDGES.sub("", w.lower()) or w for w in words]
    place = None
    if apart:
        split = [_letters(w) for w in marked]
        marked = [w for w, _ in split]
        place = np.fromiter((p for _, at in split for p in (0, *at, at[-1] + 1 if at else 1)), np.int64)
    marked = ["\x02" + w + "\x03" for w in marked]
    symbols = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    parts = []
    for offsets, weight in PATTERNS:
        n = len(symbols) - offsets[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(own[:n] == own[offsets[-1] :])
        code = np.zeros(len(at), np.uint64)
        for o in offsets:
            code = (code ^ symbols[at + o]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        parts.append((own[at], (code >> np.uint64(20)).astype(np.int64) & (CELLS - 1), np.full(len(at), weight, np.float32) if place is None else (DECAY ** (place[at + offsets[-1]] - place[at] + 1 - LENGTH)).astype(np.float32)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    word, cell, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    norm = np.sqrt(np.bincount(word, weight.astype(np.float64) ** 2, len(words)))
    return word, cell, (weight / norm[word]).astype(np.float32)


def word_scores(words: Sequence[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table over each word's subsequences; of the two ways to read a word with letters apart, the higher one."""
    out = _sums(words, table, False)
    apart = [k for k, w in enumerate(words) if APART.search(w) or SECOND.search(EDGES.sub("", w))]
    if apart:
        out[apart] = np.maximum(out[apart], _sums([words[k] for k in apart], table, True))
    return out


def _sums(words: Sequence[str], table: np.ndarray, apart: bool) -> np.ndarray:
    out, start = np.zeros(len(words)), 0
    while start < len(words):
        stop, size = start, 0
        while stop < len(words) and (stop == start or size + len(words[stop]) < CHUNK):
            size += len(words[stop])
            stop += 1
        word, cell, weight = subsequences(words[start:stop], apart)
        out[start:stop] = np.bincount(word, weight * table[cell], stop - start)
        start = stop
    return out


def nystrom(words: Sequence[str], landmarks: Sequence[str], apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kernel of each word with each landmark, the cells that landmarks have, a column of their weights for each landmark)."""
    word, cell, weight = subsequences(landmarks)
    used, rows = np.unique(cell, return_inverse=True)
    narrow = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(narrow, (rows, word), weight)
    place = np.full(CELLS, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    step = max(16, 500 * 256 // max(256, len(landmarks)))
    for a in range(0, len(words), step):
        word, cell, weight = subsequences(words[a : a + step], apart)
        hit = place[cell] >= 0
        word, rows, weight = word[hit], place[cell[hit]], weight[hit]
        order = np.argsort(word, kind="stable")
        word, rows, weight = word[order], rows[order], weight[order]
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[a + word[first]] = np.add.reduceat(narrow[rows] * weight[:, None], first, axis=0)
    return out, used, narrow


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by Newton steps; the last column of z should be 1."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        on = y * (z @ w) < 1
        a = np.eye(z.shape[1])
        b = np.zeros(z.shape[1])
        # some thousand rows at a time, so that nothing of the size of z is made
        for k in range(0, len(z), 4096):
            own = z[k : k + 4096][on[k : k + 4096]].astype(np.float64)
            weighed = own * cost[k : k + 4096][on[k : k + 4096], None]
            a += weighed.T @ own
            b += weighed.T @ y[k : k + 4096][on[k : k + 4096]]
        new = np.linalg.solve(a, b)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def pooled(scores: np.ndarray) -> list[float]:
    """What a text is judged by: how high its words score, and how many do."""
    if not len(scores):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    high = scores > 0
    return [1.0, float(np.clip(scores.max(), -1, 1)), math.log1p(100 * float(np.maximum(scores, 0).mean())), math.log1p(100 * float(high.mean())), math.log1p(float(high.sum()))]


@dataclass(frozen=True)
class ToxicModel:
    table: np.ndarray
    bias: float
    weights: np.ndarray

    def score(self, words: Sequence[np.ndarray]) -> list[float]:
        x = np.array([pooled(s) for s in words]).reshape(len(words), -1)
        return list(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))

    def unit_scores(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Scores of each text's words."""
        ids: dict[str, int] = {}
        rows = [np.fromiter((ids.setdefault(w, len(ids)) for w in _units(t)), np.int64) for t in texts]
        scores = word_scores(list(ids), self.table) + self.bias if ids else np.zeros(0)
        return [scores[r] for r in rows]

    def texts(self, texts: Sequence[str | None]) -> list[float]:
        return self.score(self.unit_scores(texts))


def _words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode("utf-8", "ignore").split()]


def _units(text: str | None) -> list[str]:
    """The words of a text, and what short words next to each other spell."""
    words = _words(text)
    size = [len(w) if len(w) == 1 else len(EDGES.sub("", w)) or len(w) for w in words]
    out, start = list(words), 0
    while start < len(words):
        stop, single = start, start
        while stop < len(words) and size[stop] <= SHORT:
            if size[stop] > 1:
                if stop - single > WINDOW:
                    out.append(" ".join(words[single:stop]))
                single = stop + 1
            stop += 1
        if stop - single > WINDOW:
            out.append(" ".join(words[single:stop]))
        for k in range(start, max(start + 1, stop - WINDOW + 1)):
            if sum(size[k : min(k + WINDOW, stop)]) >= LENGTH and stop - start > 1:
                out.append(" ".join(words[k : min(k + WINDOW, stop)]))
        start = stop + 1
    return out


def sentences(text: str | None) -> list[str]:
    """A text's sentences, at most SENTENCE words in each."""
    out = []
    for part in FULL_STOP.split(text or ""):
        words = _words(part)
        out += [" ".join(words[k : k + SENTENCE]) for k in range(0, len(words), SENTENCE)]
    return out


def varied(words: Sequence[str], marks: str = "*.-x1") -> list[str]:
    """Each word of five letters or more with a mark put in at three places: what gapped insults look like."""
    out = []
    for k, w in enumerate(words):
        w = EDGES.sub("", w)
        if len(w) >= 5:
            out += [w[:i] + marks[(k + i) % len(marks)] + w[i:] for i in sorted({1 + (k + j * (len(w) - 1) // 3) % (len(w) - 1) for j in range(3)})]
    return out


def spelled(words: Sequence[str], marks: str = " *.-_") -> list[str]:
    """Each word with a mark after every letter, and with one after every second."""
    out = []
    for k, w in enumerate(words):
        w, mark = EDGES.sub("", w), marks[k % len(marks)]
        if len(w) >= LENGTH:
            out += [mark.join(w), mark.join(w[i : i + 2] for i in range(0, len(w), 2))]
    return out


#: A unit of a sentence, and whether it is read by its letters only.
Unit = tuple[str, bool]


def units_of(sentence: str) -> list[Unit]:
    return [(u.lower(), " " in u) for u in _units(sentence)]


def by_sentence(rows: Sequence[list[Unit]], value, width: int) -> np.ndarray:
    """For each row the sum of value(units, apart) over its units, `width` numbers each; equal units are valued once."""
    out = np.zeros((len(rows), width), np.float32)
    for apart in (False, True):
        ids: dict[str, int] = {}
        pairs = np.array([(ids.setdefault(u, len(ids)), k) for k, row in enumerate(rows) for u, a in row if a == apart], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        names = list(ids)
        for at in range(0, len(names), 2000):
            own = pairs[np.searchsorted(pairs[:, 0], at) : np.searchsorted(pairs[:, 0], at + 2000)]
            own = own[np.argsort(own[:, 1], kind="stable")]
            found = value(names[at : at + 2000], apart).reshape(-1, width)[own[:, 0] - at]
            first = np.flatnonzero(np.diff(own[:, 1], prepend=-1))
            out[own[first, 1]] += np.add.reduceat(found, first, axis=0)
    return out


#: Sentences that a contrast of both labels is shrunk by, and the kernel of words that are much alike.
DOUBT, ALIKE = 5.0, 0.5


def embedded(rows: Sequence[list[Unit]]) -> np.ndarray:
    """The mean embedding of sentences: for each cell, the weight of a sentence's subsequences."""
    out = np.zeros(CELLS)
    for at in range(0, len(rows), 500):
        _, cell, weight = subsequences([u for row in rows[at : at + 500] for u, apart in row if not apart])
        out += np.bincount(cell, weight, CELLS)
    return out / max(1, len(rows))


def choose_landmarks(rows: Sequence[list[Unit]], toxic: np.ndarray, most: int) -> list[str]:
    """Words of the sentences: half by the relative contrast of both labels' mean embeddings over a word's subsequences, no two much alike, half evenly from the rest."""
    a, b = (embedded([r for r, t in zip(rows, toxic, strict=True) if t == kind]) for kind in (True, False))
    doubt = DOUBT * (1 / max(1, toxic.sum()) + 1 / max(1, (~toxic).sum())) * 0.2
    table = ((a - b) / (a + b + doubt)).astype(np.float32)
    words = sorted({EDGES.sub("", u) for row in rows for u, apart in row if not apart} - {""})
    mean = _sums(words, table, False) / np.maximum(_sums(words, np.ones(CELLS, np.float32), False), 1e-9)
    order = np.argsort(-mean, kind="stable")
    # of words that are much alike under the kernel, the first stands for all
    high = [words[k] for k in order[: 8 * most]]
    kernel, first = nystrom(high, high)[0], []
    for k in range(len(high)):
        if len(first) < most // 2 and not (kernel[k, first] > ALIKE).any():
            first.append(k)
    first = [high[k] for k in first]
    chosen = set(first)
    rest, left = [w for w in words if w not in chosen], most - len(first)
    return first + rest[:: max(1, -(-len(rest) // left))][:left] if left else first


def disguised(rows: Sequence[list[Unit]]) -> list[list[Unit]]:
    """Each sentence with marks put into its words, and with its words spelled out: virtual examples of either label."""
    out = []
    for row in rows:
        words = [u for u, apart in row if not apart]
        out.append([(v, False) for v in varied(words)[:SENTENCE]])
        out.append([(v, True) for v in spelled(words)[:SENTENCE]])
    return [r for r in out if r]


def fit_machine(texts: Sequence[str], toxic: Sequence[bool], landmarks: int = 256, virtual: int = 1000) -> tuple[np.ndarray, float]:
    """(table of subsequence weights, bias of a word) from sentences and their texts' labels."""
    bad = np.array(toxic, bool)
    rows = [units_of(t) for t in texts]
    chosen = choose_landmarks(rows, bad, landmarks)
    _, used, narrow = nystrom([], chosen)
    values, vectors = np.linalg.eigh((narrow.T @ narrow).astype(np.float64) + 1e-3 * np.eye(len(chosen)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    root32 = root.astype(np.float32)
    embed = lambda r: np.hstack([by_sentence(r, lambda u, apart: nystrom(u, chosen, apart)[0], len(chosen)) @ root32, np.ones((len(r), 1), np.float32)])
    z = embed(rows)
    on, w = np.ones(len(rows), bool), np.zeros(len(chosen) + 1)
    for turn in range(3):
        zs, ys = [z[on]], [np.where(bad[on], 1.0, -1.0)]
        if turn:
            # disguised sentences teach with the label of what they disguise
            for label, most in ((True, virtual), (False, virtual)):
                some = np.flatnonzero(on & (bad == label))
                made = disguised([rows[k] for k in some[:: max(1, -(-len(some) // most))]])
                if made:
                    zs.append(embed(made))
                    ys.append(np.full(len(made), 1.0 if label else -1.0))
        y = np.concatenate(ys)
        share = max(1, (y > 0).sum()) / len(y)
        # once toxic texts' other sentences are left out, both labels weigh as much
        w = squared_hinge(np.vstack(zs), y, np.where(y > 0, (1 - share) / share, 1.0) ** (1.0 if turn else 0.5))
        # of toxic texts, the sentences that the machine finds toxic, if there are any
        on = ~bad | (z @ w > 0)
        on = on if (on & bad).any() else np.ones(len(rows), bool)
    table = np.zeros(CELLS, np.float32)
    table[used] = narrow @ (root @ w[:-1])
    # words are judged between what the highest words of clean and of toxic sentences score
    highest = lambda kind: np.median([max(map(float, _sums([u for u, a in rows[k] if not a], table, False)), default=0.0) for k in np.flatnonzero(on & (bad == kind))[:4000]])
    low, high = highest(False), highest(True)
    scale = 2 / max(high - low, 1e-6)
    return table * np.float32(scale), float(-(low + high) / 2 * scale)


def share_model(share: float) -> ToxicModel:
    return ToxicModel(np.zeros(CELLS, np.float32), -1.0, np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0, 0, 0, 0]))


def train(texts: Sequence[str], toxic: Sequence[bool], landmarks: int = 256) -> ToxicModel:
    """A model of a few texts, all of whose sentences are learned from."""
    seen = dict(zip(texts, map(bool, toxic), strict=True))
    y = np.array(list(seen.values()), bool)
    if not len(y) or y.all() or not y.any():
        return share_model(float(y.mean()) if len(y) else 0.0)
    each = [(s, t) for text, t in seen.items() for s in sentences(text) if len(s) <= LONGEST]
    model = ToxicModel(*fit_machine(*zip(*each, strict=True), landmarks), np.zeros(5))
    return ToxicModel(model.table, model.bias, logistic(np.array([pooled(x) for x in model.unit_scores(list(seen))]), y.astype(float)))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo `folds`; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1))


def train_toxicity(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_docs: int = 6000, max_sentences: int = 9000, landmarks: int = 256) -> ToxicModel:
    """A model of at most `max_docs` labelled texts and `max_sentences` sentences of each label; a key with several labels is toxic if one of them is.

    Executors cut the sentences and pool the words' scores; the driver gets sentences of bounded length and five numbers for each text.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    picked = rows.orderBy(F.xxhash64(F.col(key)), key).limit(max_docs).select(F.col(key).alias("__key"), (F.col("label") == 1).alias("bad"))
    sample = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "__key")
    sample = written(sample.select(F.xxhash64("text", "bad").alias("owner"), "text", "bad"), "toxicity-sample")
    tally = {r["bad"]: r["n"] for r in sample.groupBy("bad").agg(F.countDistinct("owner").alias("n")).collect()}
    if not tally.get(True) or not tally.get(False):
        return share_model(float(bool(tally.get(True))))

    def cut(batches):
        for b in batches:
            for k in range(b.num_rows):
                found = [s for s in sentences(b.column(1)[k].as_py()) if len(s) <= LONGEST]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * n, pa.int64()), pa.array([b.column(2)[k].as_py()] * n, pa.bool_()), pa.array(found, pa.string())], ["owner", "bad", "sentence"])

    each = sample.mapInArrow(cut, "owner long, bad boolean, sentence string").distinct()
    some = [r for kind in (True, False) for r in each.where(F.col("bad") == kind).orderBy(F.xxhash64("owner", "sentence"), "sentence").limit(max_sentences).collect()]
    if not some:
        return share_model(tally[True] / sum(tally.values()))
    model = ToxicModel(*fit_machine([r["sentence"] for r in some], [r["bad"] for r in some], landmarks), np.zeros(5))

    def pool(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = pooled(model.unit_scores([b.column(1)[k].as_py()])[0])
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(2)[k : k + 1], pa.array([x], pa.list_(pa.float64()))], ["owner", "bad", "x"])

    found = sorted((r["owner"], r["bad"], *r["x"]) for r in sample.mapInArrow(pool, "owner long, bad boolean, x array<double>").distinct().collect())
    discard(sample)
    data = np.array([r[2:] for r in found])
    return ToxicModel(model.table, model.bias, logistic(data, np.array([r[1] for r in found], float)))


def score_toxicity(df: DataFrame, key: str, text: str, model: ToxicModel) -> DataFrame:
    """(key, score) of each whole text."""

    def run(batches):
        for b in batches:
            for i, j in slices(sizes_of(b.column(1)), SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(model.texts(b.column(1)[i:j].to_pylist()), pa.float64())], ["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return out.withColumnRenamed("key", key)

"""Alignment of reference tokens with recognised words, one dynamic programme for each page, in bounded memory.

Distinct words are compared once, all pairs of them at a time as arrays. The programme is filled by anti-diagonals, of which two are
kept. A large page is filled twice: first only the state before each strip of diagonals is kept, then, from the last strip back, the
moves of one strip at a time are filled again for the way through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.similarity import MISMATCH, SCORES, SOUNDS, clean_similarity
from ..functions.text import clean_token
from .joins import beside

OPEN, EXTEND = -4, -1
DIAGONAL, UP, LEFT = 1, 2, 3
ALIGNMENT = "page_id string, step int, ref_idx int, trans_idx int, op string"
#: Pairs of words that are compared at once; moves, one byte each, that are kept at once; steps of a batch of results. None changes a result.
PAIRS, MOVES, STEPS = 1 << 18, 1 << 26, 1 << 16


_NOT_WORD = regex.compile(r"[^\p{L}\p{N}_]")


def _clean(word: str | None) -> str:
    return _NOT_WORD.sub("", (word or "").lower())


def _sound(word: str) -> str:
    for spelling, sound in SOUNDS:
        word = word.replace(spelling, sound)
    return word


#: Times that a letter is counted in a word; further ones are only numbered.
OFTEN = 4


class Words:
    """Words as arrays: lengths, code points (padded), the sets of their characters as bits, and the sets of these with how often they came before."""

    def __init__(self, words: list[str]):
        self.words, self.lengths = words, np.array([len(w) for w in words], np.int32)
        width = int(self.lengths.max(initial=0))
        self.codes = np.array(words, f"U{max(width, 1)}").view(np.int32).reshape(len(words), max(width, 1))[:, :width] if words else np.zeros((0, 0), np.int32)
        known, places = np.unique(self.codes, return_inverse=True)
        places, rows = places.reshape(self.codes.shape), np.arange(len(words))
        self.sets, self.bags, self.extra = np.zeros((len(words), len(known) // 64 + 1), np.uint64), np.zeros((len(words), OFTEN * len(known) // 64 + 1), np.uint64), np.zeros(len(words), np.int32)
        for k in range(width):
            own = rows[self.lengths > k]
            bit = places[own, k]
            self.sets[own, bit // 64] |= np.uint64(1) << (bit % 64).astype(np.uint64)
            before = (places[own, :k] == bit[:, None]).sum(1)
            self.extra[own] += before >= OFTEN
            own, bit = own[before < OFTEN], (bit + len(known) * before)[before < OFTEN]
            self.bags[own, bit // 64] |= np.uint64(1) << (bit % 64).astype(np.uint64)


def common(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits rows i and j of a share."""
    out = np.zeros(len(i), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[i, k] & a[j, k])
    return out


def size_of(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(1, dtype=np.int32)


def edit_distances(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distance of each pair a[i], b[j], cell by cell of all pairs at once."""
    la, lb = a.lengths[i], b.lengths[j]
    kind = np.uint8 if max(la.max(initial=0), lb.max(initial=0)) < 250 else np.int32
    x, y = np.ascontiguousarray(a.codes[i].T[: la.max(initial=0)]), np.ascontiguousarray(b.codes[j].T[: lb.max(initial=0)])
    row = np.repeat(np.arange(len(y) + 1, dtype=kind)[:, None], len(i), 1)
    out = lb.astype(np.int32)
    for k in range(len(x)):
        before, row[0] = row[0].copy(), k + 1
        for n in range(1, len(y) + 1):
            best = before + (x[k] != y[n - 1])
            before = row[n].copy()
            np.minimum(best, np.minimum(row[n], row[n - 1]) + kind(1), out=row[n])
        done = np.flatnonzero(la == k + 1)
        out[done] = row[lb[done], done]
    return out


class Spelled:
    """Clean words as they are written and as they sound, and the scores of pairs of them."""

    def __init__(self, words: list[str]):
        self.written, self.heard = Words(words), Words([_sound(w) for w in words])
        self.letters = size_of(self.written.sets)

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """pair_score(clean_similarity(x, y)) of words i and j, a byte each."""
        return np.concatenate([np.empty(0, np.int8), *(self._scores(i[at : at + PAIRS], j[at : at + PAIRS]) for at in range(0, len(i), PAIRS))])

    def _scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, least = self.written, SCORES[-1][0]
        la, lb = a.lengths[i], a.lengths[j]
        full = (la > 0) & (lb > 0)
        shared = common(a.sets, i, j)
        best = np.where(full, 0.8 * shared / np.maximum(self.letters[i] + self.letters[j] - shared, 1), 0.0)
        for p in (a, self.heard):
            lp, lq = p.lengths[i], p.lengths[j]
            most = np.maximum(lp, lq)
            # letters that only one word has are wrong: where those are more than may be, no edits reach the least score
            near = np.flatnonzero(full & (np.abs(lp - lq) <= (1 - least) * most + 1e-9))
            same = common(p.bags, i[near], j[near]) + np.minimum(p.extra[i[near]], p.extra[j[near]])
            near = near[most[near] - same <= (1 - least) * most[near] + 1e-9]
            edits = edit_distances(p, p, i[near], j[near])
            best[near] = np.maximum(best[near], np.where(most[near] > 0, 1 - edits / np.maximum(most[near], 1), 1.0))
        # where one word holds the other, the share of lengths counts, whatever else they have in common
        for k in np.flatnonzero(full & (best >= least) & (shared == np.minimum(self.letters[i], self.letters[j]))):
            x, y = a.words[i[k]], a.words[j[k]]
            if x in y or y in x:
                best[k] = min(la[k], lb[k]) / max(la[k], lb[k])
        score = np.full(len(i), MISMATCH, np.int8)
        for level, points in reversed(SCORES):
            score[best >= level] = points
        return score


def pair_scores(left: list[str], right: list[str]) -> np.ndarray:
    """pair_score(clean_similarity(x, y)) of all pairs of clean words, a byte each."""
    known = Spelled([*left, *right])
    out = np.empty((len(left), len(right)), np.int8)
    for at in range(0, len(left), step := max(1, PAIRS // max(1, len(right)))):
        rows = np.arange(at, min(at + step, len(left)))
        out[rows] = known.scores(np.repeat(rows, len(right)), np.tile(np.arange(len(right)) + len(left), len(rows))).reshape(len(rows), len(right))
    return out


class Scores:
    """Scores of all pairs of tokens and words; each distinct pair is held once."""

    def __init__(self, ref: list[str], trans: list[str]):
        a, b = [_clean(x) for x in ref], [_clean(x) for x in trans]
        rows, columns = {w: k for k, w in enumerate(dict.fromkeys(a))}, {w: k for k, w in enumerate(dict.fromkeys(b))}
        self.table = pair_scores(list(rows), list(columns)).ravel()
        self.rows, self.columns = np.array([rows[x] for x in a], np.int64) * len(columns), np.array([columns[y] for y in b], np.int64)

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.table[self.rows[i] + self.columns[j]].astype(np.int32)


class Diagonals:
    """The last two anti-diagonals of the programme; cells are held by their row i.

    A gap costs OPEN, or EXTEND where the cell it comes from was itself entered by the same gap; ties go to the diagonal, then up.
    """

    def __init__(self, m: int, n: int, scores: Scores):
        self.m, self.n, self.scores, self.d = m, n, scores, 0
        self.best, self.move = np.zeros((2, m + 1), np.int32), np.zeros((2, m + 1), np.int8)

    def copy(self) -> Diagonals:
        out = Diagonals(self.m, self.n, self.scores)
        out.d, out.best, out.move = self.d, self.best.copy(), self.move.copy()
        return out

    def advance(self) -> np.ndarray:
        """Fills the next diagonal; its moves by row."""
        self.d += 1
        d, m, n = self.d, self.m, self.n
        (last, held), (moves, _) = self.best, self.move
        best, move = held, self.move[1]  # the older diagonal is replaced in place, from copies of what is read
        low, high = max(1, d - n), min(m, d - 1)
        if low <= high:
            i = np.arange(low, high + 1)
            diagonal = held[low - 1 : high] + self.scores.at(i - 1, d - i - 1)
            up = last[low - 1 : high] + np.where(moves[low - 1 : high] == UP, EXTEND, OPEN)
            left = last[low : high + 1] + np.where(moves[low : high + 1] == LEFT, EXTEND, OPEN)
            top = np.maximum(np.maximum(diagonal, up), left)
            best[low : high + 1] = top
            move[low : high + 1] = np.where(top == diagonal, DIAGONAL, np.where(top == up, UP, LEFT))
        if d <= n:
            best[0], move[0] = OPEN + EXTEND * (d - 1), LEFT
        if d <= m:
            best[d], move[d] = OPEN + EXTEND * (d - 1), UP
        self.best, self.move = self.best[::-1], self.move[::-1]
        return self.move[0]


def moves_back(m: int, n: int, scores: Scores) -> Iterator[int]:
    """The moves of the best alignment, from its last."""
    strip = max(2, MOVES // (m + 1))
    fill, starts = Diagonals(m, n, scores), []
    while fill.d + strip < m + n:
        starts.append(fill.copy())
        for _ in range(strip):
            fill.advance()
    starts.append(fill)
    i, j = m, n
    for at in reversed(starts):
        first = at.d
        kept = np.empty((min(strip, m + n - first), m + 1), np.int8)
        for k in range(len(kept)):
            kept[k] = at.advance()
        while i + j > first:
            move = kept[i + j - first - 1, i]
            yield int(move)
            i, j = i - (move != LEFT), j - (move != UP)


def alignment(ref: list[str], trans: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each step the place in ref and in trans, -1 where it has none."""
    m, n = len(ref), len(trans)
    if not m or not n:
        return np.concatenate([np.arange(m), np.full(n, -1)]), np.concatenate([np.full(m, -1), np.arange(n)])
    moves = np.fromiter(moves_back(m, n, Scores(ref, trans)), np.int8)[::-1]
    i, j = moves != LEFT, moves != UP
    return np.where(i, np.cumsum(i) - 1, -1), np.where(j, np.cumsum(j) - 1, -1)


def groups(m: np.ndarray, n: np.ndarray) -> Iterator[list[int]]:
    """Pages of m tokens and n words in groups of like length, whose pairs and moves are held at once; a page too large for that is alone."""
    group, pairs, tall, wide = [], 0, 0, 0
    for k in np.lexsort((n, m)).tolist():
        tall, wide, pairs = max(tall, int(m[k])), max(wide, int(n[k])), pairs + int(m[k] * n[k])
        if group and (pairs > PAIRS or (len(group) + 1) * (tall + 1) * (tall + wide) > MOVES):
            yield group
            group, pairs, tall, wide = [], int(m[k] * n[k]), int(m[k]), int(n[k])
        group.append(k)
    if group:
        yield group


def alignments(pages: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """alignment() of each page, all filled at once: as the pages side by side, one diagonal after the other."""
    m, n = (np.array([len(p[k]) for p in pages]) for k in (0, 1))
    tall, wide, all_pages = int(m.max()), int(n.max()), np.arange(len(pages))
    if len(pages) == 1 and (tall * wide > PAIRS or (tall + 1) * (tall + wide) > MOVES):
        return [alignment(*pages[0])]
    whole = np.int16 if (tall + wide) * 10 < 1 << 15 else np.int32
    # scores of each page's distinct pairs, one page's after the other's; a cell's is found by what its row and its column add up to
    known, number, left, right, at = {}, {}, [], [], 0
    rows, columns = np.zeros((len(pages), max(tall, 1)), np.int64), np.zeros((len(pages), max(wide, 1)), np.int64)

    def of(word: str | None) -> int:
        if word not in number:
            number[word] = known.setdefault(_clean(word), len(known))
        return number[word]

    for p, sides in enumerate(pages):
        (a, i), (b, j) = (np.unique(np.array([of(w) for w in side], np.int64), return_inverse=True) for side in sides)
        rows[p], columns[p, : n[p]] = at, j
        rows[p, : m[p]] += i * len(b)
        left.append(np.repeat(a, len(b)))
        right.append(np.tile(b, len(a)))
        at += len(a) * len(b)
    table = np.append(Spelled(list(known)).scores(np.concatenate(left), np.concatenate(right)), np.int8(0)).astype(whole)
    best, move = np.zeros((2, len(pages), tall + 1), whole), np.zeros((2, len(pages), tall + 1), np.int8)
    kept = np.zeros((tall + wide, len(pages), tall + 1), np.int8)
    for d in range(1, tall + wide + 1):
        (last, held), (moves, filled) = best, move
        low, high = max(1, d - wide), min(tall, d - 1)
        if low <= high:
            cells = rows[:, low - 1 : high] + columns[:, d - high - 1 : d - low][:, ::-1]
            diagonal = held[:, low - 1 : high] + table[cells]
            up = last[:, low - 1 : high] + np.where(moves[:, low - 1 : high] == UP, whole(EXTEND), whole(OPEN))
            over = last[:, low : high + 1] + np.where(moves[:, low : high + 1] == LEFT, whole(EXTEND), whole(OPEN))
            top = np.maximum(np.maximum(diagonal, up), over)
            held[:, low : high + 1] = top
            filled[:, low : high + 1] = np.where(top == diagonal, np.int8(DIAGONAL), np.where(top == up, np.int8(UP), np.int8(LEFT)))
        if d <= wide:
            held[:, 0], filled[:, 0] = OPEN + EXTEND * (d - 1), LEFT
        if d <= tall:
            held[:, d], filled[:, d] = OPEN + EXTEND * (d - 1), UP
        kept[d - 1] = filled
        best, move = best[::-1], move[::-1]
    # back from every page's last cell, a step of all pages at once
    i, j, back = m.copy(), n.copy(), np.zeros((tall + wide, len(pages)), np.int8)
    for k in range(tall + wide):
        own = kept[np.maximum(i + j - 1, 0), all_pages, i]
        own[i + j == 0] = 0
        back[k] = own
        i -= (own == DIAGONAL) | (own == UP)
        j -= (own == DIAGONAL) | (own == LEFT)
    out = []
    for p in range(len(pages)):
        way = back[back[:, p] > 0, p][::-1]
        i, j = way != LEFT, way != UP
        out.append((np.where(i, np.cumsum(i) - 1, -1), np.where(j, np.cumsum(j) - 1, -1)))
    return out


def align_words(ref: list[str], trans: list[str]) -> list[tuple[int | None, int | None, str]]:
    """(ref_idx, trans_idx, op) in order: match, deletion (not recognised) or insertion (not in the reference)."""
    steps = zip(*(x.tolist() for x in alignment(ref, trans)), strict=True)
    return [(i, j, "match") if i >= 0 <= j else (i, None, "deletion") if j < 0 else (None, j, "insertion") for i, j in steps]


def align(ref_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, step, ref_idx, trans_idx, op) of every page of either table.

    ref_tokens: (page_id, ref_idx, token); words: (page_id, word_idx, word). A page's words must fit one task, and so must a
    byte for each pair of distinct ones; beside these a task holds MOVES bytes and a few diagonals.
    """
    side = lambda df, idx, word, name: df.groupBy(F.col("page_id").cast("string").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).cast("int").alias("idx"), F.col(word).alias("word")))).alias(name))
    both = side(ref_tokens, "ref_idx", "token", "ref").join(side(words, "word_idx", "word", "heard"), "page_id", "full_outer")
    names = np.array(["match", "deletion", "insertion"])

    def side_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """Where each page's rows begin, and all rows' numbers and words."""
        rows = column.flatten()
        return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))).astype(np.int64), rows.field("idx").to_numpy(zero_copy_only=False), rows.field("word").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, sides = batch["page_id"].to_pylist(), [side_of(batch[c]) for c in ("ref", "heard")]
            (r, ref_idx, tokens), (h, word_idx, words) = sides
            for group in groups(np.diff(r), np.diff(h)):
                out = []
                for k, (i, j) in zip(group, alignments([(tokens[r[k] : r[k + 1]], words[h[k] : h[k + 1]]) for k in group]), strict=True):
                    own = [np.append(idx[at[k] : at[k + 1]], -1).astype(np.int32)[x] for (at, idx), x in (((r, ref_idx), i), ((h, word_idx), j))]
                    out.append((np.full(len(i), pages[k], object), np.arange(len(i)), *own, i < 0, j < 0))
                page, step, a, b, no_ref, no_word = (np.concatenate(x) for x in zip(*out, strict=True))
                op = names[np.where(no_ref, 2, np.where(no_word, 1, 0))]
                for at in range(0, len(page), STEPS):
                    cut = slice(at, at + STEPS)
                    yield pa.RecordBatch.from_arrays([pa.array(page[cut], pa.string()), pa.array(step[cut], pa.int32()), pa.array(a[cut], pa.int32(), mask=no_ref[cut]), pa.array(b[cut], pa.int32(), mask=no_word[cut]), pa.array(op[cut], pa.string())], ["page_id", "step", "ref_idx", "trans_idx", "op"])

    return both.mapInArrow(run, ALIGNMENT)


class AlignWords:
    """align() as a table function: rows (page_id, side, idx, word), side "ref" or "heard", become steps.

    A page's rows must be of one partition; a partition may hold many pages, which are then aligned some at a time, if it is ordered by page.
    """

    def __init__(self) -> None:
        self.pages, self.held = {}, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        page = row["page_id"]
        if page not in self.pages:
            if self.held > STEPS:
                yield from self.terminate()
                self.pages, self.held = {}, 0
            self.pages[page] = {"ref": [], "heard": []}
        self.pages[page][row["side"]].append((row["idx"], row["word"]))
        self.held += 1

    def terminate(self) -> Iterator[tuple]:
        names = list(self.pages)
        sides = [[sorted(self.pages[p][x], key=lambda r: r[0]) for x in ("ref", "heard")] for p in names]
        for group in groups(*(np.array([len(s[k]) for s in sides], np.int64) for k in (0, 1))):
            for p, way in zip(group, alignments([tuple([w for _, w in side] for side in sides[p]) for p in group]), strict=True):
                ref, heard = sides[p]
                for k, (i, j) in enumerate(zip(*(x.tolist() for x in way), strict=True)):
                    yield names[p], k, None if i < 0 else ref[i][0], None if j < 0 else heard[j][0], "match" if i >= 0 <= j else "deletion" if j < 0 else "insertion"


def register_align(spark: SparkSession, name: str = "align_words") -> UserDefinedTableFunction:
    """Makes the table function known to SQL: SELECT * FROM align_words(TABLE(sides) PARTITION BY page_id), or by parts of pages, ordered by page_id."""
    made = F.udtf(AlignWords, returnType=ALIGNMENT)
    return spark.udtf.register(name, made)


def sides(ref_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Both tables of align() as rows of the table function."""
    page = F.col("page_id").cast("string").alias("page_id")
    return ref_tokens.select(page, F.lit("ref").alias("side"), F.col("ref_idx").cast("int").alias("idx"), F.col("token").alias("word")).unionByName(words.select(page, F.lit("heard").alias("side"), F.col("word_idx").cast("int").alias("idx"), "word"))


def aligned_words(alignment: DataFrame, ref_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """A page's reference tokens with the times of the words that match them; words not in the reference are left out."""
    ref = ref_tokens.select(F.col("page_id").cast("string").alias("page_id"), "ref_idx", "token")
    own = words.select(F.col("page_id").cast("string").alias("page_id"), F.col("word_idx").alias("trans_idx"), F.col("word").alias("heard"), "start", "end", "confidence")
    out = beside(alignment.where("ref_idx IS NOT NULL").select("page_id", "ref_idx", "trans_idx", "op"), ref, ["page_id", "ref_idx"], "_ref").where("_ref IS NOT NULL").withColumn("token", F.col("_ref.token")).drop("_ref")
    out = beside(out, own, ["page_id", "trans_idx"], "_own").select("*", "_own.*").drop("_own")
    # clean words as columns of their own, so that each is made once
    out = out.withColumns({"_a": clean_token(F.col("token")), "_b": clean_token(F.col("heard"))})
    out = out.withColumn("similarity", F.when(F.col("op") == "match", clean_similarity(F.col("_a"), F.col("_b"))).otherwise(0.0))
    return out.select(
        "page_id", "ref_idx", F.col("ref_idx").alias("word_idx"), F.col("token").alias("word"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"),
        F.when(F.col("op") == "match", F.col("confidence") * F.col("similarity")).otherwise(0.3).alias("confidence"), "op", "similarity", F.when(F.col("op") == "match", "matched").otherwise("needs_verification").alias("status"),
    )


def flag_uncertain(aligned: DataFrame, threshold: float = 0.6) -> DataFrame:
    return aligned.withColumn("status", F.when(F.col("confidence") < threshold, "needs_review").otherwise(F.col("status")))


def alignment_counts(alignment: DataFrame) -> DataFrame:
    """A page's matches, deletions and insertions."""
    of = lambda op: F.count_if(F.col("op") == op)
    return alignment.groupBy("page_id").agg(of("match").alias("matched"), of("deletion").alias("deleted"), of("insertion").alias("inserted"), F.count("*").alias("steps"))

"""Removal of bytes that repeat: strings of WINDOW bytes that start earlier in the corpus.

Suffixes are compared on their first WINDOW bytes, blockwise, with a difference cover. For any two
places there is a shift below PERIOD that brings both onto the cover, so two equal windows hold an
equal cover string of SEED bytes. Three rounds, each over hash buckets that are sorted one at a time:

1. Cover sample: each cover string gets its rank class (alone, or shared). Only a suffix with a
   shared cover string at a shift below PERIOD can be tied on WINDOW bytes; the others are settled
   without being sorted at all.
2. Ties come in long runs (copies). Runs are cut where the content says so; equal cuts are
   settled by the first of them.
3. Suffixes of first cuts are sorted by their window within a bucket; all but the earliest repeat.

Windows are compared by 64-bit fingerprints, as sorting needs equality only; a wrong match needs a collision of these. Memory is bounded by a block of text and by a bucket of hashes.

Keys may be of any type that Spark sorts. Earlier means a smaller key, or the same document and an earlier start; null keys come last; rows with
equal keys are ordered as they are stored. Null and empty texts, and texts shorter than a window, keep
all of their bytes. A long text is a block of its own, and a task holds about 20 bytes for each of its bytes, 40 where
all of it repeats. Extra columns are left out, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import mix64, prefix_sums, string_hashes, written

WINDOW = 100
# A difference cover; each remainder modulo PERIOD is the difference of two of COVER.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SEED = WINDOW - PERIOD + 1
#: Buckets of a later round are numbered from 1 << ROUND up.
ROUND = 26
#: A run is cut after about so many places.
CUT = 63


class Text:
    """Prefix hashes of a block, from which any string's hash follows."""

    def __init__(self, block: packed.Block):
        self.block, self.size = block, len(block.data)
        self.sums = prefix_sums(block.data)
        on = np.zeros(PERIOD, bool)
        on[list(COVER)] = True
        pattern = np.resize(on, int(block.lengths.max(initial=0)))
        covered, self.whole = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for start, n in zip(block.starts.tolist(), block.lengths.tolist(), strict=True):
            if n >= SEED:
                covered[start : start + n - SEED + 1] = pattern[: n - SEED + 1]
            if n >= WINDOW:
                self.whole[start : start + n - WINDOW + 1] = True
        #: Places of the cover sample; places where a window of one document starts.
        self.cover = np.flatnonzero(covered)

    def hashes(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        h = string_hashes(self.sums, at, length)
        return mix64(h if np.isscalar(length) else h ^ (length.astype(np.uint64) << np.uint64(40)))

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of runs of places that have a shared cover string at a shift below PERIOD."""
        n = self.size - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # a sample is within reach of the PERIOD places up to it
        many = self.cover[shared]
        steps = np.bincount(np.maximum(many - PERIOD + 1, 0), minlength=self.size + 1).astype(np.int32)
        steps[many + 1] -= 1
        ok = (np.cumsum(steps[:n], dtype=np.int32) > 0) & self.whole[:n]
        edge = np.diff(np.concatenate(([False], ok, [False])).view(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # runs of two documents never meet: the last places of a document start no window
        return starts, stops - starts

    def cuts(self, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window hashes of the runs' places, first place and count of each cut)."""
        at = spread(starts, counts)
        windows = self.hashes(at, WINDOW)
        new = np.zeros(len(at), bool)
        new[np.cumsum(counts)[:-1]] = True
        new[1:] |= (windows[:-1] & np.uint64(CUT)) == 0
        if len(new):
            new[0] = True
        first = np.flatnonzero(new)
        return windows, at[first], np.diff(first, append=len(at))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of runs, in order."""
    if not len(starts):
        return np.empty(0, np.int64)
    out = np.ones(int(counts.sum()), np.int64)
    ends = np.cumsum(counts)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def bits_of(row: dict, round_: int) -> np.ndarray:
    """Answers of a round, in the order of the keys that were asked about."""
    parts = [packed.unpack_bits(n["keys"]) for n in row["notes"] or () if n["bucket"] >> ROUND == round_]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def first_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys sorted, index of the first of each)."""
    return np.unique(keys, return_index=True)


def remove_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of df. Runs jobs at once; the result is read from stored blocks."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = packed.bucket_bits(size)
    blocks = packed.stored_blocks(packed.as_blocks(df, key, text), size)

    def ask_cover(batches):
        for row in packed.rows_of(batches):
            t = Text(packed.Block(row))
            keys = np.unique(t.hashes(t.cover, SEED))
            if len(keys):
                short = packed.low(keys, bits, 4)
                yield packed.notes([(b, row["block"], packed.pack(short[s], True), None) for b, s in packed.messages(keys, bits)])

    def asked(block: int, t: Text, keys: np.ndarray, at: np.ndarray, round_: int) -> list[tuple]:
        """Messages about sorted keys that are first at the places `at`."""
        ranks = t.block.ranks[np.searchsorted(t.block.starts, at, "right") - 1] if len(at) else np.empty(0, np.uint64)
        short = packed.low(keys, bits)
        return [(round_ << ROUND | b, block, packed.pack(short[s], True), packed.pack(ranks[s])) for b, s in packed.messages(keys, bits)]

    def ask_cuts(batches):
        for row in packed.rows_of(batches):
            t = Text(packed.Block(row))
            _, own, counts = np.unique(t.hashes(t.cover, SEED), return_inverse=True, return_counts=True)
            starts, sizes = t.candidates(((counts > 1) | bits_of(row, 0))[own])
            _, at, count = t.cuts(starts, sizes)
            own, first = first_places(t.hashes(at, count + WINDOW - 1))
            yield packed.notes([(-1, row["block"], packed.pack(starts, True), packed.pack(sizes)), *asked(row["block"], t, own, at[first], 1)])

    def settled(t: Text, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate places, their window hashes, whether their cut is the first of its kind)."""
        state = row["notes"][0]
        starts, sizes = packed.unpack(state["keys"]).astype(np.int64), packed.unpack(state["extra"]).astype(np.int64)
        windows, at, count = t.cuts(starts, sizes)
        _, first = first_places(t.hashes(at, count + WINDOW - 1))
        open_ = np.zeros(len(at), bool)
        open_[first] = ~bits_of(row, 1)
        return spread(starts, sizes), windows, np.repeat(open_, count)

    def ask_windows(batches):
        for row in packed.rows_of(batches):
            t = Text(packed.Block(row))
            at, windows, open_ = settled(t, row)
            own, first = first_places(windows[open_])
            if len(own):
                yield packed.notes(asked(row["block"], t, own, at[open_][first], 2))

    def finish(batches):
        for row in packed.rows_of(batches):
            t = Text(packed.Block(row))
            at, windows, open_ = settled(t, row)
            later = np.ones(len(at), bool)
            place = np.flatnonzero(open_)
            _, first = first_places(windows[place])
            later[place[first]] = bits_of(row, 2)
            depth = np.zeros(t.size + 1, np.int32)
            depth[at[later]] += 1
            depth[at[later] + WINDOW] -= 1
            yield digests(t.block, np.cumsum(depth[:-1]) > 0)

    kind = df.schema[key].dataType.simpleString()
    cover = packed.answered(blocks.mapInArrow(ask_cover, packed.NOTE), packed.elsewhere, states=False)
    cuts = written(packed.with_notes(blocks, cover).mapInArrow(ask_cuts, packed.NOTE), "repeats-cuts")
    cuts = written(packed.answered(cuts, packed.earlier), "repeats-first-cuts")
    windows = packed.answered(packed.with_notes(blocks, cuts).mapInArrow(ask_windows, packed.NOTE), packed.earlier, states=False)
    out = packed.with_notes(blocks, cuts.unionByName(windows)).mapInArrow(finish, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key)


def digests(block: packed.Block, gone: np.ndarray) -> pa.RecordBatch:
    removed, spans, sha = [], [], []
    kept = ~gone
    for a, n in zip(block.starts, block.lengths, strict=True):
        own = gone[a : a + n]
        removed.append(int(own.sum()))
        spans.append(int(np.count_nonzero(own[1:] & ~own[:-1]) + (n > 0 and own[0])))
        sha.append(hashlib.sha256(block.data[a : a + n][kept[a : a + n]].tobytes()).hexdigest())
    columns = [block.keys, pa.array(block.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

"""Byte-level BPE encoding and decoding with a public rank file.

A text is cut into overlapping chunks at fixed offsets. Each chunk is split into pre-tokens on its own, whatever
the others hold; neighbours are stitched at a place where both see a boundary: a pre-token that starts
in the overlap at least ``GUARD`` characters after the later chunk's start, that both found, and that no white
space stands before, as a pattern may look ahead from there. From there on both agree, as a
pre-token depends only on what stands from its own start to its boundary. Where an overlap holds no
such place (one pre-token fills it), the earlier chunk grows until there is one. The pre-tokens between stitches
are then encoded, each by itself. Decoding concatenates the raw bytes of the ids.

A text of at most a chunk is one chunk. Null texts count as empty and have no ids. Equal texts have equal ids, so repeated rows repeat; ties in
ranks don't occur. A very long text is read chunk by chunk: beside it and its ids a task holds two
chunks. Rows come in slices of SLICE bytes. Empty tables give empty tables; columns beyond key and text are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sizes_of, slices

CHUNK, OVERLAP, GUARD = 4096, 512, 64
#: Pre-tokens whose ids are remembered, and bytes of text that give a batch of results.
REMEMBERED, SLICE = 1 << 15, 1 << 20


class Codec:
    """Encodes by ranks; keeps the id strings and bytes that the digests need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in ranks.values()}
        self.known: dict[str, list[int]] = {}

    def _view(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text, start, stop)]

    def pre_tokens(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
        """The pre-tokens of the text, chunk by chunk."""
        n, start, stop, since, grow = len(text), 0, min(len(text), chunk + overlap), 0, 1
        if stop == n:
            yield [m.group() for m in self.pattern.finditer(text)]
            return
        view = self._view(text, start, stop)
        while stop < n:
            later = stop - overlap
            end = min(n, later + chunk + overlap)
            after = self._view(text, later, end)
            guard = later + min(GUARD, overlap // 4)
            both = {a for a, b in view if a >= guard and b < stop} & {a for a, _ in after if guard <= a < stop}
            cut = min((a for a in both if not text[a - 1].isspace()), default=None)
            if cut is None:
                stop, grow = min(n, stop + grow * chunk), 2 * grow
                view = self._view(text, start, stop)
                continue
            yield [text[a:b] for a, b in view if since <= a < cut]
            view, start, stop, since, grow = after, later, end, cut, 1
        yield [text[a:b] for a, b in view if a >= since]

    def _ids(self, token: str) -> list[int]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = out = self.core._encode_single_piece(token)
        return out

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for tokens in self.pre_tokens(text):
            ids += chain.from_iterable([known.get(t) or self._ids(t) for t in tokens])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def rank_lines(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _texts(batches) -> Iterator[tuple[pa.Array, list[str]]]:
    """(keys, texts) of slices of rows; null is empty."""
    for b in batches:
        texts = b.column(1)
        for i, j in slices(sizes_of(texts), SLICE):
            yield b.column(0)[i:j], [x or "" for x in texts[i:j].to_pylist()]


def encode_bpe(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """(key, ids array<int>, n_tokens, ids_sha256, decoded_sha256): token ids of each whole text, and digests of the ids joined by commas and of their bytes.

    The rank file stands at the same path on every executor.
    """

    def run(batches):
        codec = Codec(rank_lines(ranks_path), pattern)
        name = codec.names.__getitem__
        for keys, texts in _texts(batches):
            ids = [codec.encode(x) for x in texts]
            columns = [
                keys, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def decode_bpe(df: DataFrame, key: str, ids: str, ranks_path: str) -> DataFrame:
    """(key, data binary): the raw bytes of token ids; null ids give no bytes."""

    def run(batches):
        table = {i: b for b, i in rank_lines(ranks_path).items()}
        for b in batches:
            for i, j in slices(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_pylist(), SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([b"".join(map(table.__getitem__, x or ())) for x in b.column(1)[i:j].to_pylist()], pa.binary())], ["key", "data"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), ids).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)

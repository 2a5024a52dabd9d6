"""Ranked lexical search by the threshold algorithm, on shards of documents that hold impact-sorted lists and a forward index.

Only terms that some item holds are indexed; counts of documents and of terms cover all of them. A shard is one row
(shard, data); each is searched for all items, and the shards' best are merged. Shares of a score are exact integers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import slices, sizes_of, text_bytes, written

#: A term of a text whose A-Z are lower-cased; the upper-case letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: On UTF-8 bytes the same characters are outside a term.
_TERM, _GAP = re.compile(TERM.encode()), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Postings of a shard, about; items of a batch, about; postings that each list gives in the first turn; bytes of a text that are split at once. None changes a result.
SHARD_POSTINGS, BATCH, TURN, PIECE = 1 << 19, 256, 64, 1 << 20
#: Bits of the filter that keeps most terms of no item out of the index; a join removes the others.
FILTER_BITS = 22


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame, item: str, query: str) -> DataFrame:
    """(item, term, times) of all items."""
    one = items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(query).alias("query"))
    return one.select("item", F.explode(terms_of(F.col("query"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each hash of a term; at most 2 ** FILTER_BITS / 64 rows come to the driver."""
    bit = F.shiftrightunsigned(F.crc32(F.col("term").cast("binary")), 32 - FILTER_BITS)
    rows = terms.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits")).collect()
    words = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def counted(text: bytes) -> Counter:
    """How often each term stands in a text."""
    text, out, at = text.lower(), Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        end = gap.end() if gap else len(text)
        out.update(_TERM.findall(text, at, end))
        at = end
    return out


def forward_index(docs: DataFrame, key: str, text: str, known: np.ndarray) -> DataFrame:
    """(doc, n, terms, tf): each text with a term, how many it has, and those that pass the filter, joined by spaces, with their counts."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for b in batches:
            for start, stop in slices(sizes_of(b["text"]), 8 << 20):
                docs_of, ns, terms, tfs = [], [], [], []
                for doc, data in zip(b["doc"][start:stop], text_bytes(b["text"][start:stop]), strict=True):
                    found = counted(data)
                    if not found:
                        continue
                    own, tf = [], []
                    for t, c in found.items():
                        ok = seen.get(t)
                        if ok is None:
                            if len(seen) >= 1 << 19:
                                seen.clear()
                            ok = seen[t] = bool(known[zlib.crc32(t) >> 32 - FILTER_BITS])
                        if ok:
                            own.append(t)
                            tf.append(c)
                    docs_of.append(doc)
                    ns.append(found.total())
                    terms.append(b" ".join(own).decode())
                    tfs.append(tf)
                yield pa.RecordBatch.from_arrays([pa.array(docs_of, b["doc"].type), pa.array(ns, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.list_(pa.int64()))], ["doc", "n", "terms", "tf"])

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(count, f"doc {kind}, n long, terms string, tf array<long>")


class Shard:
    """Documents by key; a forward index (terms and impacts by document) and lists (postings by term, greatest impact first)."""

    def __init__(self, names: list[bytes], starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, heads: np.ndarray, order: np.ndarray, owner: np.ndarray):
        self.names, self.starts, self.terms, self.impacts, self.heads, self.order, self.owner = names, starts, terms, impacts, heads, order, owner

    @classmethod
    def of(cls, ns: list[int], terms: list[bytes], tfs: list[list[int]], documents: int, length: int) -> Shard:
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(t, len(number)) for x in terms for t in x.split()], np.int32)
        counts = np.array([len(x) for x in tfs], np.int64)
        tf = np.array([c for x in tfs for c in x], np.int64)
        m = np.repeat(np.array([75 + 25 * n * documents // length for n in ns], np.int64), counts)
        impacts = (10**9 * tf // (1000 * tf + 12 * m)).astype(np.int32)
        order = np.lexsort((-impacts, flat)).astype(np.int32)
        heads = np.searchsorted(flat[order], np.arange(len(number) + 1)).astype(np.int64)
        return cls(list(number), np.concatenate([[0], np.cumsum(counts)]), flat, impacts, heads, order, np.repeat(np.arange(len(ns), dtype=np.int32), counts))

    def packed(self) -> bytes:
        parts = [b" ".join(self.names), *(x.tobytes() for x in (self.starts, self.terms, self.impacts, self.heads, self.order, self.owner))]
        return struct.pack("<7q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        at, parts = 56, []
        for size in struct.unpack_from("<7q", data):
            parts.append(memoryview(data)[at : at + size])
            at += size
        return cls(bytes(parts[0]).split(), *(np.frombuffer(p, t) for p, t in zip(parts[1:], ("<i8", "<i4", "<i4", "<i8", "<i4", "<i4"), strict=True)))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by the forward index; each document has a term."""
        first, n = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], ends - n)

    def search(self, asked: list[tuple[int, int]], k: int) -> tuple[list[int], list[int]]:
        """(documents, scores) of the k best for (term number, weight); equal scores in the order of documents.

        Lists give postings in turns, each time twice as many. What a document that no list has given can score is at most
        the threshold: the weighted sum of the last impacts given. It ends once that is below the kth score.
        """
        weights = np.zeros(len(self.names), np.int64)
        for t, w in asked:
            weights[t] += w
        lists = np.flatnonzero(weights)
        at, ends, w = self.heads[lists].copy(), self.heads[lists + 1], weights[lists]
        seen = np.zeros(len(self.starts), bool)
        docs, best, turn = np.empty(0, np.int64), np.empty(0, np.int64), TURN
        while len(lists):
            given = [self.order[a : min(a + turn, e)] for a, e in zip(at, ends, strict=True)]
            at = np.minimum(at + turn, ends)
            new = np.unique(self.owner[np.concatenate(given)])
            new = new[~seen[new]].astype(np.int64)
            if len(new):
                seen[new] = True
                docs, best = np.concatenate([docs, new]), np.concatenate([best, self.scores(new, weights)])
                top = np.lexsort((docs, -best))[:k]
                docs, best = docs[top], best[top]
            # an exhausted list has nothing to add to a document that none has given
            left = at < ends
            threshold = int((w * self.impacts[self.order[at - 1]])[left].sum())
            if not left.any() or len(best) == k and threshold < best[-1]:
                break
            lists, at, ends, w, turn = lists[left], at[left], ends[left], w[left], 2 * turn
        ok = best > 0
        return docs[ok].tolist(), best[ok].tolist()


def rank_texts(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, query: str, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k rows of docs with the highest scores above 0, equal scores by key, null keys last.

    A term is what TERM matches where only A-Z are lower-cased; null and empty texts have none. Each row of docs is a
    document, also where its key is null or repeated. Of rows of one item the least text counts; items without an id, without terms
    or without a match have no rows. Further columns aren't read.
    """
    asked = written(item_terms(items, item, query), "lexical-items")
    forward = written(forward_index(docs, key, text, term_filter(asked)), "lexical-forward")
    documents, length, postings = forward.agg(F.count("*"), F.sum("n"), F.sum(F.size("tf"))).first()
    df = forward.where("terms != ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    shards, batches = max(1, -(-(postings or 0) // SHARD_POSTINGS)), max(1, -(-asked.select("item").distinct().count() // BATCH))
    weighted = asked.join(df, "term").select("item", F.struct("term", (weight * F.col("times")).alias("weight")).alias("term"))
    queries = weighted.groupBy("item").agg(F.collect_list("term").alias("terms"))
    queries = written(queries.groupBy(F.pmod(F.xxhash64("item"), F.lit(batches)).alias("batch")).agg(F.collect_list(F.struct("item", "terms")).alias("queries")), "lexical-queries")
    kind, item_kind = forward.schema["doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()

    def build(rows: pa.Table) -> pa.Table:
        ids = rows["doc"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        rows = rows.take(order)
        made = Shard.of(rows["n"].to_pylist(), text_bytes(rows["terms"]), rows["tf"].to_pylist(), documents, length)
        return pa.table({"shard": rows["shard"][:1], "docs": pa.array([rows["doc"].to_pylist()], pa.list_(rows["doc"].type)), "data": pa.array([made.packed()], pa.binary())})

    dealt = forward.where("terms != ''").withColumn("shard", F.pmod(F.xxhash64("doc", "n", "terms"), F.lit(shards).cast("long")))
    blocks = written(dealt.groupBy("shard").applyInArrow(build, f"shard long, docs array<{kind}>, data binary"), "lexical-shards")
    to_each = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "queries")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                shard, out = Shard.unpacked(b["data"][r].as_py()), ([], [], [])
                number = {t: i for i, t in enumerate(shard.names)}
                for q in b["queries"][r].as_py():
                    own = [(number[t], x["weight"]) for x in q["terms"] if (t := x["term"].encode()) in number]
                    for doc, score in zip(*shard.search(own, k), strict=True):
                        out[0].append(q["item"])
                        out[1].append(doc)
                        out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b["queries"].type.value_type.field("item").type), b["docs"][r].values.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int64())], ["item", "doc", "score"])

    # not broadcast: what each shard gets grows with the shards
    found = blocks.join(to_each.hint("merge"), "shard").select("docs", "data", "queries").mapInArrow(search, f"item {item_kind}, doc {kind}, score long")
    rank = F.row_number().over(W.Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")

"""Jaccard join on word n-grams, with MinHash candidates that a posterior probability prunes.

Texts with equal sets of n-grams become one node. Nodes whose MinHash values agree on a band are
compared value by value: after each batch a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold (uniform prior, so a binomial tail) is below TOLERANCE. What
remains is joined into clusters. Within a cluster the pairs whose sizes allow a link are compared and dropped in the
same way, and all that survive are verified on the whole sets. Nothing is emitted for a pair: a bucket
gives a spanning forest, verification gives each node its count of links and a root.

A bucket or cluster larger than a part is dealt into parts, and each two parts meet in a task of
their own, so no task holds a group of any size and no link is lost. Totals of a band, a cluster or a node
come to the rows of hot keys where they stand (see with_total); copies of a text are dealt first (see spread_join).
Texts are shuffled only where a filter of the keys with candidates lets them pass.

A text of fewer than n words has one n-gram, all of its words; a text without words has none and
is linked to texts of the same bytes only. Null is the empty text. Repeated rows are copies; a similarity
of exactly the threshold is a link. Extra columns are left out. A long text is hashed step by step, so
beside it memory holds some tens of bytes for each of its words. Nodes are told apart by 64-bit fingerprints of their sets.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import mix64, slices, spread_join, text_bytes, with_total, word_hashes, written
from .components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 6
#: MinHash values that are compared, and how many at a time.
COMPARED, BATCH = 128, 32
#: Members of a bucket, and n-grams of a cluster, that one task takes from each of two parts.
BUCKET_PART, CLUSTER_PART = 2048, 500_000
SLICE = 1 << 20
#: Bits of the filter that keeps most texts without candidates from being shuffled; it is broadcast.
FILTER = 1 << 23
_rng = np.random.default_rng(20)
XOR, ODD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32), _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n matches for which P(similarity >= threshold) is at least the tolerance."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def ngram_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, how many of each text): sorted and distinct within each text."""
    lengths = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, hashes = word_hashes(data)
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    counts = np.diff(np.searchsorted(starts, first))
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)
    place, own = np.arange(len(hashes)) - begin[text], counts[text]
    grams = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate((hashes, np.zeros(words, np.uint64)))
    for k in range(words):
        inside = place + k < own
        grams = np.where(inside, mix64(grams * np.uint64(0xC2B2AE3D27D4EB4F) + padded[k : k + len(hashes)] + np.uint64(k + 1)), grams)
    keep = (place + words <= own) | (place == 0)
    grams, text = grams[keep], text[keep]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(texts))


def sketches(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, n-grams, band hashes, compared values) of each text."""
    grams, sizes = ngram_sets(texts, words)
    full = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[full]
    node = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") if not n else 0 for x, n in zip(texts, sizes, strict=True)], np.uint64)
    values = np.zeros((len(texts), BANDS * ROWS), np.uint32)
    if len(full):
        node[full] = mix64(np.add.reduceat(mix64(grams ^ np.uint64(0x165667B19E3779F9)), first) + sizes[full].astype(np.uint64))
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            values[full, k] = np.minimum.reduceat((short ^ XOR[k]) * ODD[k], first)
    bands = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return node, sizes, bands, low_bytes(values[:, :COMPARED])


def low_bytes(values: np.ndarray) -> np.ndarray:
    """A mixed byte of each MinHash value: minima of large sets are small numbers, so their own high bits would tell nothing apart."""
    x = values ^ (values >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x = x * np.uint32(0xC2B2AE35)
    return (x >> np.uint32(24)).astype(np.uint8)


class Forest:
    """Sets of numbers 0..n-1 that are joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, others) -> None:
        for y in others:
            a, b = self.root(x), self.root(int(y))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def surviving(values: np.ndarray, i: int, others: np.ndarray, fewest: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(those of others that no batch of values drops as partners of i, their matches)."""
    matches = np.zeros(len(others), np.int64)
    for n in range(BATCH, COMPARED + 1, BATCH):
        if not len(others):
            break
        matches += (values[others, n - BATCH : n] == values[i, n - BATCH : n]).sum(1)
        kept = matches >= fewest[n]
        others, matches = others[kept], matches[kept]
    return others, matches


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of runs that hold one place at least, in order."""
    out = np.ones(int(counts.sum()), np.int64)
    ends = np.cumsum(counts)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def matched_roots(values: np.ndarray, left: np.ndarray, right: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Roots of the forest that pairs (one of left, one of right) make which no batch drops."""
    forest = Forest(len(values))
    for i in left:
        # the pairs of two halves that are one are looked at once
        others = right[right > i] if left is right else right
        forest.join(int(i), surviving(values, i, others, fewest)[0])
    return forest.roots()


def dealt(df: DataFrame, group: str, parts, salt) -> DataFrame:
    """df with (low, high): each two of a group's parts meet under their numbers; own: the row's part."""
    out = df.withColumn("parts", parts).withColumn("own", F.pmod(salt, F.col("parts")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return out.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "parts")


def group_edges(t: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Where groups start among rows that are sorted by whole numbers, and the end of the last."""
    new = np.ones(t.num_rows + 1, bool)
    new[1:-1] = np.any([np.diff(np.array(t[c])) != 0 for c in by], axis=0)
    return np.flatnonzero(new)


def whole_groups(batches, by: tuple[str, ...]):
    """Tables of sorted rows in which each group is whole: a batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = group_edges(pa.Table.from_batches([batch]), by)
        if held and any(held[0][c][0] != batch[c][0] for c in by):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(edge) > 2:
            yield pa.Table.from_batches([*held, batch.slice(0, edge[-2])]).combine_chunks()
            held = []
        held.append(batch.slice(edge[-2]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def link_documents(df: DataFrame, key: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, class_id, n_links, n_linked_texts), one row for each row of df. Runs jobs at once.

    class_id: least key of all rows that links connect with it; n_links: other rows whose similarity
    reaches the threshold, copies included; n_linked_texts: different sets of n-grams among these.
    """
    return _linked(df, key, text, words, threshold, tolerance).drop("spare")


def _linked(df: DataFrame, key: str, text: str, words: int, threshold: float, tolerance: float) -> DataFrame:
    """link_documents with `spare`: the text's MD5 where the key is null, by which such rows are told apart."""
    kind = df.schema[key].dataType.simpleString()
    fewest = {n: least_matches(n, threshold, tolerance) for n in range(BATCH, COMPARED + 1, BATCH)}

    def sketch(batches):
        for b in batches:
            data = text_bytes(b.column(1))
            for i, j in slices([len(x) for x in data], SLICE):
                node, sizes, bands, values = sketches(data[i:j], words)
                columns = [
                    b.column(0)[i:j], pa.array(node.view(np.int64)), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64))), pa.array([x.tobytes() for x in values], pa.binary()),
                    pa.array([None if k else hashlib.md5(x).hexdigest() for k, x in zip(b.column(0)[i:j].is_valid().to_pylist(), data[i:j], strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "bands", "compared", "spare"])

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sketched = written(docs.mapInArrow(sketch, f"key {kind}, node long, n long, bands array<long>, compared binary, spare string"), "jaccard-sketches")
    # rows of one node have equal sketches
    nodes = written(sketched.groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("compared").alias("compared")), "jaccard-nodes")

    # buckets of two nodes or more
    banded = nodes.where("n > 0").select("node", F.explode("bands").alias("band"))
    shared = with_total(banded, "band", F.count("*"), "members").where("members > 1")
    entries = shared.join(nodes.select("node", "compared"), "node")
    parts = F.ceil(F.col("members") / BUCKET_PART)
    entries = dealt(entries.select("band", "node", "compared", "members"), "band", parts, F.xxhash64("node"))

    def buckets(batches):
        for t in whole_groups(batches, ("band", "low", "high")):
            own, node, edge = np.array(t["own"]), np.array(t["node"]), group_edges(t, ("band", "low", "high"))
            values = np.frombuffer(b"".join(t["compared"].to_pylist()), np.uint8).reshape(-1, COMPARED)
            low, high = np.array(t["low"]), np.array(t["high"])
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                # trees hang on a bucket's least node
                order = i + np.argsort(node[i:j], kind="stable")
                left, right = np.flatnonzero(own[order] == low[i]), np.flatnonzero(own[order] == high[i])
                roots = matched_roots(values[order], left, left if low[i] == high[i] else right, fewest)
                some = roots != np.arange(len(roots))
                a.append(node[order][some])
                b.append(node[order][roots[some]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    # comparing takes long for its bytes, so tasks stay as many as shuffle partitions
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = entries.repartition(tasks, "band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(buckets, "a long, b long")
    clusters = written(components(alike), "jaccard-clusters")

    # the sets of clustered nodes, one text for each node
    members = clusters.join(nodes.select("node", "key", "n", "copies", "compared"), "node")
    members = written(with_total(members, "root", F.sum("n"), "total"), "jaccard-members")

    def sets(batches):
        for b in batches:
            data = text_bytes(b.column(1))
            for i, j in slices([len(x) for x in data], SLICE):
                grams, sizes = ngram_sets(data[i:j], words)
                own = np.split(grams, np.cumsum(sizes)[:-1])
                node = np.array([int(mix64(np.add.reduce(mix64(g ^ np.uint64(0x165667B19E3779F9)), keepdims=True) + np.uint64(len(g)))[0]) if len(g) else 0 for g in own], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([g.tobytes() for g in own], pa.binary())], ["node", "grams"])

    # most other texts fall to a filter where they stand, so only these texts and a few more are joined by key
    keys = members.select(F.col("key").alias("k")).distinct()
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    marks = keys.select(place("k").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits"))
    near = docs.withColumn("bit", place("key")).join(F.broadcast(marks), F.shiftright("bit", 6) == F.col("word")).where("shiftrightunsigned(bits, cast(bit & 63 AS INT)) & 1 = 1")
    # an inner join with distinct keys: a semi join would be moved before the filter
    wanted = near.join(keys, F.col("key").eqNullSafe(F.col("k")))
    full = wanted.select("key", "text").mapInArrow(sets, "node long, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))
    full = members.select("root", "node", "copies", "total", "compared").join(full, "node")
    full = dealt(full, "root", F.ceil(F.col("total") / CLUSTER_PART), F.xxhash64("node"))

    def verify(group):
        own, node, copies = np.array(group["own"]), np.array(group["node"]), np.array(group["copies"])
        grams = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        values = np.frombuffer(b"".join(group["compared"].to_pylist()), np.uint8).reshape(-1, COMPARED)
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sizes = np.array([len(g) for g in grams])
        order = np.argsort(sizes, kind="stable")
        sizes, grams, own, node, copies, values = sizes[order], [grams[k] for k in order], own[order], node[order], copies[order], values[order]
        _, ids = np.unique(np.concatenate(grams), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        flag = np.zeros(int(ids.max()) + 1, np.int32)
        links, texts, forest = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), Forest(len(node))
        for i in range(len(node)):
            # later ones are no smaller; a link needs sizes of that ratio
            stop = int(np.searchsorted(sizes, np.floor(sizes[i] / threshold + 1e-9), "right"))
            if stop <= i + 1:
                continue
            at = np.arange(i + 1, stop)
            # of two parts only pairs across them; pairs inside a part meet where it is alone
            at = surviving(values, i, at[own[at] != own[i]] if low != high else at, fewest)[0]
            if not len(at):
                continue
            mine = ids[starts[i] : ends[i]]
            flag[mine] = 1
            common = np.add.reduceat(flag[ids[spread(starts[at], sizes[at])]], np.cumsum(sizes[at]) - sizes[at])
            flag[mine] = 0
            at = at[common / (sizes[i] + sizes[at] - common) >= threshold]
            links[i] += copies[at].sum()
            texts[i] += len(at)
            links[at] += copies[i]
            texts[at] += 1
            forest.join(i, at)
        roots = forest.roots()
        least = node.copy()
        np.minimum.at(least, roots, node)
        return pa.table({"node": pa.array(node), "peer": pa.array(least[roots]), "links": pa.array(links), "texts": pa.array(texts)})

    verified = written(full.repartition(tasks, "root", "low", "high").groupBy("root", "low", "high").applyInArrow(verify, "node long, peer long, links long, texts long"), "jaccard-links")
    classes = components(verified.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classed = with_total(classes.join(nodes.select("node", "key"), "node"), "root", F.min("key"), "class_id")
    told = nodes.select("node", "key", "copies").join(classed.drop("key"), "node", "left").join(counts, "node", "left")
    told = told.select("node", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    # copies of one node are dealt by their keys
    rows = sketched.select("key", "node", "spare", F.coalesce(F.col("key").cast("string"), "spare").alias("_item"))
    return spread_join(rows, told, "node", "_item").select(F.col("key").alias(key), "class_id", "n_links", "n_linked_texts", "spare")


def first_of_classes(df: DataFrame, key: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """df's rows without those that a link connects to a row of a smaller key; of equal rows one stays.

    Rows with a null key go if their class has another key; otherwise one of each text stays.
    """
    links = _linked(df, key, text, words, threshold, tolerance)
    kept = links.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy(F.struct(F.col(key).alias("key"), "spare").alias("__kept")).agg(F.count("*").alias("__times"))
    spare = F.when(F.col(key).isNull(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = df.select(F.struct(*df.columns).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"), spare.alias("__spare"))
    rows = rows.join(kept, F.col("__key").eqNullSafe(F.col("__kept.key")) & F.col("__spare").eqNullSafe(F.col("__kept.spare")))
    # only rows whose key stands in several are looked at together
    others = [F.col(f"__row.{f.name}") for f in df.schema if f.name not in (key, text) and f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    same = W.Window.partitionBy("__key", "__text").orderBy("__key", *others)
    repeated = rows.where("__times > 1").withColumn("__copy", F.row_number().over(same)).where("__copy = 1")
    return rows.where("__times = 1").select("__row.*").unionByName(repeated.select("__row.*"))

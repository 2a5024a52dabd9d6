"""Hard negatives: rows of other labels whose score with an anchor falls into a window below that of a row of its own label.

A score is an inner product of integer vectors. With one more component, the root of M2 - |x|^2, all rows lie on a sphere of squared
radius M2, and the squared distance from an anchor q (further component 0) to a row is |q|^2 + M2 - 2 * score: best first is
nearest first, and a window of scores is an annulus of distances.

Rows are dealt into cells by label and by a routing tree, and cells into blocks; each block is stored as a vantage-point tree. An
anchor visits the blocks of the leaves nearest to its annulus first. What it finds there bounds the distance to which the
others are visited, and within a block nodes are taken nearest first, up to the same bound. Distances only exclude, by bounds of the triangle
inequality with a margin; scores are exact.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: Rows of a block, about; rows below which a node isn't split; rows of a routing leaf at least; anchors of a batch, about. None changes a result.
BLOCK_ROWS, BUCKET_ROWS, LEAF_ROWS, BATCH = 8192, 128, 16384, 512
#: Leaves that are visited before a bound is known, and leaves at most. The routing tree is fitted on some SAMPLE rows, taken by hash.
NEAR, LEAVES, SAMPLE = 2, 1024, 16384
#: Components of a block, and of the sample, at most: of long vectors both have fewer rows.
BLOCK_NUMBERS, SAMPLE_NUMBERS = 1 << 20, 1 << 22


@dataclass(frozen=True)
class Space:
    """M2; pivots of the routing tree (augmented, by heap order) with the distance that splits their rows."""

    m2: float
    pivots: np.ndarray
    splits: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.splits) + 1).bit_length() - 1

    @property
    def margin(self) -> float:
        return 1e-6 * self.m2**0.5 + 1e-9

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.m2 - np.einsum("ij,ij->i", x, x)))])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distance to the pivot of each level on the way."""
        own, node, far = self.augmented(x), np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            gap = own - self.pivots[node]
            far[:, level] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            node = 2 * node + 1 + (far[:, level] > self.splits[node])
        return node - len(self.splits), far


def fit_space(sample: np.ndarray, m2: float, depth: int, width: int) -> Space:
    space = Space(m2, np.zeros((2**depth - 1, width + 1)), np.zeros(2**depth - 1))
    own, groups = space.augmented(sample), {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        rows = groups.pop(node)
        if len(rows):
            # the row that is farthest from the first one
            pivot = own[rows[np.argmax(np.square(own[rows] - own[rows[0]]).sum(1))]]
            d = np.sqrt(np.square(own[rows] - pivot).sum(1))
            space.pivots[node], space.splits[node] = pivot, np.median(d)
            groups[2 * node + 1], groups[2 * node + 2] = rows[d <= space.splits[node]], rows[d > space.splits[node]]
        else:
            groups[2 * node + 1] = groups[2 * node + 2] = rows
    return space


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, those that are too short filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


class Tree:
    """A vantage-point tree: rows in the order of its leaves, nodes as ranges of rows, bounds of the distances of a node's rows to its parent's pivot."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, bounds: np.ndarray):
        self.ids, self.rows, self.nodes, self.bounds = ids, rows, nodes, bounds

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, space: Space) -> Tree:
        order = np.argsort(ids)
        ids, rows = ids[order], rows[order]
        own, place = space.augmented(rows.astype(np.float64)), np.arange(len(ids))
        # start, end, pivot's row, first of two children or 0
        nodes, bounds, k = [[0, len(ids), 0, 0]], [[0.0, np.inf]], 0
        while k < len(nodes):
            a, b, _, _ = nodes[k]
            if b - a > BUCKET_ROWS:
                part = place[a:b]
                pivot = part[np.argmax(np.square(own[part] - own[part[0]]).sum(1))]
                d = np.sqrt(np.square(own[part] - own[pivot]).sum(1))
                by, middle = np.argsort(d, kind="stable"), (b - a) // 2
                place[a:b], d = part[by], d[by]
                nodes[k][2:] = [pivot, len(nodes)]
                nodes += [[a, a + middle, 0, 0], [a + middle, b, 0, 0]]
                bounds += [[d[0], d[middle - 1]], [d[middle], d[-1]]]
            k += 1
        where = np.empty(len(place), np.int64)
        where[place] = np.arange(len(place))
        nodes = np.array(nodes, np.int64)
        nodes[:, 2] = where[nodes[:, 2]]
        return cls(ids[place], rows[place], nodes, np.array(bounds))

    def packed(self) -> bytes:
        most = int(np.abs(self.rows).max()) if self.rows.size else 0
        kind = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        return struct.pack("<iiii", *self.rows.shape, len(self.nodes), kind) + self.ids.tobytes() + self.rows.astype(f"<i{kind}").tobytes() + self.nodes.tobytes() + self.bounds.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        n, width, nodes, kind = struct.unpack_from("<iiii", data)
        at, parts = 16, []
        for dtype, count in (("<i8", n), (f"<i{kind}", n * width), ("<i8", nodes * 4), ("<f8", nodes * 2)):
            parts.append(np.frombuffer(data, dtype, count, at))
            at += parts[-1].nbytes
        return cls(parts[0], parts[1].reshape(n, width).astype(np.int64), parts[2].reshape(-1, 4), parts[3].reshape(-1, 2))

    def search(self, q: np.ndarray, windows: list[dict], most: int, space: Space, skip: int) -> list[list[tuple[int, int]]]:
        """For each window the first (-score, id) of its rows, nearest first.

        A window has the scores lo and hi (None: open), and kth: a score that `most` rows are known to reach. Its search ends at the first
        node that is farther away than the score of the last row needed.
        """
        squares, exact = float(q @ q), float(q @ q) * space.m2 < 2.0**104
        rows, point = (self._floats, q.astype(np.float64)) if exact else (self.rows, q)
        far = lambda s: max(0.0, squares + space.m2 - 2.0 * s) ** 0.5
        pivots = {int(k): None for k in np.flatnonzero(self.nodes[:, 3])}
        if pivots:
            to = np.sqrt(np.maximum(0.0, squares + space.m2 - 2.0 * (self._floats[self.nodes[list(pivots), 2]] @ q)))
            pivots = dict(zip(pivots, to.tolist(), strict=True))
        seen: dict[int, np.ndarray] = {}
        out = []
        for w in windows:
            inner = 0.0 if w["hi"] is None else far(w["hi"]) - space.margin
            outer = np.inf if w["lo"] is None else far(w["lo"]) + space.margin
            if w["kth"] is not None:
                outer = min(outer, far(w["kth"]) + space.margin)
            best, heap = [], [(0.0, 0)]
            while heap:
                least, k = heapq.heappop(heap)
                if least > outer:
                    break
                a, b, _, child = self._nodes[k]
                if child:
                    d = pivots[k]
                    for c in (child, child + 1):
                        lo, hi = self._bounds[c]
                        nearest = max(least, d - hi, lo - d, inner)
                        if d + hi >= inner and nearest <= outer + space.margin:
                            heapq.heappush(heap, (nearest, c))
                    continue
                if k not in seen:
                    seen[k] = rows[a:b] @ point
                s = seen[k]
                ok = np.ones(b - a, bool) if w["hi"] is None else s <= w["hi"]
                if w["lo"] is not None:
                    ok &= s >= w["lo"]
                if len(best) == most:
                    ok &= s >= -best[-1][0]
                found = np.flatnonzero(ok)
                if len(found):
                    best += [x for x in zip((-s[found]).astype(np.int64).tolist(), self.ids[a + found].tolist(), strict=True) if x[1] != skip]
                    best = heapq.nsmallest(most, best)
                    if len(best) == most:
                        outer = min(outer, far(-best[-1][0]) + space.margin)
            out.append(best)
        return out

    def ready(self) -> Tree:
        self._floats, self._nodes, self._bounds = self.rows.astype(np.float64), self.nodes.tolist(), self.bounds.tolist()
        return self


@dataclass(frozen=True)
class Index:
    """blocks: (label, leaf, part, data); low and high: of the distances of each leaf's rows to the pivots on its way."""

    space: Space
    blocks: DataFrame
    width: int
    low: np.ndarray
    high: np.ndarray


def points_of(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): a row for each key with a label and finite components, which become floor(scale * x); of rows of one key the least."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    kept = rows.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).alias("label"), whole.alias("v")).alias("row"))
    return kept.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def build_index(points: DataFrame) -> Index:
    """Every row of a written table (id, label, v) in blocks. Rows of equal vectors and labels share a cell, whose blocks hold BLOCK_ROWS of them (BLOCK_NUMBERS components) or fewer, about, dealt by hash."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, m2, width = points.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    n, m2, width = n, float(m2 or 0.0), max(1, width or 0)
    in_sample, in_block = max(1, min(SAMPLE, SAMPLE_NUMBERS // width)), max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width))
    if m2 >= 2.0**55:
        raise ValueError("components are too large: windows of scores would not fit 64 bits")
    depth = max(0, min(n // LEAF_ROWS, LEAVES).bit_length() - 1)
    space = Space(m2, np.zeros((0, width + 1)), np.zeros(0))
    if depth:
        some = points.where(F.xxhash64("id").bitwiseAND(0xFFFFFFFF) < F.lit(int(min(1.0, in_sample / n) * 2**32))).limit(2 * in_sample).select("v").toArrow()["v"].combine_chunks()
        space = fit_space(vectors(some, width).astype(np.float64), m2, depth, width)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, far = space.leaves(vectors(b["v"], width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["v"], pa.array(leaves), pa.array(list(far), pa.list_(pa.float64()))], ["id", "label", "v", "leaf", "far"])

    kind = points.schema["label"].dataType.simpleString()
    placed = points.mapInArrow(leaf, f"id long, label {kind}, v array<long>, leaf long, far array<double>")
    sides = [f(F.get("far", F.lit(k))).alias(f"{name}{k}") for k in range(depth) for f, name in ((F.min, "low"), (F.max, "high"))]
    cells = written(placed.groupBy("label", "leaf").agg(F.count("*").alias("n"), *sides), "negatives-cells")
    low, high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
    # as many rows as leaves
    for r in cells.groupBy("leaf").agg(*(f(f"{name}{k}").alias(f"{name}{k}") for k in range(depth) for f, name in ((F.min, "low"), (F.max, "high"))), F.count("*")).collect():
        low[r["leaf"]], high[r["leaf"]] = [r[f"low{k}"] for k in range(depth)], [r[f"high{k}"] for k in range(depth)]
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / in_block))
    dealt = placed.drop("far").join(cells.select("label", "leaf", "n"), ["label", "leaf"]).withColumn("part", part).select("label", "leaf", "part", "id", "v")

    def build(rows: pa.Table) -> pa.Table:
        one = rows.combine_chunks()
        tree = Tree.of(one["id"].to_numpy(), vectors(one["v"].combine_chunks(), width), space)
        return pa.table({"label": one["label"][:1], "leaf": one["leaf"][:1], "part": one["part"][:1], "data": pa.array([tree.packed()])})

    blocks = dealt.groupBy("label", "leaf", "part").applyInArrow(build, f"label {kind}, leaf long, part long, data binary")
    return Index(space, written(blocks, "negatives-blocks"), width, low, high)


WINDOW = "array<struct<key: long, lo: long, hi: long, kth: long>>"


def nearest(index: Index, asked: DataFrame, same_label: bool, most: int, near: bool) -> DataFrame:
    """(anchor, key, score, id): for each window of each anchor what the visited blocks have to offer, `most` rows of each at most.

    asked: (anchor, label, v, windows). near: visits the NEAR leaves that are nearest to the windows, else all others that may hold a row of them.
    """
    space, width, low, high = index.space, index.width, index.low, index.high
    ways = np.array([[((leaf + len(space.splits) + 1) >> (space.depth - k)) - 1 for k in range(space.depth)] for leaf in range(len(low))], np.int64).reshape(len(low), space.depth)
    kind = asked.schema["label"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, chosen = vectors(b["v"], width).astype(np.float64), []
            squares = np.einsum("ij,ij->i", v, v) + space.m2
            for i, windows in enumerate(b["windows"].to_pylist()):
                d = np.sqrt(np.maximum(0.0, squares[i] - 2.0 * (space.pivots[:, :-1] @ v[i])))[ways]
                least = np.maximum(0.0, np.maximum(d - high, low - d).max(1, initial=0.0))
                most_far = (d + high).min(1, initial=np.inf)
                far = lambda s, i=i: max(0.0, squares[i] - 2.0 * s) ** 0.5
                by, ok = np.full(len(low), np.inf), np.zeros(len(low), bool)
                for w in windows:
                    inner, outer = (0.0 if w["hi"] is None else far(w["hi"])), min(np.inf if w["lo"] is None else far(w["lo"]), np.inf if w["kth"] is None or near else far(w["kth"]))
                    ok |= (most_far >= inner - space.margin) & (least <= outer + space.margin)
                    by = np.minimum(by, np.maximum(least, inner))
                # the order of the leaves doesn't depend on what is known by now: near and far ones are told apart alike
                order = np.argsort(by, kind="stable")
                taken = order[:NEAR] if near else order[NEAR:]
                chosen.append([int(x) for x in taken if ok[x]])
            n = [len(x) for x in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["anchor"].to_numpy(), n), pa.int64()), pa.array([x for c in chosen for x in c], pa.int64())], ["anchor", "leaf"])

    ways_of = asked.mapInArrow(route, "anchor long, leaf long").join(asked.select("anchor", F.col("label").alias("own")), "anchor")
    visited = ways_of.join(index.blocks.select("label", "leaf", "part"), "leaf").where(F.col("own") == F.col("label") if same_label else F.col("own") != F.col("label"))
    batches = -(-asked.count() // BATCH)
    batch = F.pmod(F.xxhash64("anchor"), F.lit(max(1, batches)))
    together = visited.join(asked.select("anchor", "v", "windows"), "anchor").groupBy("label", "leaf", "part", batch.alias("batch")).agg(F.collect_list(F.struct("anchor", "v", "windows")).alias("asked"))
    joined = index.blocks.join(together, ["label", "leaf", "part"]).select("data", "asked")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                tree, out = Tree.unpacked(b["data"][r].as_py()).ready(), []
                for x in b["asked"][r].as_py():
                    q = np.zeros(width, np.int64)
                    q[: len(x["v"])] = x["v"]
                    for w, found in zip(x["windows"], tree.search(q, x["windows"], most, space, x["anchor"]), strict=True):
                        out += [(x["anchor"], w["key"], -s, i) for s, i in found]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "key", "score", "id"])

    return joined.mapInArrow(search, "anchor long, key long, score long, id long")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """found with rank: of each window the `most` best, equal scores by id."""
    rank = F.row_number().over(W.Window.partitionBy("anchor", "key").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def best(index: Index, asked: DataFrame, same_label: bool, most: int, name: str) -> DataFrame:
    """The `most` best rows of each window, over the whole index: near leaves first, then all that may hold a better row than those found."""
    found = written(first_of(nearest(index, asked, same_label, most, near=True), most), f"{name}-near")
    if len(index.low) <= NEAR:
        return found
    known = found.where(F.col("rank") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("known"))
    kth = lambda w: F.struct(w["key"].alias("key"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.try_element_at("known", w["key"]).alias("kth"))
    again = written(asked.join(known, "anchor", "left").withColumn("windows", F.transform("windows", kth)).drop("known"), f"{name}-asked")
    return first_of(found.drop("rank").unionByName(nearest(index, again, same_label, most, near=False)), most)


def mine_negatives(rows: DataFrame, key: str, vector: str, label: str, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors: rows for which `anchors`, a condition on `id`, holds.

    An anchor's positives are its best other rows of the same label; a positive's negatives the best rows of other labels whose score is
    from window[0] to window[1] hundredths of the positive's. Equal scores go by smaller key. Rows with a null key, label, vector or
    component, or one that isn't finite, take no part; of rows of one key the one with the least label and vector does.
    Short vectors are filled up with zeros; further columns aren't read. An anchor without positives, or positives without
    negatives (as those of scores below 0), give no rows. Vectors whose squared length passes 2^55 are an error.
    """
    points = written(points_of(rows, key, vector, label, scale), "negatives-points")
    index = build_index(points)
    none = F.lit(None).cast("long")
    asked = points.where(anchors).select(F.col("id").alias("anchor"), "label", "v")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("key"), none.alias("lo"), none.alias("hi"), none.alias("kth")))
    own = written(best(index, asked.withColumn("windows", whole), True, positives, "positives").select("anchor", F.col("id").alias("key"), "score"), "positives")
    low, high = window
    s = F.col("score")
    lo, hi = F.expr(f"(score * {low} + 99) div 100"), F.expr(f"(score * {high}) div 100")
    windows = own.where((s >= 0) & (lo <= hi)).groupBy("anchor").agg(F.collect_list(F.struct("key", lo.alias("lo"), hi.alias("hi"), none.alias("kth"))).alias("windows"))
    wrong = best(index, written(asked.join(windows, "anchor"), "negatives-asked"), False, negatives, "negatives")
    out = wrong.withColumnRenamed("score", "negative_score").join(own, ["anchor", "key"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")

"""Blocks of documents, and questions about the whole corpus that blocks ask in packed messages.

A block holds a few megabytes of whole texts in one row. A task that scans a block gathers the
hashes it has to ask about, sorted, and sends each hash bucket one message with all of its hashes.
A bucket's task sees every message for its range of hashes and answers each in the same order, a
few bits per hash. So a shuffle moves a few bytes for each distinct hash of a block, a frequent
hash weighs as much as a rare one, and no task holds more than its bucket. Empty messages
aren't sent: there are never more messages than hashes, so at any size the work is in proportion to the
distinct hashes of blocks.

Keys may be of any type that Spark sorts. Blocks of one key column's whole numbers carry these as ranks; other keys get ranks by one sort of the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sizes_of, slices, text_bytes, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 8 << 20
#: Bytes of text for each stored bucket of blocks, which one task reads.
STORED_BYTES = 64 << 20
#: The rank of null keys, after all others.
LAST = 2**64 - 1
WHOLE = ("tinyint", "smallint", "int", "bigint")


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as the least of them (ascending: as steps) and as few bits for each as the greatest difference needs."""
    values = np.ascontiguousarray(values, np.uint64)
    least = values.min() if len(values) else np.uint64(0)
    values = np.diff(values, prepend=least) if ascending else values - least
    width = max(1, int(values.max() if len(values) else 0).bit_length())
    # bits are taken from one row of bytes: row by row of a table takes many times as long
    size = (width + 7) // 8
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8)[:, :size].ravel(), bitorder="little").reshape(-1, 8 * size)[:, :width]
    return bytes([width, ascending]) + len(values).to_bytes(6, "little") + int(least).to_bytes(8, "little") + np.packbits(bits.ravel()).tobytes()


def packed_size(data: bytes) -> int:
    """Bytes of the packed array that data starts with."""
    return 16 + (data[0] * int.from_bytes(data[2:8], "little") + 7) // 8


def unpack(data: bytes) -> np.ndarray:
    width, count = data[0], int.from_bytes(data[2:8], "little")
    raw = np.frombuffer(data, np.uint8, offset=16) if len(data) > 16 else np.empty(0, np.uint8)
    size = (width + 7) // 8
    bits = np.zeros((count, 8 * size), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=width * count).reshape(count, width)
    whole = np.zeros((count, 8), np.uint8)
    whole[:, :size] = np.packbits(bits.ravel(), bitorder="little").reshape(count, size)
    out = whole.view(np.uint64).ravel()
    out = np.cumsum(out, dtype=np.uint64) if data[1] else out
    return out + np.uint64(int.from_bytes(data[8:16], "little"))


def pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool)


class Block:
    """The documents of a block in order of rank, their bytes end to end."""

    def __init__(self, row: dict):
        self.keys, self.ranks, self.lengths = row["keys"], np.frombuffer(row["ranks"], np.uint64), np.frombuffer(row["lengths"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths


def rows_of(batches) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(i)[k] for i, n in enumerate(b.schema.names)}
            yield {n: v.values if n == "keys" else v.as_py() for n, v in row.items()}


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with __rank, by which rows are ordered as by their keys; null for null keys, and null everywhere if keys are whole numbers."""
    if df.schema[key].dataType.simpleString() in WHOLE:
        return df.withColumn("__rank", F.lit(None).cast("long"))
    keys = df.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct().orderBy("__key")
    ranks = written(keys.withColumn("__rank", F.monotonically_increasing_id()), "key-ranks")
    return df.join(ranks, df[key] == ranks["__key"], "left").drop("__key")


def as_blocks(df: DataFrame, key: str, text: str, block_bytes: int | None = None) -> DataFrame:
    """Blocks of neighbouring rows. Null texts are empty; null keys come last."""
    kind = df.schema[key].dataType.simpleString()
    whole, most = kind in WHOLE, block_bytes or BLOCK_BYTES

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            keys = b.column(0)
            given = keys if whole else b.column(2)
            ranks = np.array(given.cast(pa.int64()).fill_null(0)).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            ranks = np.where(np.array(keys.is_valid()), ranks, np.uint64(LAST))
            for i, j in slices(sizes_of(b.column(1)), most):
                data = text_bytes(b.column(1)[i:j])
                order = np.argsort(ranks[i:j], kind="stable")
                lengths = np.array([len(data[k]) for k in order], np.int64)
                own = keys[i:j].take(pa.array(order))
                row = [
                    pa.array([part << 32 | at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), own), pa.array([ranks[i:j][order].tobytes()], pa.binary()),
                    pa.array([lengths.tobytes()], pa.binary()), pa.array([b"".join(data[k] for k in order)], pa.binary()),
                ]
                at += 1
                yield pa.RecordBatch.from_arrays(row, ["block", "keys", "ranks", "lengths", "data"])

    return ranked(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(run, f"block long, keys array<{kind}>, ranks binary, lengths binary, data binary")


def stored_blocks(blocks: DataFrame, text_size: int) -> DataFrame:
    """Blocks in a table bucketed by block, so that answers come to the blocks and no text is shuffled.

    The table stays in the warehouse as long as results may be read from it (see drop_stored_blocks).
    """
    spark = blocks.sparkSession
    name = f"tessera_blocks_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_size // STORED_BYTES)
    blocks.write.format("parquet").option("compression", "zstd").bucketBy(min(parts, 50_000), "block").saveAsTable(name)
    return spark.table(name)


def drop_stored_blocks(result: DataFrame) -> None:
    """Drops the tables of blocks that a result is read from; it must have been written or collected."""
    spark = result.sparkSession
    for name in {f.partition("tessera_blocks_")[2].partition("/")[0] for f in result.inputFiles() if "tessera_blocks_" in f}:
        spark.sql(f"DROP TABLE IF EXISTS tessera_blocks_{name}")


def settled(result: DataFrame, name: str) -> DataFrame:
    """The result, written; the tables of blocks that it was read from are dropped. For narrow results: they are computed at once."""
    out = written(result, name)
    drop_stored_blocks(result)
    return out


def bucket_bits(text_size: int) -> int:
    return max(4, (max(1, text_size // BUCKET_BYTES) - 1).bit_length())


def messages(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its part) of sorted 64-bit hashes, without empty ones."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def low(keys: np.ndarray, bits: int, width: int = 8) -> np.ndarray:
    """What a bucket can't tell from its number: the next bits of each hash, width bytes at most."""
    rest = keys << np.uint64(bits)
    return rest >> np.uint64(max(bits, 64 - 8 * width))


NOTE = "bucket int, block long, keys binary, extra binary"


def notes(rows: Sequence[tuple]) -> pa.RecordBatch:
    bucket, block, keys, extra = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(keys, pa.binary()), pa.array(extra, pa.binary())], ["bucket", "block", "keys", "extra"])


def answered(asked: DataFrame, answer: Callable[[list[np.ndarray], list[bytes | None], np.ndarray], list[bytes]], states: bool = True) -> DataFrame:
    """(bucket, block, keys, extra) with keys the answer of each message. Buckets are from 0; with states, rows below stay as they are.

    answer: gets the messages' keys, their extras and blocks; gives one value for each message.
    """

    def run(group):
        table = group.combine_chunks() if isinstance(group, pa.Table) else group
        out = answer([unpack(x) for x in table["keys"].to_pylist()], table["extra"].to_pylist(), np.array(table["block"]))
        return pa.table({"bucket": table["bucket"].cast(pa.int32()), "block": table["block"], "keys": pa.array(out, pa.binary()), "extra": pa.nulls(len(out), pa.binary())})

    if not states:
        return asked.groupBy("bucket").applyInArrow(run, NOTE)
    return asked.where("bucket >= 0").groupBy("bucket").applyInArrow(run, NOTE).unionByName(asked.where("bucket < 0"))


def with_notes(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with the notes that came for them: array of (bucket, keys, extra)."""
    lists = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "keys", "extra"))).alias("notes"))
    return blocks.join(lists, "block", "left")


def elsewhere(keys: list[np.ndarray], extra: list[bytes | None], block: np.ndarray) -> list[bytes]:
    """Whether each hash is in another message too, as bits."""
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    out = np.zeros(len(flat), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return [pack_bits(x) for x in np.split(out, np.cumsum(sizes)[:-1])]


def earlier(keys: list[np.ndarray], extra: list[bytes | None], block: np.ndarray) -> list[bytes]:
    """Whether a message has each hash at an earlier rank (in extra), or at the same rank in an earlier block, as bits."""
    sizes = np.array([len(k) for k in keys])
    flat, ranks = np.concatenate(keys), np.concatenate([unpack(x) for x in extra])
    order = np.lexsort((np.repeat(block, sizes), ranks, flat))
    out = np.zeros(len(flat), bool)
    out[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    return [pack_bits(x) for x in np.split(out, np.cumsum(sizes)[:-1])]

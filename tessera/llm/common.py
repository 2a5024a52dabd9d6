"""What the training-data operators share: tables, shared storage, word and slice helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as bytes.split() finds it: no space and no U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one; on a cluster that is an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote; only for a table that nothing reads any more."""
    spark = df.sparkSession
    for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Parts that the rows of one hot key are dealt into before a join.
SALTS = 64


def spread_join(rows: DataFrame, side: DataFrame, on: str, item: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each `on`, without any task that gets all rows of a hot key.

    Rows are dealt by `item` into SALTS parts of their key; each part's key is joined first, then the
    rows by key and part. No task of either join has more than a part, or SALTS keys, of one key.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(SALTS)))
    parts = dealt.select(on, "_salt").distinct().join(side, on, how)
    return dealt.join(parts, [on, "_salt"], how).drop("_salt")


#: Rows of a key beyond which with_total() broadcasts what it has for the key.
HOT = 1024


def with_total(rows: DataFrame, on: str, total, name: str) -> DataFrame:
    """rows with an aggregate over all rows of the same `on`, without any task that gets all rows of a hot key.

    Rows of hot keys get theirs where they stand: at most one key in HOT rows is broadcast. The others are joined by key. Rows with a null key go.
    """
    whole = rows.groupBy(on).agg(total.alias(name), F.count("*").alias("_rows"))
    hot = whole.where(F.col("_rows") > HOT).select(on, F.col(name).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(whole.drop("_rows"), on)
    return cold.unionByName(marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", name))


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to at most `most`; a longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def sizes_of(column: pa.Array) -> list[int]:
    """Bytes of each value; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at once; their powers are kept.
STEP = 1 << 16
_UP, _DOWN = powers(BASE, STEP + 1), powers(INVERSE, STEP + 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[k] of the first k bytes, each times its power of BASE; string_hashes takes any string's hash from them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    total, up, mask = 0, 1, (1 << 64) - 1
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        n = len(part)
        own = sums[at + 1 : at + n + 1]
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=own)
        own *= np.uint64(up)
        own += np.uint64(total)
        total, up = int(own[-1]), up * int(_UP[n]) & mask
    return sums


def string_hashes(sums: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hashes of strings by their places and lengths, before mixing; equal strings have equal ones wherever they stand."""
    whole = powers(int(_DOWN[STEP]), len(sums) // STEP + 1)
    return (sums[at + length] - sums[at]) * _DOWN[at % STEP] * whole[at // STEP]


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a byte array; words end at 0x20 and 0x09-0x0D."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 32, (data < 9) | (data > 13), out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array. A word's hash doesn't depend on where it stands.

    The array is read in steps of STEP bytes, so beside it memory holds a few numbers for each word.
    """
    starts, ends = word_edges(data)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    # sums before each start and each end; factors that bring a start to place 0
    before, after, back = (np.empty(len(starts), np.uint64) for _ in range(3))
    total, up, down = 0, 1, 1
    mask = (1 << 64) - 1
    sums = np.zeros(STEP + 1, np.uint64)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        n = len(part)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1 : n + 1])
        a, b = np.searchsorted(starts, (at, at + n))
        own = starts[a:b] - at
        before[a:b] = sums[own] * np.uint64(up) + np.uint64(total)
        back[a:b] = _DOWN[own] * np.uint64(down)
        a, b = np.searchsorted(ends, (at + 1, at + n + 1))
        after[a:b] = sums[ends[a:b] - at] * np.uint64(up) + np.uint64(total)
        total = (total + int(sums[n]) * up) & mask
        up, down = up * int(_UP[n]) & mask, down * int(_DOWN[n]) & mask
    return starts, mix64((after - before) * back ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))

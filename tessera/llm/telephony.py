"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM, and resampled PCM.

A media column is a binary column that holds a whole WAV file. ``store_telephony`` packs bytes as
8-bit G.711 samples or as ADPCM blocks. ``expand_media`` parses stored files, expands them by lookup tables
(mu-law, A-law) or decodes their ADPCM blocks with numpy across blocks, and stores the resampled
16-bit PCM as a further column of WAV files, with what is read back from these. ``media_features`` reads the stored samples back.

Null samples and null files: null samples count as empty, and an empty input is padded to one block; a null file has null
results. A file that isn't mono WAV audio of a known format has a null PCM file and its format in `problem`.
Equal inputs give equal rows, so repeated rows repeat; ties don't occur. Columns beyond the key and the
samples are left out, whatever their names. A very long file is expanded and resampled piece by
piece: beside its own bytes and those of its result, a task holds one piece. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sizes_of, slices, text_bytes

RATE, PCM_RATE = 8000, 16000
#: Bytes of an ADPCM block, to which payloads are padded.
BLOCK = 192
PAD = 32
#: Stored bytes that a task holds at once beside its batch, and samples that are resampled at once.
SLICE, PIECE = 1 << 20, 1 << 18
# Format tags of WAV files.
PCM, A_LAW, MU_LAW, ADPCM = 1, 6, 7, 17

# The quantiser steps and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: the 16-bit sample of each byte."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: the 16-bit sample of each byte."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg, low = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(seg == 0, low, (low + 256) << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mulaw_table(), A_LAW: alaw_table()}


def adpcm_decode(blocks: np.ndarray) -> Iterator[np.ndarray]:
    """Samples of IMA ADPCM blocks (n x size bytes, mono), one position of all blocks at a time.

    A block starts with its first sample (int16) and step index; an index over 88 counts as 88.
    """
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0]
    now = head.astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    yield now
    for k in range(4, blocks.shape[1]):
        for nibble in (blocks[:, k] & 15, blocks[:, k] >> 4):
            code = (nibble & 7).astype(np.int32)
            # the bits of the code add step, step/2, step/4 on top of step/8, each cut to whole numbers
            step = STEPS[index]
            move = step >> 3
            move += (step >> 2) * (code & 1)
            move += (step >> 1) * ((code >> 1) & 1)
            move += step * (code >> 2)
            now = np.clip(now + np.where(nibble & 8, -move, move), -32768, 32767)
            index = np.clip(index + MOVES[code], 0, 88)
            yield now


def adpcm_samples(data: np.ndarray, block: int) -> np.ndarray:
    """All samples of ADPCM data in order; a last block that is cut short is decoded as far as it goes."""
    n = len(data) // block
    parts = []
    for at in range(0, n, max(1, PIECE // (2 * block))):
        whole = data[at * block : min(n, at + max(1, PIECE // (2 * block))) * block].reshape(-1, block)
        parts.append(np.stack([x.astype(np.int16) for x in adpcm_decode(whole)], 1).ravel())
    if len(data) - n * block >= 4:
        parts.append(np.concatenate([x.astype(np.int16) for x in adpcm_decode(data[n * block :].reshape(1, -1))]))
    return np.concatenate(parts) if parts else np.empty(0, np.int16)


def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed sinc at the lower of both rates; sums to `up`."""
    cut, n = 1 / max(up, down), half * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t * cut) * np.hanning(2 * n + 3)[1:-1]
    return h / h.sum() * up


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """16-bit PCM at up/down times its rate, piece by piece and filter phase by filter phase; ends count as silence."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return pcm.astype("<i2")
    h = lowpass(up, down)
    centre, n = len(h) // 2, len(pcm)
    total = -(-n * up // down)
    out = np.empty(total, "<i2")
    reach = centre // up + 1
    size = max(up, PIECE * up // down // up * up)
    for first in range(0, total, size):
        at = np.arange(first, min(total, first + size))
        # the samples that this piece's filter taps meet
        low = max(0, first * down // up - reach)
        x = pcm[low : min(n, (int(at[-1]) * down + centre) // up + 2)].astype(np.float64)
        piece = np.empty(len(at))
        place = at * down + centre
        for phase in range(up):
            own = np.flatnonzero(place % up == phase)
            if len(own):
                full = np.convolve(x, h[phase::up])
                where = (place[own] - phase) // up - low
                piece[own] = np.where(where < len(full), full[np.minimum(where, len(full) - 1)], 0.0)
        out[first : first + len(at)] = np.clip(np.rint(piece), -32768, 32767)
    return out


def wav(samples: bytes, tag: int, rate: int, bits: int = 8, block: int = 1, frames: int | None = None) -> bytes:
    """A mono WAV file. ADPCM data come in blocks; others are a whole number of samples."""
    width = block if tag == ADPCM else bits // 8
    frames = len(samples) // width if frames is None else frames
    second = rate * width if tag != ADPCM else rate * block // (2 * block - 7)
    more = struct.pack("<HH", 2, 2 * block - 7) if tag == ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, second, width, 4 if tag == ADPCM else bits) + more
    head = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", len(samples))
    odd = len(samples) & 1
    return b"".join((b"RIFF", struct.pack("<I", 4 + len(head) + len(samples) + odd), b"WAVE", head, samples, b"\0" * odd))


def parse_wav(media: bytes) -> tuple[int, int, int, int, bytes]:
    """(format tag, channels, rate, block size, sample bytes) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(media):
            tag, channels, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            form = tag, channels, rate, block
        elif name == b"data" and form:
            return (*form, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without format and data")


def samples_of(media: bytes) -> tuple[int, int, np.ndarray]:
    """(format tag, rate, 16-bit samples) of a stored mono file; ValueError for others."""
    tag, channels, rate, block, data = parse_wav(media)
    if channels != 1 or not rate:
        raise ValueError(f"{channels} channels at rate {rate}")
    raw = np.frombuffer(data, np.uint8)
    if tag in TABLES:
        return tag, rate, TABLES[tag][raw]
    if tag == ADPCM and block > 4:
        return tag, rate, adpcm_samples(raw, block)
    if tag == PCM and block == 2:
        return tag, rate, raw[: len(raw) // 2 * 2].view("<i2")
    if tag == PCM and block == 1:
        return tag, rate, ((raw.astype(np.int16) - 128) << 8).astype(np.int16)
    raise ValueError(f"format {tag} of {block} bytes")


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data.ljust(max(1, -(-len(data) // block)) * block, bytes([PAD]))


def store_telephony(df: DataFrame, key: str, samples: str, tag: int = MU_LAW) -> DataFrame:
    """(key, n_bytes, media): the bytes of `samples` (binary or text), padded to whole blocks, as WAV files of a telephony format."""
    if tag not in (MU_LAW, A_LAW, ADPCM):
        raise ValueError("tag: 7 (mu-law), 6 (A-law) or 17 (IMA ADPCM)")

    def stored(x: bytes) -> bytes:
        data = padded(x)
        return wav(data, tag, RATE, block=BLOCK, frames=len(data) // BLOCK * (2 * BLOCK - 7)) if tag == ADPCM else wav(data, tag, RATE)

    def pack(batches):
        for b in batches:
            for i, j in slices(sizes_of(b.column(1)), SLICE):
                data = text_bytes(b.column(1)[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(map(len, data), pa.int64()), pa.array([stored(x) for x in data], pa.binary())], ["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(samples).cast("binary").alias("media"))
    return out.mapInArrow(pack, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def expand_media(df: DataFrame, key: str, media: str = "media", rate: int = PCM_RATE) -> DataFrame:
    """df with `pcm`, each stored file resampled to 16-bit PCM at `rate` as a WAV file, `problem`, null where that could be done, and size, digest and levels of the PCM files as read back."""
    added = ("pcm", "problem", "pcm_bytes", "pcm_sha256", "pcm_levels")
    names = [c for c in df.columns if c not in added]
    at = names.index(media)

    def expand(batches):
        for b in batches:
            for i, j in slices(sizes_of(b.column(at)), SLICE):
                pcm, problem = [], []
                for x in b.column(at)[i:j].to_pylist():
                    made, why = None, None
                    if x is not None:
                        try:
                            _, own, samples = samples_of(x)
                            made = wav(resample(samples, rate, own).tobytes(), PCM, rate, 16)
                        except ValueError as e:
                            why = str(e)
                    pcm.append(made)
                    problem.append(why)
                back = [None if x is None else f"{levels('pcm', samples_of(x)[2])} pcm_crc={zlib.crc32(x):08x}" for x in pcm]
                sizes = [None if x is None else len(x) for x in pcm]
                made = [pa.array(pcm, pa.binary()), pa.array(problem, pa.string()), pa.array(sizes, pa.int64()), pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in pcm], pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in b.columns), *made], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names).mapInArrow(expand, f"{schema}, pcm binary, problem string, pcm_bytes long, pcm_sha256 string, pcm_levels string")


def blocks_summary(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, greatest) of the absolute samples of whole ADPCM blocks laid end to end, for each run of blocks that starts at `starts`."""
    blocks = data.reshape(-1, BLOCK)
    energy, peak = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int32)
    for at in range(0, len(blocks), PIECE // BLOCK):
        own = slice(at, at + PIECE // BLOCK)
        for now in adpcm_decode(blocks[own]):
            size = np.abs(now)
            energy[own] += size
            np.maximum(peak[own], size, out=peak[own])
    return np.add.reduceat(energy, starts), np.maximum.reduceat(peak, starts)


def levels(name: str, pcm: np.ndarray) -> str:
    """Length, sum, energy, sign changes and peak of 16-bit samples."""
    total = square = flips = peak = 0
    for at in range(0, len(pcm), PIECE):
        x = pcm[max(0, at - 1) : at + PIECE]
        flips += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = pcm[at : at + PIECE]
        total, square, peak = total + int(x.sum(dtype=np.int64)), square + int(np.square(x, dtype=np.int64).sum()), max(peak, int(np.abs(x.astype(np.int32)).max()))
    return f"{name}_n={len(pcm)} {name}_sum={total} {name}_energy={square} {name}_flips={flips} {name}_peak={peak}"


def feature(tag: int, rate: int, payload: np.ndarray, adpcm: tuple[int, int], pcm: str | None) -> str:
    """A line on a stored file: levels of both laws' readings of its bytes, of their ADPCM reading, and of the stored PCM file."""
    return f"tag={tag} rate={rate} {levels('mu', TABLES[MU_LAW][payload])} {levels('a', TABLES[A_LAW][payload])} adpcm_abs={adpcm[0]} adpcm_peak={adpcm[1]} {pcm or 'pcm=none'}"


def media_features(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes, pcm_sha256) of expanded files.

    The payload is a file's sample bytes; for the ADPCM reading it counts as padded to whole blocks.
    """
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]
    sha = lambda x: hashlib.sha256(x).hexdigest() if x is not None else None

    def read(batches):
        for b in batches:
            for i, j in slices(sizes_of(b.column(2)), SLICE):
                files, back = b.column(2)[i:j].to_pylist(), b.column(5)[i:j].to_pylist()
                parts = [parse_wav(x) if x is not None else None for x in files]
                whole = [padded(x[4]) for x in parts if x is not None]
                starts = np.cumsum([0, *(len(x) // BLOCK for x in whole)])[:-1]
                energy, peak = blocks_summary(np.frombuffer(b"".join(whole), np.uint8), starts) if whole else ((), ())
                loud = iter(zip(map(int, energy), map(int, peak), strict=True))
                lines = [feature(x[0], x[2], np.frombuffer(x[4], np.uint8), next(loud), y) if x is not None else None for x, y in zip(parts, back, strict=True)]
                data = [x[4] if x is not None else None for x in parts]
                size = lambda xs: pa.array([len(x) if x is not None else None for x in xs], pa.int64())
                columns = [
                    b.column(0)[i:j], b.column(1)[i:j], size(data), pa.array(map(sha, data), pa.string()), pa.array([zlib.crc32(x[-16:]) if x is not None else None for x in data], pa.int64()),
                    size(files), pa.array(map(sha, files), pa.string()), pa.array(lines, pa.string()), b.column(3)[i:j], b.column(4)[i:j],
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return df.select(F.col(key).alias("key"), "n_bytes", media, "pcm_bytes", "pcm_sha256", "pcm_levels").mapInArrow(read, schema).withColumnRenamed("key", key)

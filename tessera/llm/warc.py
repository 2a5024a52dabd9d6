"""WARC archives compressed as Zstandard frames, one for each record, after a frame that holds their dictionary.

write_archives() makes a table of archives (archive, content) from a table of pages, read_archives() makes records of such a
table, load_archives() one of files. Executors share no disks, so archives are binary values, of some ARCHIVE_BYTES of payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, text_bytes

#: Payload bytes after which an archive is closed; a larger payload has an archive of its own.
ARCHIVE_BYTES = 8 << 20
#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
VERSIONS = ("WARC/1.0", "WARC/1.1")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-row:"
RECORDS = "archive string, position int, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, payload: str, max_rows: int = 1000, max_bytes: int = 8192, size: int = 65536) -> bytes:
    """A dictionary from the beginnings (max_bytes) of some max_rows payloads, taken by hash; no bytes where they are too few to train on."""
    n = pages.count()
    rows = pages.where(F.xxhash64(payload).bitwiseAND(0xFFFFFFFF) < F.lit(int(min(1.0, max_rows / max(n, 1)) * 2**32))).limit(2 * max_rows)
    samples = [bytes(x[0]) for x in rows.select(F.substring(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 1, max_bytes)).collect()]
    try:
        return zstandard.train_dictionary(size, [x for x in samples if x]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(kind: str, name: str, date: str, block: bytes, **fields: str | None) -> bytes:
    """A record's bytes; fields are further headers, their names with _ for -."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": date} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def http(size: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload


def uri_of(url: str | None) -> str:
    """A header's value: white space and controls are escaped; null is about:blank."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), url) if url else "about:blank"


def name_of(key: str | None) -> str | None:
    return None if key is None else RECORD + quote(key, safe="")


def with_first(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, url, payload, digest, first): first is the (key, url) of the row with the least key of all with an equal payload, null for payloads under min_bytes."""
    text = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text.alias("payload"), F.sha1(text).alias("digest"))
    least = rows.where(F.col("key").isNotNull() & (F.octet_length("payload") >= min_bytes)).groupBy("digest").agg(F.min(F.struct("key", "url")).alias("first"))
    return spread_join(rows, least, "digest", "key", "left")


def write_archives(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", dictionary: bytes | None = None) -> DataFrame:
    """(archive, content): each row of pages as a record, its payload as UTF-8 in an HTTP response.

    Of the rows with equal payloads of min_bytes or more, that with the least key is a response; the others are revisits
    that name it and carry no payload. Equal payloads of one key are all responses, as are those of rows without a key where
    no row with a key has their payload. Null payloads are empty, null urls about:blank. Without rows there are no archives.
    dictionary: by default train_dictionary's; no bytes: none.
    """
    trained = train_dictionary(pages, payload) if dictionary is None else dictionary
    rows = with_first(pages, key, url, payload, min_bytes).select(F.col("key").cast("string").alias("key"), "url", "payload", F.when(F.col("first.key") != F.col("key"), F.col("first.key").cast("string")).when(F.col("key").isNull(), F.col("first.key").cast("string")).alias("refers"), F.col("first.url").alias("refers_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        if known:
            known.precompute_compress(level=3)
        compress = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True).compress
        lead = b""
        if trained:
            packed = zstandard.compress(trained)
            lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        task, n, held, frames = TaskContext.get().partitionId(), 0, 0, []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": f"{task:06d}-{n:06d}.warc.zst", "content": lead + b"".join(frames)}], pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        unnamed = lambda: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{task}-{n}-{len(frames)}')}"
        for batch in batches:
            for k, link, data, refers, refers_url in zip(batch["key"].to_pylist(), batch["url"].to_pylist(), text_bytes(batch["payload"]), batch["refers"].to_pylist(), batch["refers_url"].to_pylist(), strict=True):
                if not frames:
                    frames.append(compress(record("warcinfo", unnamed(), date, b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")))
                common = {"WARC_Target_URI": uri_of(link), "WARC_Payload_Digest": f"sha1:{base32_sha1(data)}", "Content_Type": "application/http; msgtype=response"}
                if refers is None:
                    whole = record("response", name_of(k) or unnamed(), date, http(len(data), data), **common)
                else:
                    whole = record("revisit", name_of(k) or unnamed(), date, http(len(data), b""), WARC_Profile=IDENTICAL, WARC_Refers_To=f"<{name_of(refers)}>", WARC_Refers_To_Target_URI=uri_of(refers_url), WARC_Refers_To_Date=date, **common)
                frames.append(compress(whole))
                held += len(whole)
                if held >= ARCHIVE_BYTES:
                    yield closed()
                    n, held, frames = n + 1, 0, []
        if frames:
            yield closed()

    return rows.mapInArrow(write, "archive string, content binary")


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """The table of archives of files; a file of over 2 GB doesn't fit a row."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, from the sizes of its blocks."""
    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    last = 0
    while not last:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        end += 3 + (1 if kind == 1 else block >> 3)
    end += 4 * zstandard.get_frame_parameters(head).has_checksum
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record, problem) of each frame but the skippable ones; the first of these may hold the dictionary. After a frame without an end there is no other."""
    data, at, known = memoryview(content), 0, None
    while at < len(data):
        try:
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE_FRAMES:
                if at + 8 + size > len(data):
                    raise ValueError("a frame is cut off")
                if at == 0 and magic == DICTIONARY_FRAME:
                    held = bytes(data[8 : 8 + size])
                    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == ZSTD_FRAME.to_bytes(4, "little") else held)
                at += 8 + size
                continue
            end = frame_end(data, at)
        except (ValueError, struct.error, zstandard.ZstdError) as e:
            yield b"", f"no frame at byte {at}: {e}"
            return
        try:
            yield zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at:end]), None
        except zstandard.ZstdError as e:
            yield b"", f"the frame at byte {at} can't be decoded: {e}"
        at = end


def head_of(data: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name (of equal names the first), and where what follows them begins."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers have no end")
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    named: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"no header: {x[:40]!r}")
        named.setdefault(name.strip().lower(), value.strip())
    return first, named, end + 4


def length_of(named: dict[str, str]) -> int:
    value = named.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", value):
        raise ValueError(f"no length: {value[:40]!r}")
    return int(value)


def row_of(name: str | None) -> str | None:
    name = (name or "").strip("<>")
    return unquote(name.removeprefix(RECORD)) if name.startswith(RECORD) else name or None


def parse(data: bytes) -> dict:
    """A record's columns, its headers, lengths and payload digest validated; ValueError says what is wrong."""
    version, named, at = head_of(data)
    if version not in VERSIONS:
        raise ValueError(f"no version: {version[:40]!r}")
    if gone := [x for x in ("warc-type", "warc-record-id", "warc-date") if not named.get(x)]:
        raise ValueError(f"no {', '.join(gone)}")
    size = length_of(named)
    if len(data) != at + size + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError(f"{size} bytes said, {len(data) - at - 4} found")
    kind, body, digest = named["warc-type"], data[at : at + size], named.get("warc-payload-digest", "")
    out = {"record_type": kind, "record_id": row_of(named["warc-record-id"]), "uri": named.get("warc-target-uri"), "refers_to": row_of(named.get("warc-refers-to"))}
    whole = len(body)
    if named.get("content-type", "").startswith("application/http") and kind in ("response", "revisit"):
        _, inner, start = head_of(body)
        body = body[start:]
        whole = length_of(inner) if "content-length" in inner else len(body)
        if kind == "response" and whole != len(body):
            raise ValueError(f"{whole} bytes of payload said, {len(body)} found")
    if kind == "revisit" and not (digest or out["refers_to"]):
        raise ValueError("a revisit of nothing")
    own = base32_sha1(body)
    if kind != "revisit" and digest.startswith("sha1:") and digest[5:].upper() != own:
        raise ValueError(f"digest {digest[5:45]} said, {own} found")
    return out | {"payload_bytes": whole, "payload_digest": (digest.removeprefix("sha1:") if kind == "revisit" else own).upper(), "payload": body}


def read_archives(archives: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of a table (archive, content), in the order of their positions: RECORDS.

    record_id and refers_to are write_archives's keys, or other writers' identifiers. payload_bytes and payload_digest (base32
    SHA-1) are of the full payload, also of revisits, which carry none. A record that isn't valid is an error, or where
    strict is false a row with its problem and nulls. Null and empty archives have no records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("archive", pa.string()), ("position", pa.int32()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows, held = batch["archive"][k].as_py(), [], 0
                for position, (data, problem) in enumerate(frames(text_bytes(batch["content"].slice(k, 1))[0])):
                    row = {"archive": name, "position": position}
                    try:
                        row |= parse(data) if problem is None else {"problem": problem}
                    except ValueError as e:
                        row["problem"] = str(e)
                    if strict and row.get("problem"):
                        raise ValueError(f"{name}, record {position}: {row['problem']}")
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(data) if payloads else 200
                    if held >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    return archives.select("archive", "content").mapInArrow(read, RECORDS)

"""A sink of whole files: rows (page_id, name, content) become files of a folder for each page.

df.write.format("page_files").mode("append").save(folder), after register(). A page's rows must stand together in one partition, as together() puts
them. A task writes a page into a staging folder beside the others and moves it to its place when its last row is in, so readers
see a page as it was or as it is now, never a part of it. What a task that fails or is killed leaves behind goes with the staging folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING, STALE = "_staging", timedelta(days=1)
#: A name of a page or a file; parts of a file's name may stand behind each other with /.
NAME = re.compile(r"(?!\.{1,2}(/|$))[^/\x00]+(/(?!\.{1,2}(/|$))[^/\x00]+)*")


@dataclass
class Written(WriterCommitMessage):
    pages: int
    files: int
    bytes: int


class PageFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def place(self) -> tuple[fs.FileSystem, str]:
        """The file system, and the folder's path in it."""
        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.folder))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self.place()
        own = f"{folder}/{STAGING}/{uuid.uuid4().hex}"
        out = Written(0, 0, 0)
        try:
            for page, rows in groupby(iterator, key=lambda r: r["page_id"]):
                if page is not None and (not NAME.fullmatch(page) or "/" in page or page.startswith("_")):
                    raise ValueError(f"no name of a page: {page!r}")
                staged = f"{own}/{hashlib.sha256((page or '').encode()).hexdigest()}"
                store.create_dir(staged)
                names = []
                for r in rows:
                    if not r["name"] or not NAME.fullmatch(r["name"]):
                        raise ValueError(f"no name of a file: {r['name']!r}")
                    if "/" in r["name"]:
                        store.create_dir(f"{staged}/{r['name'].rpartition('/')[0]}")
                    data = bytes(r["content"] or b"")
                    with store.open_output_stream(f"{staged}/{r['name']}") as f:
                        f.write(data)
                    names.append(r["name"])
                    out.files, out.bytes = out.files + 1, out.bytes + len(data)
                if page is None:  # files of the whole folder, each of them for itself
                    for name in names:
                        if "/" in name:
                            store.create_dir(f"{folder}/{name.rpartition('/')[0]}")
                        store.move(f"{staged}/{name}", f"{folder}/{name}")
                else:
                    final = f"{folder}/{page}"
                    if store.get_file_info(final).type != fs.FileType.NotFound:
                        store.move(final, f"{staged}-old")
                    store.move(staged, final)
                out.pages += page is not None
        finally:
            if store.get_file_info(own).type == fs.FileType.Directory:
                store.delete_dir(own)
        return out

    def clean(self) -> None:
        store, folder = self.place()
        staging = f"{folder}/{STAGING}"
        if store.get_file_info(staging).type != fs.FileType.Directory:
            return
        left = store.get_file_info(fs.FileSelector(staging))
        for found in left:
            if found.mtime is not None and datetime.now(UTC) - found.mtime > STALE:
                store.delete_dir(found.path)
        if not left:
            store.delete_dir(staging)

    def commit(self, messages: list[Written | None]) -> None:
        self.clean()

    def abort(self, messages: list[Written | None]) -> None:
        self.clean()


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if gone := {"page_id", "name", "content"} - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(gone)}")
        if overwrite:
            raise ValueError("pages replace pages of their names one by one; use append")
        return PageFilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def together(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(page_id string, name string, content binary), each page's rows together and in the order of their names."""
    rows = files.select(F.col("page_id").cast("string").alias("page_id"), F.col("name"), F.col("content").cast("binary").alias("content"))
    return (rows.repartition(partitions, "page_id") if partitions else rows.repartition("page_id")).sortWithinPartitions("page_id", "name")


def write_files(files: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Writes (page_id, name, content): pages into folder/page_id/name, rows without a page into folder/name. Of equal names the last counts.

    The folder must be one that all executors reach. A page that is written again is replaced as a whole; other pages stay.
    """
    register(files.sparkSession)
    together(files, partitions).write.format("page_files").mode("append").save(folder)

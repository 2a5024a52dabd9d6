"""From a folder of pages to a site: what is new or changed is found, synchronised, and written page by page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.citation import citation_html
from ..functions.text import stripped
from ..operators.quality import index_page, low_confidence_words
from ..sources import pages, responses, sinks
from ..sources.files import write_files
from .sync import sync_tables

#: Of a page's folder: what a recogniser answered.
RESPONSE = "response.json"
#: Below a site's folder: fingerprints of the pages that it was built from, rows of its index, and tables that a run is made from; all by run.
STATE, INDEX, WORK = "_state", "_index", "_work"


def fingerprints(found: DataFrame, hashed: DataFrame) -> DataFrame:
    """(page_id, fingerprint): of the names and hashes of a page's files. found: pages.files(); hashed: (path, hash).

    What is gathered for a page are a name and a hash of each file.
    """
    each = F.array_sort(F.collect_list(F.struct("name", "in_source", "hash")))
    return found.join(hashed, "path").groupBy("page_id").agg(F.sha2(F.to_json(each), 256).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Pages that aren't in `before` with the same fingerprint."""
    return now if before is None else now.join(before, ["page_id", "fingerprint"], "left_anti")


def last_state(spark: SparkSession, site: str) -> tuple[DataFrame | None, int]:
    """(page_id, fingerprint) as of each page's last build, and the number of the next run."""
    try:
        runs = spark.read.schema("page_id string, fingerprint string, run long").parquet(f"{site}/{STATE}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    last = runs.agg(F.max("run")).first()[0]
    return runs.groupBy("page_id").agg(F.max_by("fingerprint", "run").alias("fingerprint")), 0 if last is None else last + 1


@dataclass(frozen=True)
class Folder:
    """The files of a folder of pages: found (pages.files()), and their contents, read by their names where they are asked for."""

    spark: SparkSession
    path: str
    found: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Folder:
        return cls(spark, path, pages.files(spark, path))

    def only(self, chosen: DataFrame) -> Folder:
        """The files of the pages of `chosen`."""
        return Folder(self.spark, self.path, self.found.join(chosen.select("page_id"), "page_id", "left_semi"))

    def content(self, names: str = "*") -> DataFrame:
        """(path, length, modificationTime, content) of files whose names a glob matches; columns that aren't used aren't read."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(self.path)

    def fingerprints(self, by: str = "content") -> DataFrame:
        """fingerprints() by contents, or by "stamp": size and time of change, for which no file is read."""
        own = F.sha2("content", 256) if by == "content" else F.concat_ws("/", "length", F.unix_micros("modificationTime"))
        return fingerprints(self.found, self.content().select("path", own.alias("hash")))

    def texts(self, paths: DataFrame, names: str) -> DataFrame:
        """(page_id, text) of files (page_id, path), without white space at their ends."""
        return paths.join(self.content(names).select("path", "content"), "path").select("page_id", stripped(F.decode("content", "UTF-8")).alias("text"))

    def named(self, name: str) -> DataFrame:
        """(page_id, path) of each page's file of a name; its content folder's first."""
        return self.found.where(F.col("name") == name).groupBy("page_id").agg(F.max_by("path", F.struct("in_source", "path")).alias("path"))

    def citations(self) -> DataFrame:
        """(page_id, citation) as HTML; a page without a citation, or with a blank one, has no row."""
        return self.texts(self.named(pages.CITATION), pages.CITATION).where("text != ''").select("page_id", citation_html(F.col("text")).alias("citation"))


def site_tables(folder: Folder, reader: str = "plain", settings: Settings | None = None, kept: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """sync_tables() of a folder's pages with audio, a text and a recogniser's answer, and their header. reader: of responses.READERS."""
    own = pages.discover(folder.found).where("text IS NOT NULL")
    lines = pages.lines_of(folder.texts(own.select("page_id", F.col("text").alias("path")), "{" + ",".join(pages.TEXTS) + "}"))
    answers = folder.texts(folder.named(RESPONSE).join(own, "page_id", "left_semi"), RESPONSE).withColumnRenamed("text", "json")
    keep = kept or (lambda df, _: df)
    head, heard = responses.READERS[reader](keep(answers, "answers"))
    lines = keep(lines.join(head.select("page_id"), "page_id", "left_semi"), "lines")
    out = sync_tables(pages.ref_tokens(lines), heard, head.select("page_id", "duration"), settings=settings, kept=kept)
    texts = lines.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("full_text"))
    header = own.select("page_id", F.regexp_extract("audio", r"([^/]+)$", 1).alias("audio_file"), F.col("title").alias("named"), F.col("audio").alias("audio_path"))
    header = header.join(head.select("page_id", "duration"), "page_id").join(texts, "page_id").join(pages.title_lines(lines).select("page_id", "title"), "page_id", "left").join(folder.citations(), "page_id", "left")
    header = header.withColumn("title", F.coalesce("title", "named")).withColumn("language", F.lit((settings or Settings()).language)).drop("named")
    return out | {"header": keep(header, "header"), "quality": keep(out["quality"], "quality"), "issues": keep(out["issues"], "issues")}


def build(spark: SparkSession, content: str, site: str, reader: str = "plain", settings: Settings | None = None, bundled: bool = True, with_audio: bool = True, by: str = "content", overrides: DataFrame | None = None, partitions: int | None = None) -> int:
    """Builds the pages of `content` that are new or have changed since the last build into `site`; how many there are.

    A page is rebuilt when any of its files has another name or content (by="stamp": size or time of change, which reads no audio to find out). Its folder is replaced as a whole; its fingerprint is
    kept only after all pages are written, so a build that fails is made good by the next. Pages whose folders are gone stay.
    """
    folder = Folder.of(spark, content)
    before, run = last_state(spark, site)
    due = changed(folder.fingerprints(by), before)

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{site}/{WORK}/run={run}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    due = kept(due, "due")  # what is due is decided once
    if due.isEmpty():
        return 0
    tables = site_tables(folder.only(due), reader, settings, kept)
    header = tables["header"]
    audio = header.select("page_id", F.col("audio_path").alias("path")).join(folder.content("*.{" + ",".join(pages.AUDIO) + "}").select("path", "content"), "path").select("page_id", "content") if with_audio else None
    files = sinks.site_files(tables["words"], header, tables["quality"], low_confidence_words(tables["words"]), tables["issues"], audio, bundled, overrides)
    write_files(files, site, partitions)
    index_page(tables["quality"], header.select("page_id", "title", "duration")).withColumn("run", F.lit(run)).write.mode("overwrite").json(f"{site}/{INDEX}/run={run}")
    due.write.mode("overwrite").parquet(f"{site}/{STATE}/run={run}")
    return due.count()


def index_of(spark: SparkSession, site: str) -> DataFrame:
    """The index's rows, each page as it was built last."""
    rows = spark.read.json(f"{site}/{INDEX}")
    return rows.groupBy("page_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("page_id", "run"))), "run").alias("r")).select("page_id", "r.*")

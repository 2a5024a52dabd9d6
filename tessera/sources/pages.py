"""Pages on storage: discovery, texts, citations, stored results and the checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import schemas
from ..functions.text import numbered_tokens, stripped, title_of

# File names of a page, best first.
AUDIO = ("mp3", "wav", "ogg", "flac", "m4a")
TEXTS = ("text.txt", "texto.txt", "transcript.txt")
CITATION = "referencia.txt"


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    out = None
    for k, x in enumerate(order):
        out = (F if out is None else out).when(value == x, k)
    return out


def files(spark: SparkSession, content: str) -> DataFrame:
    """(path, page_id, in_source, name) of every file of every page; no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(content).select("path")
    at = F.regexp_extract("path", r"/([^/]+)(/content)?/([^/]+)$", 1)
    return df.select("path", at.alias("page_id"), (F.regexp_extract("path", r"/[^/]+(/content)?/[^/]+$", 1) != "").alias("in_source"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def discover(found: DataFrame) -> DataFrame:
    """(page_id, audio, text, title) of pages with audio, by page_id. A page's content folder, if it has one, stands for it."""
    pages = W.Window.partitionBy("page_id")
    own = found.withColumn("_src", F.max("in_source").over(pages)).where(F.col("in_source") == F.col("_src"))
    audio, text = rank_of(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)), AUDIO), rank_of(F.col("name"), TEXTS)
    first = lambda rank: F.min_by(F.when(rank.isNotNull(), F.col("path")), F.when(rank.isNotNull(), F.struct(rank, F.col("name"))))
    out = own.groupBy("page_id").agg(first(audio).alias("audio"), first(text).alias("text"))
    return out.where("audio IS NOT NULL").withColumn("title", title_of(F.col("page_id"))).orderBy("page_id")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files, without white space at their ends."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), stripped(F.col("value")).alias("text"))


def lines_of(texts: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) from 0."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def title_lines(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, body_start): the first line that isn't blank, and the next such line's number."""
    full = F.when(stripped(F.col("line")) != "", F.col("line_no"))
    first = lines.groupBy(key).agg(F.min(full).alias("t"), F.array_sort(F.collect_set(full)).alias("all"), F.min_by(stripped(F.col("line")), full).alias("title"))
    return first.select(key, "title", F.try_element_at("all", F.lit(2)).alias("body_start"))


def ref_tokens(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ref_idx, line_no, pos_in_line, token, is_title, is_line_end, is_section_start): a text's tokens in order.

    A section starts at the first token of a line that a blank line comes before, after the title.
    """
    w = W.Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("blank", stripped(F.col("line")) == "").withColumn("after_blank", F.coalesce(F.lag("blank").over(w), F.lit(False)))
    marked = marked.withColumn("full_before", F.coalesce(F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).where("NOT blank")
    each = marked.select(key, "line_no", "after_blank", "full_before", F.explode(numbered_tokens(F.col("line"))).alias("t")).select("*", F.col("t.pos").alias("pos_in_line"), F.col("t.token").alias("token"))
    order = W.Window.partitionBy(key).orderBy("line_no", "pos_in_line")
    return each.select(
        key, (F.row_number().over(order) - 1).alias("ref_idx"), "line_no", "pos_in_line", "token", (F.col("full_before") == 0).alias("is_title"), F.col("t.is_last").alias("is_line_end"),
        (F.col("after_blank") & (F.col("full_before") > 0) & (F.col("pos_in_line") == 0)).alias("is_section_start"),
    )


def unspoken_titles(titles: DataFrame) -> DataFrame:
    """Title words that aren't in the audio, as words without times. titles: (page_id, title)."""
    each = titles.select("page_id", F.explode(numbered_tokens(F.col("title"))).alias("t"))
    return each.select("page_id", F.col("t.pos").alias("word_idx"), F.col("t.token").alias("word"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(1.0).alias("confidence"), F.col("t.is_last").alias("line_break_after"), F.lit(True).alias("is_title"))


def prepended(front: DataFrame, words: DataFrame) -> DataFrame:
    """front's words before those of the same page, numbered anew."""
    both = front.withColumn("_part", F.lit(0)).unionByName(words.select(*front.columns).withColumn("_part", F.lit(1)))
    return both.withColumn("word_idx", F.row_number().over(W.Window.partitionBy("page_id").orderBy("_part", "word_idx")) - 1).drop("_part")


def mark_titles(words: DataFrame, titles: DataFrame) -> DataFrame:
    """The first words of a page, as many as its title has. titles: (page_id, title_len)."""
    out = words.drop("is_title").join(titles.select("page_id", "title_len"), "page_id", "left")
    return out.withColumn("is_title", F.coalesce(F.col("word_idx") < F.col("title_len"), F.lit(False))).drop("title_len")


def results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stored results, defaults filled in; a page's alignment figures and issues aren't taken over."""
    df = spark.read.schema(schemas.RESULT).option("multiLine", True).json(paths)
    return normal_results(df.withColumn("page_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1)))


def normal_results(df: DataFrame) -> DataFrame:
    w = F.transform("words", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(x["confidence"], F.lit(1.0)).alias("confidence"), F.coalesce(x["line_break_after"], F.lit(False)).alias("line_break_after"), F.coalesce(x["is_title"], F.lit(False)).alias("is_title")))
    return df.withColumns({"language": F.coalesce("language", F.lit("pt")), "duration": F.coalesce("duration", F.lit(0.0)), "words": w}).drop("timestamp_issues")


def words_of(df: DataFrame) -> DataFrame:
    """(page_id, word_idx, ...) of nested results."""
    return df.select("page_id", F.posexplode("words").alias("word_idx", "w")).select("page_id", "word_idx", "w.*")


def checklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHECKLIST).option("sep", ";").option("header", True).option("enforceSchema", True).csv(path)

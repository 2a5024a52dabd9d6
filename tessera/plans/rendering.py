"""Queries that render pages: by a short template, with SQL, and by the site's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..sources import pages, sinks
from . import inputs as I  # noqa: E812
from .catalog import LINES, query


def _pages(spark, sf_dir, docs: DataFrame) -> DataFrame:
    """Documents as pages: their tokens as words, first lines as titles."""
    words = joins.transfer_line_breaks(I.token_words(spark, sf_dir, docs), pages.ref_tokens(pages.lines_of(docs)))
    head = docs.select("page_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("full_text"), F.concat(F.lit("livro"), F.col("page_id") % 9, F.lit(".mp3")).alias("audio_file"), F.lit(65.5).alias("duration"))
    return sinks.page_context(words, head, project="Pages")


def _escaped(sql: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        sql = f"replace({sql}, '{raw}', '{safe}')"
    return sql


_NUMBER = r"regexp_replace({}::DECIMAL(24, 3)::VARCHAR, '(\.[0-9]+?)0+$', '\1')".format
_SPAN = f"""'<span class="word" data-start="' || {_NUMBER("s")} || '" data-end="' || {_NUMBER("e")} || '">' || {_escaped("word")} || ' </span>'"""
PLAIN_SQL = rf"""WITH {LINES}, {I.TOK_SQL}, prose AS (SELECT doc_id AS page_id, coalesce(list_max(list_transform(string_split(text, chr(10))[2:], lambda x: length(x))) > 80, false) AS prose FROM documents),
x AS (SELECT w.page_id, w.word_idx, w.word, round_even(w.s, 3) AS s, round_even(w.e, 3) AS e, w.is_title, t.is_line_end, prose FROM words w JOIN toks t ON t.page_id = w.page_id AND t.ref_idx = w.word_idx JOIN prose p ON p.page_id = w.page_id),
y AS (SELECT page_id, string_agg(CASE WHEN is_title THEN CASE WHEN s = 0 AND e = 0 THEN '<span class="word no-sync">' || {_escaped("word")} || ' </span>' ELSE {_SPAN} END END, '' ORDER BY word_idx) AS title_spans,
  string_agg(CASE WHEN NOT is_title THEN {_SPAN} || CASE WHEN is_line_end THEN CASE WHEN prose THEN '<br><br>' ELSE '<br>' END ELSE '' END END, '' ORDER BY word_idx) AS spans FROM x GROUP BY page_id)
SELECT y.page_id, '<title>' || {_escaped("coalesce(nullif(split_part(text, chr(10), 1), ''), 'Leitura Guiada')")} || '</title>' || chr(10) || '<h2>' || coalesce(title_spans, '') || '</h2>' || chr(10) || '<div id="transcript">' || coalesce(spans, '') || '</div>' || chr(10)
  || '<audio src="audio/livro' || (y.page_id % 9) || '.mp3"></audio> 1:05' || chr(10) AS html FROM y JOIN documents ON doc_id = y.page_id"""


@query(PLAIN_SQL)
def html_pages(spark, sf_dir) -> DataFrame:
    """Each document by the short template."""
    return sinks.html_pages(_pages(spark, sf_dir, I.page_texts(spark, sf_dir)), template="plain")


@query()
def site_pages(spark, sf_dir) -> DataFrame:
    """Each document by the site's template, every third by the short one, every fifth under a name of its own."""
    docs = I.page_texts(spark, sf_dir)
    own = docs.select("page_id", F.when(F.col("page_id") % 3 == 0, "plain").alias("template"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("Doc "), F.col("page_id"))).alias("title"))
    return sinks.html_pages(_pages(spark, sf_dir, docs), overrides=own)

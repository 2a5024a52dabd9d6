"""Word sequences made from the shared tables, in Spark and in SQL, for the registered queries.

ev: a user's events as words; a minute of the table counts as a millisecond of audio.
tok: a document's tokens as words, with times from syllables and punctuation; every eleventh word runs into the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X


#: Bytes of text that are dealt to a task; the rows of their words are sorted in memory.
PART_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    idx = F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    length = F.round(F.col("value") * 60e6).cast("long")
    return ev.select(
        F.col("user_id").alias("page_id"), idx.alias("word_idx"), F.col("event_type").alias("word"), (us.cast("double") / F.lit(6e10)).alias("start"), ((us + length).cast("double") / F.lit(6e10)).alias("end"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"), F.lit(False).alias("is_title"),
    )


def parts(texts: DataFrame) -> int:
    """How many tasks a table's texts are dealt to."""
    return (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES + 1


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text) of documents, dealt by page: what is made of the texts page by page, and joined by page, is shuffled no further."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return docs.repartition(parts(docs), "page_id")


def token_words(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    texts = page_texts(spark, sf_dir) if texts is None else texts
    each = texts.select("page_id", F.posexplode(X.tokens(F.col("text"))).alias("word_idx", "word"))
    each = each.withColumn("dur", 40 + 70 * X.syllables(F.col("word")))
    each = each.withColumn("gap", F.when(F.col("word").rlike("[.!?;:]$"), 700).when(F.col("word").endswith(","), 120).otherwise((F.col("word_idx") * 37) % 90))
    before = W.Window.partitionBy("page_id").orderBy("word_idx").rowsBetween(W.Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)))
    over = F.when(F.col("word_idx") % 11 == 4, 200).otherwise(0)
    return each.select(
        "page_id", "word_idx", "word", (F.col("at") / F.lit(1000.0)).alias("start"), ((F.col("at") + F.col("dur") + over) / F.lit(1000.0)).alias("end"),
        (((F.col("word_idx") * 7919) % 100) / F.lit(100.0)).alias("confidence"), (F.col("word_idx") < 3).alias("is_title"),
    )


EV_SQL = """words AS (SELECT user_id AS page_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS word_idx, event_type AS word,
  epoch_us(ts)::DOUBLE / 6e10::DOUBLE AS s, (epoch_us(ts) + round(value * 60e6::DOUBLE)::BIGINT)::DOUBLE / 6e10::DOUBLE AS e, (event_id % 100)::DOUBLE / 100::DOUBLE AS confidence, false AS is_title FROM events)"""

TOK_SQL = r"""tok0 AS (SELECT doc_id AS page_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS word_idx FROM documents),
tok1 AS (SELECT *, 40 + 70 * greatest(1, len(regexp_extract_all(regexp_replace(lower(word), '[^\p{L}\p{N}_]', '', 'g'), '[aeiouáéíóúâêôãõàü]+'))) AS dur,
  CASE WHEN regexp_matches(word, '[.!?;:]$') THEN 700 WHEN ends_with(word, ',') THEN 120 ELSE (word_idx * 37) % 90 END AS gap FROM tok0),
tok2 AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY page_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0 FROM tok1),
words AS MATERIALIZED (SELECT page_id, word_idx::INTEGER AS word_idx, word, t0::DOUBLE / 1000::DOUBLE AS s, (t0 + dur + CASE WHEN word_idx % 11 = 4 THEN 200 ELSE 0 END)::DOUBLE / 1000::DOUBLE AS e,
  ((word_idx * 7919) % 100)::DOUBLE / 100::DOUBLE AS confidence, word_idx < 3 AS is_title FROM tok2)"""

#: The gaps of `words`.
GAPS_SQL = """gaps AS MATERIALIZED (SELECT * FROM (SELECT page_id, word_idx AS gap_index, word AS word_before, lead(word) OVER w AS word_after, e AS gap_start, lead(s) OVER w AS gap_end, (lead(s) OVER w - e) * 1000::DOUBLE AS ms
  FROM words WINDOW w AS (PARTITION BY page_id ORDER BY word_idx)) WHERE ms IS NOT NULL)"""

_LIAISON = "('o','a','os','as','um','uma','uns','umas','de','da','do','das','dos','em','na','no','nas','nos','para','pra','pro')"

#: Classified gaps; reads `advised`: gaps with a_breath, a_pitch, a_sentence, a_rec and a_conf.
CLASSIFY_SQL = rf"""f0 AS (SELECT *, CASE WHEN ms <= 0 THEN 'micro' WHEN ms < 50 THEN 'micro' WHEN ms < 150 THEN 'short' WHEN ms < 400 THEN 'medium' WHEN ms < 600 THEN 'natural' ELSE 'sentence' END AS gap_type,
  ms > 0 AND regexp_matches(word_before, '[.!?;:]\s*$') AS punct, ms > 0 AND regexp_replace(lower(word_before), '[.,!?;:''"]+$', '') IN {_LIAISON} AS liaison FROM advised),
f1 AS (SELECT *, ms > 0 AND coalesce(a_breath, false) AS breath, ms > 0 AND coalesce(a_pitch, punct) AS pitch, ms > 0 AND coalesce(a_sentence, punct AND gap_type IN ('natural', 'sentence')) AS sentence, coalesce(a_rec IN ('keep', 'fill'), false) AS told FROM f0),
f2 AS (SELECT *, CASE WHEN ms <= 0 THEN 'fill' WHEN told AND a_conf > 0.8 THEN a_rec WHEN gap_type = 'micro' THEN 'fill' WHEN gap_type = 'sentence' THEN 'keep'
  WHEN gap_type = 'natural' THEN CASE WHEN breath OR pitch OR punct THEN 'keep' ELSE 'review' END
  WHEN gap_type = 'short' THEN CASE WHEN liaison THEN 'fill' WHEN breath OR pitch THEN 'keep' ELSE 'fill' END
  WHEN sentence OR (breath AND pitch) OR punct THEN 'keep' WHEN liaison THEN 'fill' WHEN breath OR pitch THEN 'keep' WHEN told AND a_conf > 0.6 THEN a_rec ELSE 'review' END AS action,
 (CASE WHEN ms <= 0 THEN 0.99 WHEN told AND a_conf > 0.8 THEN a_conf WHEN gap_type = 'micro' THEN 0.95 WHEN gap_type = 'sentence' THEN 0.95
  WHEN gap_type = 'natural' THEN CASE WHEN breath OR pitch OR punct THEN 0.85 ELSE 0.6 END
  WHEN gap_type = 'short' THEN CASE WHEN liaison THEN 0.85 WHEN breath OR pitch THEN 0.7 ELSE 0.75 END
  WHEN sentence THEN 0.9 WHEN breath AND pitch THEN 0.85 WHEN punct THEN 0.8 WHEN liaison THEN 0.8 WHEN breath OR pitch THEN 0.65 WHEN told AND a_conf > 0.6 THEN a_conf ELSE 0.5 END)::DOUBLE AS confidence FROM f1),
classified AS (SELECT * FROM f2)"""

NO_ADVICE_SQL = "advised AS (SELECT *, NULL::BOOLEAN AS a_breath, NULL::BOOLEAN AS a_pitch, NULL::BOOLEAN AS a_sentence, NULL::VARCHAR AS a_rec, NULL::DOUBLE AS a_conf FROM gaps)"

#: Advice by heuristics on `gaps`.
PROSODY_SQL = rf"""prosody AS MATERIALIZED (SELECT *, ms > 600 AS has_breath, p AS has_pitch_reset, p AND ms > 600 AS is_sentence_boundary,
  CASE WHEN ms < 50 THEN 'fill' WHEN ms < 150 AND l THEN 'fill' WHEN ms < 400 THEN 'analyze' WHEN ms < 600 THEN CASE WHEN p THEN 'keep' ELSE 'analyze' END ELSE 'keep' END AS recommendation,
  (CASE WHEN ms < 50 THEN 0.95 WHEN ms < 150 AND l THEN 0.85 WHEN ms < 150 THEN 0.6 WHEN ms < 400 THEN 0.5 WHEN ms < 600 THEN CASE WHEN p THEN 0.7 ELSE 0.5 END ELSE 0.85 END)::DOUBLE AS advice_confidence
  FROM (SELECT *, regexp_matches(word_before, '[.!?;:]\s*$') AS p, regexp_replace(lower(word_before), '[.,!?;:]+$', '') IN {_LIAISON} AS l FROM gaps WHERE ms > 0))"""

#: Advice from elsewhere: that of heuristics, shifted a little and sure.
SHIFTED_SQL = """told AS (SELECT page_id, gap_index AS pg_idx, gap_start + CASE WHEN gap_index % 3 = 0 THEN 0.04 ELSE 0.11 END::DOUBLE AS t0, gap_end + CASE WHEN gap_index % 2 = 0 THEN 0.03 ELSE 0.2 END::DOUBLE AS t1,
  has_breath AS b, has_pitch_reset AS p2, is_sentence_boundary AS sb, recommendation AS rec, advice_confidence + 0.1::DOUBLE AS conf FROM prosody),
matched AS (SELECT g.page_id, g.gap_index, arg_min(struct_pack(pg_idx := t.pg_idx, b := b, p2 := p2, sb := sb, rec := rec, conf := conf), (CASE WHEN abs(g.gap_end - t1) < 0.1 THEN 0 ELSE 1 END) * 1000000000 + t.pg_idx) AS m
  FROM (SELECT page_id, gap_index, gap_start, gap_end, unnest([floor(gap_start / 0.1)::BIGINT - 1, floor(gap_start / 0.1)::BIGINT, floor(gap_start / 0.1)::BIGINT + 1]) AS bucket FROM gaps) g
  JOIN (SELECT *, floor(t0 / 0.1)::BIGINT AS bucket FROM told) t ON g.page_id = t.page_id AND g.bucket = t.bucket AND abs(g.gap_start - t0) < 0.1 GROUP BY ALL),
advised AS (SELECT g.*, m.pg_idx AS pg_idx, m.b AS a_breath, m.p2 AS a_pitch, m.sb AS a_sentence, m.rec AS a_rec, m.conf AS a_conf FROM gaps g LEFT JOIN matched USING (page_id, gap_index))"""


def shifted_advice(prosody: DataFrame) -> DataFrame:
    g = F.col("pg_idx")
    return prosody.withColumns({"gap_start": F.col("gap_start") + F.when(g % 3 == 0, 0.04).otherwise(0.11), "gap_end": F.col("gap_end") + F.when(g % 2 == 0, 0.03).otherwise(0.2), "advice_confidence": F.col("advice_confidence") + 0.1})


#: A second timing of every document, from the tokens in reverse order of thirds: near copies, some moved or missing.
SECOND_SQL = """second AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY word_idx) - 1)::INTEGER AS idx2, word, s + ((word_idx * 31) % 700)::DOUBLE / 1000::DOUBLE AS s2, e + ((word_idx * 17) % 300)::DOUBLE / 1000::DOUBLE AS e2 FROM words WHERE word_idx % 7 <> 3)"""


def second_timing(words: DataFrame) -> DataFrame:
    idx = F.row_number().over(W.Window.partitionBy("page_id").orderBy("word_idx")) - 1
    i = F.col("word_idx")
    return words.where("word_idx % 7 <> 3").select("page_id", idx.alias("word_idx"), "word", (F.col("start") + ((i * 31) % 700) / F.lit(1000.0)).alias("start"), (F.col("end") + ((i * 17) % 300) / F.lit(1000.0)).alias("end"))

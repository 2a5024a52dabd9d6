"""Responses of speech recognisers and annotating models, as tables. Each reader takes (page_id, json)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import stripped
from ..operators.joins import by_provider


def parsed(df: DataFrame, schema: str, json: str = "json") -> DataFrame:
    """Rows with the response as `r`; where it isn't JSON, what stands between its outermost braces is tried."""
    inner = F.regexp_extract(json, r"(?s)\{.*\}", 0)
    whole = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(json).isNotNull()
    return df.withColumn("r", F.when(valid, whole).otherwise(F.from_json(inner, schema)))


def _words(df: DataFrame, words: Column, duration: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    head = df.select("page_id", duration.alias("duration"), text.alias("full_text"), F.size(words).alias("word_count"))
    rows = df.select("page_id", F.posexplode(words).alias("word_idx", "w")).select("page_id", "word_idx", "w.*", F.lit(False).alias("line_break_after"), F.lit(False).alias("is_title"))
    return head, rows


def _word(text: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.struct(stripped(text).alias("word"), start.alias("start"), end.alias("end"), confidence.alias("confidence"))


def plain_words(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, words) of a response with one list of words; all are certain."""
    p = parsed(df, schemas.PLAIN)
    words = F.coalesce(F.transform("r.words", lambda w: _word(w["word"], w["start"], w["end"], F.lit(1.0))), F.array())
    return _words(p, words, F.coalesce("r.duration", F.lit(0.0)), F.coalesce("r.text", F.lit("")))


def segmented_words(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, words) of a response of segments; a missing duration is the end of the last segment, else of the last word."""
    p = parsed(df, schemas.SEGMENTED)
    words = F.coalesce(F.flatten(F.transform("r.segments", lambda s: F.coalesce(F.transform(s["words"], lambda w: _word(w["text"], w["start"], w["end"], F.coalesce(w["confidence"], F.lit(1.0)))), F.array()))), F.array())
    last = F.coalesce(F.nullif(F.col("r.duration"), F.lit(0.0)), F.try_element_at("r.segments", F.lit(-1))["end"], F.try_element_at(words, F.lit(-1))["end"], F.lit(0.0))
    return _words(p, words, last, F.coalesce("r.text", F.lit("")))


def scored_words(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, words) of a forced alignment; blank and untimed words are left out, unscored ones are 0.9 sure."""
    p = parsed(df, schemas.SCORED)
    kept = lambda w: (F.coalesce(stripped(w["word"]), F.lit("")) != "") & w["start"].isNotNull() & w["end"].isNotNull()
    words = F.coalesce(F.flatten(F.transform("r.segments", lambda s: F.coalesce(F.transform(F.filter(s["words"], kept), lambda w: _word(w["word"], w["start"], w["end"], F.coalesce(w["score"], F.lit(0.9)))), F.array()))), F.array())
    texts = F.filter(F.transform("r.segments", lambda s: stripped(s["text"])), lambda t: t.isNotNull() & (t != ""))
    last = F.coalesce(F.try_element_at(words, F.lit(-1))["end"], F.try_element_at("r.segments", F.lit(-1))["end"], F.lit(0.0))
    return _words(p, words, last, F.coalesce(F.array_join(texts, " "), F.lit("")))


READERS = {"plain": plain_words, "segmented": segmented_words, "scored": scored_words}


def provider(explicit: str | None, configured: str | None, use_local: bool = False) -> str:
    """The provider that is asked: named, configured, or the default."""
    return explicit or configured or ("local" if use_local else "openai")


def first_transcription(tables: dict[str, DataFrame], order: Sequence[str] = ("whisperx", "openai", "local")) -> DataFrame:
    """Words of the first provider that has any for a page."""
    return by_provider({k: tables[k] for k in order if k in tables})


def corrections(df: DataFrame) -> DataFrame:
    rows = parsed(df, schemas.CORRECTIONS).select("page_id", F.posexplode("r.corrections").alias("seq", "c")).select("page_id", "seq", "c.*")
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.8))).withColumn("reason", F.coalesce("reason", F.lit("")))


def post_pause_corrections(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Only words that were asked about count; missing times are the word's own. candidates: (page_id, word_idx, word, start, end)."""
    rows = parsed(df, schemas.POST_PAUSE).select("page_id", F.posexplode("r.words").alias("seq", "w")).where("w.index IS NOT NULL").select("page_id", "seq", F.col("w.index").alias("word_idx"), F.col("w.start").alias("s"), F.col("w.end").alias("e"))
    out = rows.join(candidates.select("page_id", "word_idx", "word", "start", "end"), ["page_id", "word_idx"])
    return out.select("page_id", "seq", F.col("word_idx").alias("word_index"), "word", F.col("start").alias("original_start"), F.col("end").alias("original_end"), F.coalesce("s", "start").alias("corrected_start"), F.coalesce("e", "end").alias("corrected_end"), F.lit(0.85).alias("confidence"), F.lit("post_pause").alias("reason"))


# Kinds of prosody events.
EVENTS = ("breath_pause", "pitch_reset", "phrase_boundary", "sentence_end", "emphasis", "hesitation")


def prosody(df: DataFrame, kinds: Sequence[str] = EVENTS) -> tuple[DataFrame, DataFrame]:
    """(events, gap advice); an unknown kind of event is a phrase boundary."""
    p = parsed(df, schemas.PROSODY)
    kind = F.when(F.col("e.type").isin(*kinds), F.col("e.type")).otherwise("phrase_boundary")
    events = p.select("page_id", F.posexplode("r.events").alias("event_idx", "e")).select("page_id", "event_idx", kind.alias("event_type"), F.coalesce("e.time", F.lit(0.0)).alias("start"), F.coalesce("e.confidence", F.lit(0.8)).alias("confidence"), F.coalesce("e.word", F.lit("")).alias("description"))
    g = lambda name, default: F.coalesce(f"g.{name}", F.lit(default)).alias(name)
    gaps = p.select("page_id", F.posexplode("r.gap_analyses").alias("pg_idx", "g")).select("page_id", "pg_idx", g("gap_start", 0.0), g("gap_end", 0.0), g("has_breath", False), g("has_pitch_reset", False), g("is_sentence_boundary", False), g("recommendation", "analyze"), F.coalesce("g.confidence", F.lit(0.8)).alias("advice_confidence"))
    return events, gaps


def title_checks(df: DataFrame) -> DataFrame:
    p = parsed(df, schemas.TITLE_CHECK)
    return p.select("page_id", F.coalesce("r.is_spoken", F.lit(True)).alias("is_spoken"), F.col("r.actual_first_words").alias("actual_first_words"), F.col("r.start_time").alias("start_time"), F.col("r.end_time").alias("end_time"), F.coalesce("r.confidence", F.lit(0.8)).alias("confidence"))


def missing_checks(df: DataFrame, asked: DataFrame, most: int = 10) -> DataFrame:
    """Answers on a page's first missing words, found by the word in capitals, first answer first. asked: (page_id, ref_idx, word)."""
    from pyspark.sql import window as W

    first = asked.withColumn("_n", F.row_number().over(W.Window.partitionBy("page_id").orderBy("ref_idx")))
    told = parsed(df, schemas.MISSING_WORDS).select("page_id", F.posexplode("r.verifications").alias("n", "v")).groupBy("page_id", F.upper(F.coalesce("v.word", F.lit(""))).alias("_w")).agg(F.min_by("v", "n").alias("v"))
    out = first.withColumn("_w", F.upper("word")).join(told, ["page_id", "_w"], "left")
    hit = (F.col("_n") <= most) & F.col("v").isNotNull()
    return out.select("page_id", "ref_idx", "word", F.when(hit, F.coalesce("v.is_spoken", F.lit(True))).otherwise(F.lit(False)).alias("is_spoken"), F.when(hit, F.col("v.start_time")).alias("start_time"), F.when(hit, F.col("v.end_time")).alias("end_time"), F.when(hit, F.coalesce("v.confidence", F.lit(0.8))).otherwise(F.lit(0.0)).alias("confidence"))


def second_timing(df: DataFrame) -> DataFrame:
    """(page_id, word_idx, word, start, end) of a second source."""
    return parsed(df, schemas.SECOND_TIMING).select("page_id", F.posexplode("r.words").alias("word_idx", "w")).select("page_id", "word_idx", F.coalesce("w.word", F.lit("")).alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))

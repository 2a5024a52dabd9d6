"""Queries of what models answer, of whom is asked, and of what they are asked about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gaps, ordered, walks
from ..sources import responses
from . import inputs as I  # noqa: E812
from .catalog import EV, TURNS, _by_conversation, query

#: Turns that were asked about: those of users.
ASKED = f"WITH {TURNS}, asked AS (SELECT conv_id AS page_id, turn::INTEGER AS word_idx, role AS word, turn::DOUBLE AS s, turn::DOUBLE + 0.5::DOUBLE AS e FROM turns WHERE turn IS NOT NULL AND role = 'user')"


@query(f"""{ASKED}, told AS (SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, turn FROM turns)
SELECT a.page_id, seq, word_idx AS word_index, word, s AS original_start, e AS original_end, CASE WHEN turn % 3 = 0 THEN s ELSE turn::DOUBLE + 0.125::DOUBLE END AS corrected_start, CASE WHEN turn % 4 = 0 THEN e ELSE turn::DOUBLE + 0.75::DOUBLE END AS corrected_end, 0.85::DOUBLE AS confidence
FROM told JOIN asked a ON a.page_id = told.page_id AND a.word_idx = turn""")
def post_pause_response(spark, sf_dir) -> DataFrame:
    """Corrections after pauses of every turn, some without a start or an end; only turns of users had been asked about."""

    def one(t):
        at = t["turn"].cast("double")
        return F.struct(t["turn"].cast("int").alias("index"), t["role"].alias("word"), F.when(t["turn"] % 3 != 0, at + 0.125).alias("start"), F.when(t["turn"] % 4 != 0, at + 0.75).alias("end"))

    body = _by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(ts, one).alias("words")))
    turns = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).where("turn IS NOT NULL AND role = 'user'")
    at = F.col("turn").cast("double")
    asked = turns.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("word_idx"), F.col("role").alias("word"), at.alias("start"), (at + 0.5).alias("end"))
    return responses.post_pause_corrections(body, asked).drop("reason")


#: Kinds of events that an answer names in turns; the last is none that is known.
KINDS = ("breath_pause", "pitch_reset", "sentence_end", "laughter")


def _prosody(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    kind = lambda t: F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(t["turn"], F.lit(4)) + 1).cast("int"))
    event = lambda t: F.struct(kind(t).alias("type"), F.when(t["turn"] % 2 == 0, t["turn"].cast("double")).alias("time"), F.when(t["turn"] % 3 == 0, t["role"]).alias("word"), F.when(t["turn"] % 5 != 0, 0.5).alias("confidence"))
    gap = lambda t: F.struct(t["turn"].cast("double").alias("gap_start"), (t["turn"] + 0.25).cast("double").alias("gap_end"), F.when(t["turn"] % 2 == 0, True).alias("has_breath"), F.when(t["turn"] % 3 == 0, "keep").alias("recommendation"))
    return responses.prosody(_by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(ts, event).alias("events"), F.transform(ts, gap).alias("gap_analyses"))))


_EVENTS_SQL = f"""WITH {TURNS}, answered AS (SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS event_idx, CASE turn % 4 WHEN 0 THEN 'breath_pause' WHEN 1 THEN 'pitch_reset' WHEN 2 THEN 'sentence_end' ELSE 'phrase_boundary' END AS event_type,
  CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END::DOUBLE AS start, CASE WHEN turn % 5 <> 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS description FROM turns)"""


@query(f"{_EVENTS_SQL} SELECT * FROM answered")
def prosody_response(spark, sf_dir) -> DataFrame:
    """Events that a model heard, one for each turn, some without a time or a confidence, some of a kind that isn't known."""
    return _prosody(spark, sf_dir)[0]


@query(f"{_EVENTS_SQL} SELECT page_id, event_idx, start FROM answered WHERE event_type = 'phrase_boundary'")
def events_of_kind(spark, sf_dir) -> DataFrame:
    return gaps.events_of(_prosody(spark, sf_dir)[0], "phrase_boundary").select("page_id", "event_idx", "start")


@query(f"WITH {TURNS} SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pg_idx, turn::DOUBLE AS gap_start, turn::DOUBLE + 0.25::DOUBLE AS gap_end, turn % 2 = 0 AS has_breath, false AS has_pitch_reset, false AS is_sentence_boundary, "
       "CASE WHEN turn % 3 = 0 THEN 'keep' ELSE 'analyze' END AS recommendation, 0.8::DOUBLE AS advice_confidence FROM turns")  # fmt: skip
def prosody_response_gaps(spark, sf_dir) -> DataFrame:
    """Advice on gaps that a model gave, most of it left open."""
    return _prosody(spark, sf_dir)[1]


@query(f"WITH {TURNS}, p AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN 'whisperx' WHEN conv_id % 4 = 1 THEN 'openai' ELSE 'local' END AS provider FROM turns WHERE conv_id IS NOT NULL) SELECT conv_id AS page_id, turn::INTEGER AS word_idx, role AS word, provider FROM p")
def routed_words(spark, sf_dir) -> DataFrame:
    """Words of the first provider that has any: one has every fourth page, the next every second, the last all."""
    words = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("word")).where("conv_id IS NOT NULL").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("word_idx"), "word")
    page = F.col("page_id") % 4
    return responses.first_transcription({"local": words, "openai": words.where(page <= 1), "whisperx": words.where(page == 0)})


@query(f"{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap_index) AS rank FROM gaps WHERE ms > 0) SELECT page_id, count(*) AS n, string_agg(word_before || ' | ' || word_after || ': ' || printf('%.3f', gap_start) || '-' || printf('%.3f', gap_end) || ' (' || printf('%.0f', ms) || ' ms)', chr(10) ORDER BY rank) AS text FROM k WHERE rank <= 20 GROUP BY page_id")
def gap_prompts(spark, sf_dir) -> DataFrame:
    """What a model is asked about each user's first twenty gaps."""
    return walks.gap_prompt(ordered.gap_rows(I.event_words(spark, sf_dir)))


@query(f"{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS rank FROM words) SELECT page_id, count(*) AS n, string_agg('\"' || word || '\"', ', ' ORDER BY rank) AS text FROM k WHERE rank <= 50 GROUP BY page_id")
def word_prompts(spark, sf_dir) -> DataFrame:
    """What a model is told of each user's first fifty words."""
    return walks.word_prompt(I.event_words(spark, sf_dir))

"""Classification of gaps, prosody by heuristics, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GapSettings
from ..functions.text import ends_sentence, is_liaison

GAPS = GapSettings()


def gap_type(ms: Column, s: GapSettings = GAPS) -> Column:
    return (
        F.when(ms < s.micro_max, "micro").when(ms < s.short_max, "short").when(ms < s.medium_max, "medium")
        .when(ms < s.natural_max, "natural").otherwise("sentence")
    )


def _choice(action: str | Column, confidence: float | Column) -> Column:
    a = F.lit(action) if isinstance(action, str) else action
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(a.alias("action"), c.cast("double").alias("confidence"))


def gap_action(kind: Column, punct: Column, breath: Column, pitch: Column, liaison: Column, sentence: Column, advice: Column, advice_confidence: Column) -> Column:
    """struct(action, confidence): strong advice first, then by gap type, weak advice last."""
    told = F.coalesce(advice.isin("keep", "fill"), F.lit(False))
    sure = F.coalesce(advice_confidence, F.lit(0.0))
    own = _choice(advice, advice_confidence)
    natural = F.when(breath | pitch | punct, _choice("keep", 0.85)).otherwise(_choice("review", 0.6))
    short = F.when(liaison, _choice("fill", 0.85)).when(breath | pitch, _choice("keep", 0.7)).otherwise(_choice("fill", 0.75))
    medium = (
        F.when(sentence, _choice("keep", 0.9)).when(breath & pitch, _choice("keep", 0.85)).when(punct, _choice("keep", 0.8)).when(liaison, _choice("fill", 0.8))
        .when(breath | pitch, _choice("keep", 0.65)).when(told & (sure > 0.6), own).otherwise(_choice("review", 0.5))
    )
    return (
        F.when(told & (sure > 0.8), own).when(kind == "micro", _choice("fill", 0.95)).when(kind == "sentence", _choice("keep", 0.95))
        .when(kind == "natural", natural).when(kind == "short", short).otherwise(medium)
    )


ADVICE = ("has_breath", "has_pitch_reset", "is_sentence_boundary", "recommendation", "advice_confidence")


def classify_gaps(gaps: DataFrame, s: GapSettings = GAPS) -> DataFrame:
    """gaps (see gap_rows) with type, action, confidence, factors, and the window to fill.

    Columns of ADVICE, if gaps has them, come from a prosody analysis and outrank punctuation.
    """
    for name, kind in zip(ADVICE, ("boolean", "boolean", "boolean", "string", "double"), strict=True):
        if name not in gaps.columns:
            gaps = gaps.withColumn(name, F.lit(None).cast(kind))
    ms, apart = F.col("duration_ms"), F.col("duration_ms") > 0
    kind = F.when(apart, gap_type(ms, s)).otherwise("micro")
    punct = ends_sentence(F.col("word_before")) & apart
    liaison = is_liaison(F.col("word_before"), s.articles if s.article_liaison else (), s.prepositions if s.preposition_liaison else ()) & apart
    out = gaps.withColumn("gap_type", kind).withColumn("has_punctuation", punct).withColumn("is_liaison", liaison)
    out = out.withColumns({
        "has_breath": apart & F.coalesce(F.col("has_breath"), F.lit(False)),
        "has_pitch_reset": apart & F.coalesce(F.col("has_pitch_reset"), F.col("has_punctuation")),
        "is_sentence_boundary": apart & F.coalesce(F.col("is_sentence_boundary"), F.col("has_punctuation") & F.col("gap_type").isin("natural", "sentence")),
        "needs_expansion": ~apart,
    })
    c = F.col
    choice = gap_action(c("gap_type"), c("has_punctuation"), c("has_breath"), c("has_pitch_reset"), c("is_liaison"), c("is_sentence_boundary"), c("recommendation"), c("advice_confidence"))
    out = out.withColumn("choice", F.when(apart, choice).otherwise(_choice("fill", 0.99)))
    out = out.withColumn("action", c("choice.action")).withColumn("confidence", c("choice.confidence")).drop("choice")
    filled = c("action") == "fill"
    return out.withColumn("fill_start", F.when(filled, c("gap_start"))).withColumn("fill_end", F.when(filled, c("gap_end")))


def heuristic_prosody(gaps: DataFrame, s: GapSettings = GAPS) -> DataFrame:
    """Advice on each positive gap from its length and the punctuation before it."""
    ms = F.col("duration_ms")
    pitch = ends_sentence(F.col("word_before"))
    liaison = is_liaison(F.col("word_before"), s.articles, s.prepositions, quotes=False)
    choice = (
        F.when(ms < s.micro_max, _choice("fill", 0.95)).when((ms < s.short_max) & liaison, _choice("fill", 0.85)).when(ms < s.short_max, _choice("analyze", 0.6))
        .when(ms < s.medium_max, _choice("analyze", 0.5)).when((ms < s.natural_max) & pitch, _choice("keep", 0.7)).when(ms < s.natural_max, _choice("analyze", 0.5)).otherwise(_choice("keep", 0.85))
    )
    out = gaps.where(ms > 0).withColumn("choice", choice)
    return out.select(
        "page_id", F.col("gap_index").alias("pg_idx"), "word_before", "word_after", "gap_start", "gap_end", "duration_ms", (ms > s.natural_max).alias("has_breath"), pitch.alias("has_pitch_reset"),
        (pitch & (ms > s.sentence_boundary_min)).alias("is_sentence_boundary"), F.col("choice.action").alias("recommendation"), F.col("choice.confidence").alias("advice_confidence"),
    )


def prosody_events(prosody: DataFrame) -> DataFrame:
    """Point events of heuristic advice: a pitch reset, and the end of a sentence."""
    event = lambda name, confidence: F.struct(F.lit(name).alias("event_type"), F.lit(confidence).alias("confidence"))
    found = F.filter(F.array(F.when(F.col("has_pitch_reset"), event("pitch_reset", 0.7)), F.when(F.col("is_sentence_boundary"), event("sentence_end", 0.8))), lambda x: x.isNotNull())
    return prosody.select("page_id", "pg_idx", F.col("gap_start").alias("start"), F.explode(found).alias("e")).select("page_id", "pg_idx", "start", "e.event_type", "e.confidence")


def prosody_dispatch(told: DataFrame, heuristic: DataFrame) -> DataFrame:
    """A page's advice from the model where there is any, else from heuristics."""
    return told.unionByName(heuristic.join(told.select("page_id").distinct(), "page_id", "left_anti"), allowMissingColumns=True)


def type_counts(classified: DataFrame) -> DataFrame:
    """Gaps of each page by type: how many, kept and filled."""
    return classified.groupBy("page_id", "gap_type").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "fill").alias("filled"))


def summary_map(counts: DataFrame) -> DataFrame:
    """A page's type_counts as one map."""
    entries = F.collect_list(F.struct(F.col("gap_type").alias("key"), F.struct("n", "kept", "filled").alias("value")))
    return counts.groupBy("page_id").agg(F.map_from_entries(F.array_sort(entries)).alias("by_type"))


def action_counts(classified: DataFrame) -> DataFrame:
    """A page's gaps in all, kept, filled and up for review, and their mean confidence."""
    of = lambda a: F.count_if(F.col("action") == a)
    return classified.groupBy("page_id").agg(F.count("*").alias("total"), of("keep").alias("kept"), of("fill").alias("filled"), of("review").alias("review"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))


def low_confidence_gaps(classified: DataFrame, threshold: float = 0.7) -> DataFrame:
    return classified.where(F.col("confidence") < threshold)


def review_gaps(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("action") == "review")


def with_advice(prosody: DataFrame, *kinds: str) -> DataFrame:
    """Advice of the kinds named: keep, fill, analyze."""
    return prosody.where(F.col("recommendation").isin(*kinds))


def events_of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def prosody_summary(prosody: DataFrame, events: DataFrame) -> DataFrame:
    """A page's advice in all, to keep and to fill, and its events in all, breaths and pitch resets."""
    told = prosody.groupBy("page_id").agg(F.count("*").alias("gaps"), F.count_if(F.col("recommendation") == "keep").alias("to_keep"), F.count_if(F.col("recommendation") == "fill").alias("to_fill"))
    seen = events.groupBy("page_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "breath_pause").alias("breaths"), F.count_if(F.col("event_type") == "pitch_reset").alias("pitch_resets"))
    out = told.join(seen, "page_id", "left")
    return out.select("page_id", "gaps", "to_keep", "to_fill", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("events", "breaths", "pitch_resets")))

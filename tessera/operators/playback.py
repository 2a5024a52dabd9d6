"""What a player shows: which words can be played, and how they light up along a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .joins import point_in_interval



def playable_words(words: DataFrame) -> DataFrame:
    """Words with times, by start; play_idx counts them from 0."""
    timed = F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end") & ((F.col("start") > 0) | (F.col("end") > 0))
    own = words.where(timed)
    return own.withColumn("play_idx", F.row_number().over(W.Window.partitionBy("page_id").orderBy("start", "word_idx")) - 1)


def player_changes(events: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """(session_id, at, t, action, from_idx, to_idx): how words light up along a session's events, by windows.

    events: (session_id, at, t, kind, word_idx), by `at`, then t and kind; t is the player's clock. A tick shows word_idx, or none (-1): `active` words light
    up, words from..to are done by `read` and unread again by `clear`. Where words are passed over, they are done too; a step
    back clears those after it. "play" before 0.1 s clears all; "ended" ends the word that is lit. A session without events for
    idle_seconds has ended as well, and what comes then finds all words unread.
    """
    rows = events.where("kind in ('tick', 'play', 'ended')")
    order = W.Window.partitionBy("session_id").orderBy("at", "t", "kind")
    before = lambda w: w.rowsBetween(W.Window.unboundedPreceding, -1)
    reset = (F.col("kind") == "play") & (F.col("t") < 0.1)
    pause = lambda a, b: F.lit(False) if idle_seconds is None else F.coalesce((F.unix_micros(b) - F.unix_micros(a)) >= int(idle_seconds * 1e6), F.lit(False))
    rows = rows.withColumn("_new", pause(F.lag("at").over(order), F.col("at"))).withColumn("_last", F.lead("at").over(order).isNull() | pause(F.col("at"), F.lead("at").over(order)))
    # a part ends with a reset or a pause, and starts without a word
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.when(reset, 1).otherwise(0)).over(before(order)), F.lit(0)) + F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(order))
    part = W.Window.partitionBy("session_id", "_part").orderBy("at", "t", "kind")
    now = F.when(F.col("kind") == "tick", F.col("word_idx"))
    rows = rows.withColumn("_before", F.coalesce(F.last(now, ignorenulls=True).over(before(part)), F.lit(-1)))
    changed = F.coalesce(now != F.col("_before"), F.lit(False))
    rows = rows.withColumn("_older", F.coalesce(F.last(F.when(changed, F.col("_before")), ignorenulls=True).over(before(part)), F.lit(-1)))
    held, older, word = F.col("_before"), F.col("_older"), F.col("word_idx")
    known, lit = F.greatest(held, older), F.when(reset, -1).otherwise(F.coalesce(now, held))
    row = lambda action, a, b: F.struct(F.lit(action).alias("action"), a.cast("int").alias("from_idx"), b.cast("int").alias("to_idx"))
    ended = F.col("_last") if idle_seconds is not None else F.lit(False)
    found = F.array(
        F.when(changed & (word == -1), row("read", held, held)), F.when(changed & (word >= 0) & (known >= 0) & (word > known + 1), row("read", known + 1, word - 1)),
        F.when(changed & (word >= 0) & (held >= 0), row("read", held, held)), F.when(changed & (word >= 0), row("active", word, word)), F.when(changed & (word >= 0) & (held >= 0) & (word < held), row("clear", word + 1, held)),
        F.when(reset & (known >= 0), row("clear", F.lit(0), known)), F.when((F.col("kind") == "ended") & (held >= 0), row("read", held, held)), F.when(ended & (lit >= 0), row("read", lit, lit)),
    )
    return rows.select("session_id", "at", "t", F.inline(F.array_compact(found)))


def highlight(ticks: DataFrame, words: DataFrame) -> DataFrame:
    """Changes (session_id, t, action, from_idx, to_idx) along each page's ticks (page_id, t); a page is a session."""
    spoken = point_in_interval(ticks, words)
    events = spoken.select(F.col("page_id").cast("string").alias("session_id"), F.col("t").alias("at"), "t", F.lit("tick").alias("kind"), "word_idx")
    return player_changes(events).drop("at")


def word_changes(ticks: DataFrame, words: DataFrame) -> DataFrame:
    """Ticks at which another word, or none, is spoken than at the tick before."""
    spoken = point_in_interval(ticks, words)
    w = W.Window.partitionBy("page_id").orderBy("t")
    return spoken.withColumn("before", F.coalesce(F.lag("word_idx").over(w), F.lit(-1))).where("word_idx <> before")


def progress(t: Column, duration: Column) -> Column:
    """Per cent played; of an unknown duration, as if it were a second."""
    return t / F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(1.0)) * 100.0


def seek(t: Column, by: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(duration, t + by))

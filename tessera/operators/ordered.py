"""Operators on neighbours within a page: windows where a row reads its neighbours, scans where it changes them.

Tables have (page_id, word_idx, word, start, end, confidence); times are seconds. Rows of a page
are dealt to one task by page; windows and folds of one table share that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import let, scan, two_state

PAGE, IDX = "page_id", "word_idx"
#: Confidence of interpolated words.
INTERPOLATED = 0.3


def in_page(page: str = PAGE, idx: str = IDX):
    return Window.partitionBy(page).orderBy(idx)


def gap_rows(words: DataFrame, per_second: float = 1000.0) -> DataFrame:
    """The gap after each word but a page's last: (page_id, gap_index, word_before, word_after, gap_start, gap_end, duration_ms)."""
    w = in_page()
    out = words.select(
        PAGE, F.col(IDX).alias("gap_index"), F.col("word").alias("word_before"), F.lead("word").over(w).alias("word_after"),
        F.col("end").alias("gap_start"), F.lead("start").over(w).alias("gap_end"), F.lead(IDX).over(w).alias("next_idx"),
    )
    return out.where("next_idx IS NOT NULL").drop("next_idx").withColumn("duration_ms", (F.col("gap_end") - F.col("gap_start")) * F.lit(per_second))


def post_pause_words(words: DataFrame, least_ms: float = 500.0) -> DataFrame:
    """Words that follow a pause of least_ms or more."""
    out = words.withColumn("gap_ms", (F.col("start") - F.lag("end").over(in_page())) * 1000.0)
    return out.where(F.col("gap_ms") >= least_ms)


def minimum_duration(words: DataFrame, least_ms: float = 200.0, share: float = 0.8) -> DataFrame:
    """Short words are lengthened into at most `share` of the following gap; a negative gap shortens them. The last word gets all it lacks."""
    least = least_ms / 1000.0
    duration, gap = F.col("end") - F.col("start"), F.lead("start").over(in_page()) - F.col("end")
    longer = F.when(gap.isNull(), F.col("start") + least).otherwise(F.col("end") + F.least(F.lit(least) - duration, F.lit(share) * gap))
    return words.withColumn("end", F.when(duration >= least, F.col("end")).otherwise(longer))


def timed_neighbours(words: DataFrame, duration: Column) -> DataFrame:
    """prev_end: the nearest earlier end above 0, else 0; next_start: the nearest later start above 0, else duration."""
    before, after = in_page().rowsBetween(Window.unboundedPreceding, -1), in_page().rowsBetween(1, Window.unboundedFollowing)
    return words.withColumn("prev_end", F.coalesce(F.last(F.when(F.col("end") > 0, F.col("end")), ignorenulls=True).over(before), F.lit(0.0))).withColumn(
        "next_start", F.coalesce(F.first(F.when(F.col("start") > 0, F.col("start")), ignorenulls=True).over(after), duration)
    )


def runs(words: DataFrame, flag: Column) -> DataFrame:
    """run_id: equal for neighbouring rows that hold the flag; null for the others."""
    breaks = F.sum(F.when(flag, 0).otherwise(1)).over(in_page().rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("run_id", F.when(flag, breaks))


def repair_overlaps(words: DataFrame, least_gap: float = 0.01, keep: float = 0.15) -> DataFrame:
    """From a page's last word back: a word too close to the one before starts later, or if it would get too short, ends the one before.

    Whether a word's end was moved is all that a step hands on; it is found by windows.
    """
    back = Window.partitionBy(PAGE).orderBy(F.col(IDX).desc())
    start, end, least = F.col("start"), F.col("end"), F.lit(least_gap)
    need = least - (start - F.lead("end").over(back))
    moved_end = F.lag("start").over(back) - least
    tight = start - F.lead("end").over(back) < least_gap
    fits = lambda own: (own - start) - need >= keep
    out = two_state(words, back, tight & ~fits(end), tight & ~fits(moved_end), "_moved", "_moves")
    out = out.withColumn("_end", F.when(F.col("_moved"), moved_end).otherwise(end)).withColumn("_start", F.when(tight & fits(F.col("_end")), start + need).otherwise(start))
    return out.withColumns({"start": F.col("_start"), "end": F.col("_end")}).select(*words.columns)


def fill_midpoints(words: DataFrame, keep: float = 0.15) -> DataFrame:
    """Where `fill` holds after a word, it and the next meet in the middle of their gap, if both keep enough length.

    Whether a word's start was moved is all that a step hands on; it is found by windows.
    """
    w = in_page()
    start, end = F.col("start"), F.col("end")
    middle, moved_start = (end + F.lead("start").over(w)) / 2, (F.lag("end").over(w) + start) / 2
    fits = lambda own: F.col("fill") & (middle - own >= keep) & (F.lead("end").over(w) - middle >= keep)
    out = two_state(words, w, fits(start), fits(moved_start), "_moved", "_moves")
    out = out.withColumn("_end", F.when(F.col("_moves"), middle).otherwise(end)).withColumn("_start", F.when(F.col("_moved"), moved_start).otherwise(start))
    return out.withColumns({"start": F.col("_start"), "end": F.col("_end")}).select(*words.columns)


def interpolate(words: DataFrame, keep: float = 0.15, guess: float = 0.3) -> DataFrame:
    """Times of runs of missing words, by syllables. Needs columns missing, syllables and duration.

    Each missing word is given its part of what the run has left, and the rest of the run is dealt
    anew from its end, so lengths fall and the last word takes what remains. Runs that no word with an
    end stands between follow each other; a scan goes over the missing words of one such chain.
    """
    w = in_page()
    told, before, after = ~F.coalesce("missing", F.lit(False)), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ends = F.when(told & (F.col("end") > 0), F.col("end"))
    rows = words.withColumn("_run", F.sum(F.when(told, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({
        "_chain": F.coalesce(F.count(ends).over(before), F.lit(0)), "_from": F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0)),
        "_until": F.coalesce(F.first(F.when(told & (F.col("start") > 0), F.col("start")), ignorenulls=True).over(after), F.first("duration").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")),
    })
    gone = rows.where("missing")
    run = Window.partitionBy(PAGE, "_run").orderBy(IDX)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = gone.withColumns({"_k": F.row_number().over(run), "_n": F.count("*").over(whole), "_left": F.sum("syllables").over(run.rowsBetween(0, Window.unboundedFollowing)).cast("double")})
    item = F.struct(IDX, F.struct(*words.columns).alias("row"), F.col("syllables").cast("double").alias("weight"), "_k", "_n", "_left", "_until")
    chains = gone.groupBy(PAGE, "_chain", "_from").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a[IDX] < b[IDX], -1).when(a[IDX] > b[IDX], 1).otherwise(0)).alias("items"))

    def step(s: Column, x: Column) -> Column:
        free = x["_until"] - s["end"]
        # what the deal before left free up to the next word of the run
        room = F.when(x["_k"] == 1, F.when(free > 0, free).otherwise(guess * x["_n"])).when(x["_k"] == x["_n"], F.when(free > 0, free).otherwise(guess)).otherwise(F.greatest(F.lit(keep), x["weight"] * s["rate"]))
        return let(room / x["_left"], lambda rate: F.struct(s["end"].alias("start"), (s["end"] + F.greatest(F.lit(keep), x["weight"] * rate)).alias("end"), rate.alias("rate")))

    zero = F.struct(F.lit(0.0).alias("start"), F.col("_from").alias("end"), F.lit(0.0).alias("rate"))
    each = chains.select(PAGE, F.explode(F.arrays_zip(F.col("items"), scan(F.col("items"), zero, step).alias("times"))).alias("x"))
    fixed = {PAGE: F.col(PAGE), "start": F.col("x.times.start"), "end": F.col("x.times.end")} | ({"confidence": F.lit(INTERPOLATED)} if "confidence" in words.columns else {})
    filled = each.select(*(fixed.get(c, F.col("x.items.row")[c]).alias(c) for c in words.columns))
    return words.where(told).unionByName(filled)

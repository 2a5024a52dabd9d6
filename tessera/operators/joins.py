"""Joins by position and by time within pages.

Both sides of a join are put into one table and sorted once, page by page; each row finds its partners in a window. Tables that are
dealt by page already aren't shuffled again, as a join on the page and a further column would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_token
from .ordered import in_page


def beside(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """left with `name`: a struct of right's other columns where its row has equal keys (one at most), else null."""
    both = left.withColumn("_left", F.lit(True)).unionByName(right.select(*keys, F.struct(*(c for c in right.columns if c not in keys)).alias(name), F.lit(False).alias("_left")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_left").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)), F.last(name, ignorenulls=True).over(w))
    return both.withColumn(name, known).where("_left").drop("_left")


def nearest_position_join(first: DataFrame, second: DataFrame, reach: float = 0.2) -> DataFrame:
    """Each word of `first` with the nearest equal word of `second` (ties: the earlier one), within a share of its length.

    Adds second_idx, second_start and second_end, null without a match. Several words may share one.
    """
    # equal words in order of position: of all, only the last at or before and the first after can be nearest
    named = F.struct(F.col("word_idx").alias("second_idx"), F.col("start").alias("second_start"), F.col("end").alias("second_end"))
    right = second.select("page_id", clean_token(F.col("word")).alias("_clean"), F.col("word_idx").alias("_at"), F.lit(0).alias("_side"), named.alias("_m")).withColumn("_m", F.when(F.col("_clean") != "", F.col("_m")))
    points = first.withColumns({"_clean": clean_token(F.col("word")), "_at": F.col("word_idx"), "_side": F.lit(1)}).unionByName(right, allowMissingColumns=True)
    beside_it = lambda side: F.expr(f"{side}(_m) IGNORE NULLS OVER (PARTITION BY page_id, _clean ORDER BY _at, _side)")
    points = points.withColumns({"_low": beside_it("lag"), "_high": beside_it("lead")}).withColumn("_size", F.count_if(F.col("_side") == 0).over(Window.partitionBy("page_id")))
    far = lambda m: F.abs(m["second_idx"] - F.col("_at"))
    low, high = F.col("_low"), F.col("_high")
    best = F.when(low.isNull(), high).when(high.isNull(), low).when(far(low) <= far(high), low).otherwise(high)
    near = points.where("_side = 1").withColumn("_m", F.when(F.col("page_id").isNotNull(), best)).withColumn("_m", F.when(far(F.col("_m")) <= F.lit(reach) * F.col("_size"), F.col("_m")))
    return near.select(*first.columns, "_m.second_idx", "_m.second_start", "_m.second_end")


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def near_rows(left: DataFrame, right: DataFrame, on: str, other: str, width: float, name: str, key: str = "page_id") -> DataFrame:
    """left with `name`: structs of right's rows of equal key with |left.on - right.other| < width, without the key; empty without any."""
    told = right.select(key, F.col(other).cast("double").alias("_t"), F.lit(False).alias("_left"), F.struct(*(c for c in right.columns if c != key)).alias(name))
    both = left.withColumn("_t", F.col(on).cast("double")).withColumn("_left", F.lit(True)).unionByName(told, allowMissingColumns=True)
    # a little more than the width, as bounds are rounded; what is near is then told exactly
    around = F.expr(f"collect_list({name}) OVER (PARTITION BY {key} ORDER BY _t RANGE BETWEEN {1.5 * width}D PRECEDING AND {1.5 * width}D FOLLOWING)")
    near = lambda x: (F.abs(F.col(on) - x[other]) < F.lit(width)) & (F.abs(_bucket(F.col(on), width) - _bucket(x[other], width)) <= 1) & F.col(key).isNotNull()
    return both.withColumn(name, around).where("_left").withColumn(name, F.filter(name, near)).drop("_t", "_left")


def match_advice(gaps: DataFrame, advice: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Each gap with the first advice near it: near in both ends first, else in its start; left join."""
    names = ["pg_idx", "has_breath", "has_pitch_reset", "is_sentence_boundary", "recommendation", "advice_confidence"]
    told = advice.select("page_id", F.col("gap_start").alias("told_start"), F.col("gap_end").alias("told_end"), *names)
    order = lambda x: F.struct(F.when(F.abs(F.col("gap_end") - x["told_end"]) < tolerance, 0).otherwise(1), *(x[c].alias(c) for c in names))
    best = near_rows(gaps, told, "gap_start", "told_start", tolerance, "_near").withColumn("_near", F.array_min(F.transform("_near", order)))
    return best.select(*gaps.columns, *(f"_near.{c}" for c in names))


def advice_words(advice: DataFrame, words: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Advice with the words around it: the first word that ends near its start, and the next; empty without one."""
    w = words.select("page_id", "word_idx", F.col("word").alias("word_before"), F.lead("word").over(in_page()).alias("word_after"), F.col("end").alias("word_end"))
    best = near_rows(advice, w, "gap_start", "word_end", tolerance, "_near").withColumn("_near", F.array_min("_near"))
    return best.select(*advice.columns, *(F.coalesce(f"_near.{c}", F.lit("")).alias(c) for c in ("word_before", "word_after")))


def told_kept(advice: DataFrame, classified: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """advice with `preserved`: whether it asks to keep a gap and a kept gap lies near."""
    kept = classified.where("action = 'keep'").select("page_id", F.col("gap_start").alias("kept_start"))
    near = near_rows(advice, kept, "gap_start", "kept_start", tolerance, "_near")
    return near.withColumn("preserved", F.coalesce((F.col("recommendation") == "keep") & (F.size("_near") > 0), F.lit(False))).drop("_near")


def preserved_advice(advice: DataFrame, classified: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Advice to keep a gap that a kept gap lies near to (semi join)."""
    return told_kept(advice, classified, tolerance).where("preserved").drop("preserved")


def merge_corrections(general: DataFrame, post_pause: DataFrame) -> DataFrame:
    """Corrections (page_id, seq, word_index, ...) of two sources: a later source's replaces the first general one of its word, else is added."""
    own = general.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "word_index").orderBy("seq")))
    over = post_pause.groupBy("page_id", "word_index").agg(F.max_by(F.struct(*(c for c in post_pause.columns if c not in ("page_id", "word_index", "seq"))), "seq").alias("p"))
    both = own.join(over.withColumn("_n", F.lit(1)), ["page_id", "word_index", "_n"], "full_outer")
    last = F.coalesce(F.col("seq"), F.coalesce(F.max("seq").over(Window.partitionBy("page_id")), F.lit(-1)) + 1 + F.col("word_index"))
    names = [c for c in general.columns if c not in ("page_id", "word_index", "seq")]
    return both.select("page_id", last.cast("int").alias("seq"), "word_index", *(F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in names), F.col("p").isNotNull().alias("replaced"))


def apply_corrections(words: DataFrame, corrections: DataFrame, least: float = 0.7) -> DataFrame:
    """Sure corrections whose word is the page's word at that place set its times; the last one counts."""
    sure = corrections.where(F.col("confidence") >= least).select("page_id", F.col("word_index").alias("word_idx"), "seq", F.upper(clean_token(F.col("word"))).alias("_w"), "corrected_start", "corrected_end")
    best = sure.groupBy("page_id", "word_idx", "_w").agg(F.max_by(F.struct("corrected_start", "corrected_end"), "seq").alias("c"))
    out = beside(words.withColumn("_w", F.upper(clean_token(F.col("word")))), best, ["page_id", "word_idx", "_w"], "_own")
    return out.withColumn("c", F.col("_own.c")).withColumn("corrected", F.col("c").isNotNull()).withColumn("start", F.coalesce("c.corrected_start", "start")).withColumn("end", F.coalesce("c.corrected_end", "end")).drop("c", "_w", "_own")


def apply_verifications(aligned: DataFrame, verified: DataFrame, least: float = 0.7, length: float = 0.3) -> DataFrame:
    """Missing words that a check found spoken get its times. verified: (page_id, ref_idx, is_spoken, start_time, end_time, confidence)."""
    v = verified.where((F.col("confidence") > least) & F.col("is_spoken") & F.col("start_time").isNotNull()).groupBy("page_id", "ref_idx").agg(F.min(F.struct("start_time", "end_time", "confidence")).alias("v"))
    out = aligned.join(v, ["page_id", "ref_idx"], "left")
    hit = F.col("v").isNotNull()
    end = F.coalesce(F.nullif(F.col("v.end_time"), F.lit(0.0)), F.col("v.start_time") + length)
    return out.withColumns({"start": F.when(hit, F.col("v.start_time")).otherwise(F.col("start")), "end": F.when(hit, end).otherwise(F.col("end")), "confidence": F.when(hit, F.col("v.confidence")).otherwise(F.col("confidence")), "status": F.when(hit, "verified").otherwise(F.col("status"))}).drop("v")


def spread_title(aligned: DataFrame, titles: DataFrame, least: float = 0.7, end_default: float = 0.5) -> DataFrame:
    """Missing words among a title's first rows share its checked time. titles: (page_id, title_len, is_spoken, start_time, end_time, confidence)."""
    t = titles.where((F.col("confidence") > least) & F.col("is_spoken") & F.col("start_time").isNotNull() & (F.col("title_len") > 0))
    each = (F.coalesce(F.nullif(F.col("end_time"), F.lit(0.0)), F.lit(end_default)) - F.col("start_time")) / F.col("title_len")
    t = t.select("page_id", "title_len", F.col("start_time").alias("t0"), each.alias("each"), F.col("confidence").alias("tc"))
    out = aligned.join(t, "page_id", "left")
    hit = (F.col("op") == "deletion") & (F.col("word_idx") < F.col("title_len"))
    begin = F.col("t0") + F.col("word_idx") * F.col("each")
    return out.withColumns({"start": F.when(hit, begin).otherwise(F.col("start")), "end": F.when(hit, begin + F.col("each")).otherwise(F.col("end")), "confidence": F.when(hit, F.col("tc")).otherwise(F.col("confidence")), "status": F.when(hit, "verified").otherwise(F.col("status"))}).drop("title_len", "t0", "each", "tc")


def transfer_line_breaks(words: DataFrame, ref_tokens: DataFrame) -> DataFrame:
    """Words aligned to reference tokens one by one take their line ends."""
    ends = ref_tokens.select("page_id", F.col("ref_idx").alias("word_idx"), F.col("is_line_end").alias("_end"))
    return beside(words.drop("line_break_after"), ends, ["page_id", "word_idx"], "_own").withColumn("line_break_after", F.coalesce("_own._end", F.lit(False))).drop("_own")


def merge_validated(words: DataFrame, validated: DataFrame, least_average: float = 0.7, review: float = 0.80) -> DataFrame:
    """On pages that a second source confirms well enough, its sure final times and confidences replace the words'."""
    v = validated.select("page_id", "word_idx", "final_start", "final_end", "final_confidence", F.avg("final_confidence").over(Window.partitionBy("page_id")).alias("average"))
    out = beside(words, v, ["page_id", "word_idx"], "_own")
    hit = F.coalesce((F.col("_own.average") > least_average) & (F.col("_own.final_confidence") > review), F.lit(False))
    pick = lambda new, old: F.when(hit, F.col(f"_own.{new}")).otherwise(F.col(old))
    return out.withColumns({"start": pick("final_start", "start"), "end": pick("final_end", "end"), "confidence": pick("final_confidence", "confidence")}).drop("_own")


def point_in_interval(ticks: DataFrame, words: DataFrame) -> DataFrame:
    """The word that is spoken at each tick (page_id, t): start <= t < end, -1 in a gap. Words of a page don't overlap.

    An as-of join: ticks and words are sorted together once, and each tick looks back to the last start.
    """
    points = words.select("page_id", F.col("start").alias("t"), F.lit(0).alias("side"), F.struct("word_idx", "end").alias("m")).unionByName(ticks.select("page_id", "t", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("page_id").orderBy("t", "side", F.col("m.word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.withColumn("m", F.last("m", ignorenulls=True).over(w)).where("side = 1")
    return seen.select("page_id", "t", F.when(F.col("t") < F.col("m.end"), F.col("m.word_idx")).otherwise(F.lit(-1)).alias("word_idx"))


def mirror_titles(words: DataFrame) -> DataFrame:
    """The i-th unspoken title word with the i-th word that can be played."""
    unspoken = F.col("is_title") & (F.col("start") == 0) & (F.col("end") == 0)
    number = lambda df: df.withColumn("i", F.row_number().over(in_page()))
    titles = number(words.where(unspoken)).select("page_id", "i", F.col("word_idx").alias("title_idx"))
    spoken = number(words.where((F.col("start") > 0) | (F.col("end") > 0))).select("page_id", "i", F.col("word_idx").alias("spoken_idx"))
    return titles.join(spoken, ["page_id", "i"])


def by_provider(tables: dict[str, DataFrame], key: str = "page_id") -> DataFrame:
    """Rows of the first provider, in the order given, that has any for a key."""
    both = None
    for rank, (name, df) in enumerate(tables.items()):
        own = df.withColumn("provider", F.lit(name)).withColumn("_rank", F.lit(rank))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    best = both.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return both.join(best, [key, "_rank"], "left_semi").drop("_rank")

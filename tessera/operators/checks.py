"""Checks of word timings: rule violations, confidence from heuristics, and cross-validation by a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TIMING_VOWELS, ends_sentence, is_round, is_very_round, syllables
from .ordered import in_page

# A word's limits in ms, and the silence at a page's end that is too long.
SHORT, VERY_SHORT, LONG, GAP, GAP_AT_PUNCTUATION = 80.0, 50.0, 1500.0, 500.0, 800.0
DRIFT_SHARE, DRIFT_SECONDS = 0.15, 1.0


def untimed_title(start: Column, end: Column, is_title: Column) -> Column:
    return (start == 0) & (end == 0) & F.coalesce(is_title, F.lit(False))


def _ms(x: Column) -> Column:
    return F.format_string("%.0f", x)


def find_issues(words: DataFrame, duration: DataFrame | None = None) -> DataFrame:
    """(page_id, word_idx, type, severity, message), one row for each violation.

    duration: (page_id, duration) in seconds; where given, a page that falls silent early is reported at its last word.
    """
    w, c = in_page(), F.col
    skip = untimed_title(c("start"), c("end"), c("is_title"))
    rows = words.withColumns({"skip": skip, "ms": (c("end") - c("start")) * 1000.0, "syl": syllables(c("word"), TIMING_VOWELS), "prev_end": F.lag("end").over(w), "prev_word": F.lag("word").over(w)})
    rows = rows.withColumn("near", c("prev_end").isNotNull() & ~F.coalesce(F.lag("skip").over(w), F.lit(False)))
    rows = rows.withColumn("gap", (c("start") - c("prev_end")) * 1000.0).where(~c("skip"))
    issue = lambda test, kind, severity, *text: F.when(test, F.struct(F.lit(kind).alias("type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in text)).alias("message")))
    word, ms, syl = c("word"), c("ms"), c("syl")
    bare = (c("gap") > GAP) & ~ends_sentence(c("prev_word"))
    mismatch = (syl >= 3) & (ms < 150)
    checks = F.array(
        issue(ms < SHORT, "too_short", F.when(ms < VERY_SHORT, "error").otherwise("warning"), "Word '", word, "' lasts only ", _ms(ms), " ms"),
        issue(ms > LONG, "too_long", "warning", "Word '", word, "' lasts ", _ms(ms), " ms"),
        issue(c("near") & (bare | (c("gap") > GAP_AT_PUNCTUATION)), "large_gap", "warning", "Gap of ", _ms(c("gap")), " ms before '", word, "'", F.when(bare, " without punctuation").otherwise("")),
        issue(mismatch | (syl >= 2) & (ms < 100), "syllable_mismatch", F.when(mismatch, "error").otherwise("warning"), "Word '", word, "' has ", syl.cast("string"), " syllables in ", _ms(ms), " ms"),
        issue(c("near") & (c("start") < c("prev_end")), "overlap", "error", "Word '", word, "' starts ", _ms((c("prev_end") - c("start")) * 1000.0), " ms before '", c("prev_word"), "' ends"),
        issue(is_round(c("start")) & is_round(c("end")) & is_very_round(c("start")) & is_very_round(c("end")), "round_timestamps", "warning", "Word '", word, "' has round times"),
    )
    found = rows.select("page_id", "word_idx", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("i")).select("page_id", "word_idx", "i.type", "i.severity", "i.message")
    if duration is None:
        return found
    last = words.groupBy("page_id").agg(F.max_by(F.when(~skip, c("end")), F.when(~skip, c("word_idx"))).alias("last_end"), F.max("word_idx").alias("word_idx"))
    silent = last.join(duration, "page_id").withColumn("silence", c("duration") - c("last_end"))
    silent = silent.where((c("duration") > 0) & (c("silence") > c("duration") * DRIFT_SHARE) & (c("silence") > DRIFT_SECONDS))
    message = F.format_string("Last word ends %.2f s before the audio", c("silence"))
    return found.unionByName(silent.select("page_id", "word_idx", F.lit("alignment_drift").alias("type"), F.lit("warning").alias("severity"), message.alias("message")))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def issue_context(issues: DataFrame, words: DataFrame, most: int = 10) -> DataFrame:
    """A page's first issues with the word and the one before it."""
    near = words.select("page_id", "word_idx", "word", F.lag("word").over(in_page()).alias("prev_word"))
    first = issues.withColumn("rank", F.row_number().over(in_page().partitionBy("page_id").orderBy("word_idx", "type"))).where(F.col("rank") <= most)
    return first.join(near, ["page_id", "word_idx"], "left")


def heuristic_confidence(words: DataFrame) -> DataFrame:
    """words with `checked`: a confidence from length, round times, the gap before, and the word's own."""
    c = F.col
    ms, gap = (c("end") - c("start")) * 1000.0, c("start") - F.lag("end").over(in_page())
    factor = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(1.0))
    product = (
        factor(ms < 50, 0.7) * factor(ms > 2000, 0.8) * factor(is_round(c("start")) & is_round(c("end")), 0.9) * factor(gap < 0, 0.5)
        * factor((gap > 1.0) & ~ends_sentence(F.lag("word").over(in_page())), 0.8) * F.when(c("confidence") < 1.0, c("confidence")).otherwise(1.0)
    )
    return words.withColumn("checked", F.greatest(F.lit(0.1), F.least(F.lit(1.0), product)))


def agreement(deviation: Column) -> Column:
    """Confidence by the greater deviation in ms."""
    return F.when(deviation < 50, 0.98).when(deviation < 100, 0.92).when(deviation < 200, 0.85).when(deviation < 500, 0.7).otherwise(0.5)


def cross_validate(pairs: DataFrame, mean: bool = True, most_ms: float = 100.0, least: float = 0.05) -> DataFrame:
    """pairs (words with second_start and second_end, null where unmatched) with final times, deviations and confidence.

    mean: final times are those of both sources' middle; else the second source's where they differ by most_ms or more.
    """
    c = F.col
    out = pairs.withColumn("matched", c("second_start").isNotNull() & c("second_end").isNotNull())
    out = out.withColumn("deviation_start_ms", F.coalesce(F.abs(c("start") - c("second_start")) * 1000.0, F.lit(0.0))).withColumn("deviation_end_ms", F.coalesce(F.abs(c("end") - c("second_end")) * 1000.0, F.lit(0.0)))
    final = lambda own, second, dev: (own + second) / 2 if mean else F.when(dev < most_ms, own).otherwise(second)
    out = out.withColumn("fs", final(c("start"), c("second_start"), c("deviation_start_ms"))).withColumn("fe", final(c("end"), c("second_end"), c("deviation_end_ms")))
    brief, worst = c("fe") - c("fs") < least, F.greatest("deviation_start_ms", "deviation_end_ms")
    keep = ~c("matched") | brief
    out = out.withColumn("final_start", F.when(keep, c("start")).otherwise(c("fs"))).withColumn("final_end", F.when(keep, c("end")).otherwise(c("fe")))
    confidence = F.when(~c("matched"), 0.6 * c("confidence")).when(brief, F.least(F.lit(0.5), 0.7 - worst / 1000)).otherwise(agreement(worst))
    return out.withColumn("final_confidence", confidence).drop("fs", "fe")


def mean_deviation(validated: DataFrame) -> DataFrame:
    """A page's mean deviation over both ends of matched words, and how many matched."""
    total, n = F.sum(F.when(F.col("matched"), F.col("deviation_start_ms") + F.col("deviation_end_ms"))), F.count_if("matched")
    return validated.groupBy("page_id").agg(n.alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.coalesce(F.try_divide(total, 2 * n), F.lit(0.0)).alias("average_deviation_ms"), F.coalesce(F.avg("final_confidence"), F.lit(0.0)).alias("average_confidence"))


def pass_through(words: DataFrame) -> DataFrame:
    """Words as if validated: untimed titles are certain, others as sure as they are."""
    c = F.col
    sure = F.when(untimed_title(c("start"), c("end"), c("is_title")), 1.0).otherwise(c("confidence"))
    return words.withColumn("final_start", c("start")).withColumn("final_end", c("end")).withColumn("final_confidence", sure).withColumn("matched", F.lit(False))


def validate(words: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Pages that a second source has timings for are cross-validated; the others get heuristic confidences and keep their times."""
    c = F.col
    own = heuristic_confidence(words).withColumns({"final_start": c("start"), "final_end": c("end"), "final_confidence": c("checked"), "deviation_start_ms": F.lit(0.0), "deviation_end_ms": F.lit(0.0), "matched": F.lit(False)}).drop("checked")
    if second is None:
        return own
    from .joins import nearest_position_join

    told = second.select("page_id").distinct()
    crossed = cross_validate(nearest_position_join(words.join(told, "page_id", "left_semi"), second))
    return own.join(told, "page_id", "left_anti").unionByName(crossed, allowMissingColumns=True)

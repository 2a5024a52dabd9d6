"""Two cursors over a page: words that walk along a reference text, and words that fill prompts one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import clean_token
from .folds import let, scan


def in_order(rows: DataFrame, idx: str, *columns: Column | str) -> DataFrame:
    """(page_id, rows): structs of idx and columns, by idx."""
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("rows"))


def walk_line_breaks(words: DataFrame, ref_tokens: DataFrame, ahead: int = 4) -> DataFrame:
    """words with line_break_after and ref_idx, found by a walk along the reference; for words that weren't aligned to it.

    words: (page_id, word_idx, word), ref_tokens: (page_id, ref_idx, token, is_line_end). One pointer starts at the first token. A word
    that is equal to the token there, or to one of the next `ahead`, letter for letter, takes its line end, and the pointer moves past
    it. A word that isn't found moves the pointer by one, keeps the flag that it had (else false) and has no ref_idx, as have all
    words after the last token. Words without letters are equal to tokens without. A page without tokens or words keeps its rows.
    """
    ref = in_order(ref_tokens, "ref_idx", clean_token(F.col("token")).alias("clean"), F.coalesce("is_line_end", F.lit(False)).alias("is_line_end"))
    own = in_order(words, "word_idx", clean_token(F.col("word")).alias("clean"), F.struct(*words.columns).alias("row"))
    both = own.join(ref.withColumnRenamed("rows", "ref"), "page_id", "left").withColumn("ref", F.coalesce("ref", F.slice("ref", 1, 0)))
    both = both.withColumn("cleans", F.coalesce(F.col("ref.clean"), F.array().cast("array<string>")))

    def step(s: Column, x: Column) -> Column:
        found = F.coalesce(F.array_position(F.slice("cleans", s["at"] + 1, F.lit(ahead + 1)), x["clean"]), F.lit(0).cast("long")).cast("int")
        return let(found, lambda k: F.struct((s["at"] + F.greatest(k, F.lit(1))).alias("at"), F.when(k > 0, s["at"] + k).otherwise(0).alias("hit")))

    walked = scan(F.col("rows"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit")), step)
    each = both.select("ref", F.explode(F.arrays_zip(F.col("rows"), walked.alias("states"))).alias("x"))
    token = F.when(F.col("x.states.hit") > 0, F.element_at("ref", F.greatest(F.col("x.states.hit"), F.lit(1))))
    old = F.col("x.rows.row.line_break_after") if "line_break_after" in words.columns else F.lit(None).cast("boolean")
    kept = [F.col("x.rows.row")[c].alias(c) for c in words.columns if c not in ("line_break_after", "ref_idx")]
    return each.select(*kept, F.coalesce(token["is_line_end"], old, F.lit(False)).alias("line_break_after"), token["ref_idx"].alias("ref_idx"))


def prompt_words(words: DataFrame) -> DataFrame:
    """(page_id, word_idx, word, start, end, duration_ms) of the words that a model is asked about: all but title words without times."""
    unspoken = (F.col("start") == 0) & (F.col("end") == 0) & F.col("is_title")
    lasts = F.bround((F.col("end") - F.col("start")) * 1000, 1).alias("duration_ms")
    return words.where(~F.coalesce(unspoken, F.lit(False))).select("page_id", "word_idx", "word", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), lasts)


def pack_prompts(words: DataFrame, cost: Column, budget: int) -> DataFrame:
    """words with the prompt (from 0, in each page) that each goes into: prompts are filled in order and hold a cost of `budget` at most.

    A word that costs more than the budget has a prompt of its own; a null cost is 0.
    """
    own = in_order(words, "word_idx", F.coalesce(cost.cast("long"), F.lit(0)).alias("cost"), F.struct(*words.columns).alias("row"))

    def step(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + x["cost"] > budget)
        return let(full, lambda new: F.struct((s["prompt"] + new.cast("int")).alias("prompt"), (F.when(new, F.lit(0)).otherwise(s["used"]) + x["cost"]).alias("used")))

    filled = scan(F.col("rows"), F.struct(F.lit(0).alias("prompt"), F.lit(0).cast("long").alias("used")), step)
    each = own.select(F.explode(F.arrays_zip(F.col("rows"), filled.alias("states"))).alias("x"))
    return each.select(*(F.col("x.rows.row")[c].alias(c) for c in words.columns if c != "prompt"), F.col("x.states.prompt").alias("prompt"), F.col("x.rows.cost").alias("cost"))


def prompts(words: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """(page_id, prompt, first_idx, last_idx, n_words, cost, text) of prompt_words(): a line "index word start end ms" for each word.

    cost: of a word, by default a token for every four characters and five for its numbers.
    """
    line = F.concat_ws(" ", F.col("word_idx").cast("string"), "word", *(F.format_string(f"%.{n}f", c) for c, n in (("start", 3), ("end", 3), ("duration_ms", 1))))
    packed = pack_prompts(prompt_words(words), F.ceil(F.length("word") / 4) + 5 if cost is None else cost, budget)
    rows = F.array_sort(F.collect_list(F.struct("word_idx", line.alias("line"))))
    return packed.groupBy("page_id", "prompt").agg(F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"), F.count("*").alias("n_words"), F.sum("cost").alias("cost"), F.array_join(rows["line"], "\n").alias("text"))


# How many rows of a page go into a prompt or a report.
PREFIXES = {"gaps": 20, "missing words": 10, "issues": 10, "words": 50, "issues shown": 5, "low words shown": 10, "words shown": 20}


def first_rows(rows: DataFrame, idx: str, most: int) -> DataFrame:
    """Each page's first rows by idx, `most` of them, with their rank from 1."""
    rank = F.row_number().over(W.Window.partitionBy("page_id").orderBy(idx))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def gap_prompt(gaps: DataFrame, most: int = PREFIXES["gaps"]) -> DataFrame:
    """(page_id, n, text): a line for each of a page's first positive gaps, as a model is asked about them."""
    line = F.format_string("%s | %s: %.3f-%.3f (%.0f ms)", "word_before", "word_after", "gap_start", "gap_end", "duration_ms")
    own = first_rows(gaps.where("duration_ms > 0"), "gap_index", most)
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return own.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(rows["line"], "\n").alias("text"))


def word_prompt(words: DataFrame, most: int = PREFIXES["words"]) -> DataFrame:
    """(page_id, n, text): a page's first words, quoted."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit('"'), "word", F.lit('"')).alias("word"))))
    return first_rows(words, "word_idx", most).groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(rows["word"], ", ").alias("text"))

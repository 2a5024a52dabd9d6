"""Similarity of two words, as one Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_token

# Portuguese spellings that sound alike, applied in this order.
SOUNDS = [("ç", "s"), ("ss", "s"), ("ão", "am"), ("ões", "ams"), ("ães", "ams"), ("ch", "x"), ("lh", "li"), ("nh", "ni"), ("qu", "k"), ("gue", "ge"), ("gui", "gi"), ("rr", "r"), ("h", "")]
#: Least similarity and score of a pair; below all it is a mismatch.
SCORES = [(0.95, 10), (0.8, 7), (0.6, 5)]
MISMATCH = -3


def sound_of(word: Column) -> Column:
    for spelling, sound in SOUNDS:
        word = F.replace(word, F.lit(spelling), F.lit(sound))
    return word


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def char_jaccard(a: Column, b: Column) -> Column:
    left, right = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))


def phonetic_similarity(a: Column, b: Column) -> Column:
    x, y = sound_of(a), sound_of(b)
    return F.when(x == y, 1.0).otherwise(edit_similarity(x, y))


def clean_similarity(a: Column, b: Column) -> Column:
    """Of words that are clean already."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (F.instr(a, b) > 0) | (F.instr(b, a) > 0)
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, shorter / longer)
        .otherwise(F.greatest(0.8 * char_jaccard(a, b), edit_similarity(a, b), phonetic_similarity(a, b)))
    )


def word_similarity(a: Column, b: Column) -> Column:
    """1 for equal words; the share of lengths where one holds the other; else the best of shared characters, edits and sound."""
    return clean_similarity(clean_token(a), clean_token(b))


def pair_score(similarity: Column) -> Column:
    out = None
    for least, score in SCORES:
        out = (F if out is None else out).when(similarity >= least, F.lit(score))
    return out.otherwise(F.lit(MISMATCH))

"""Column functions on words, lines and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ARTICLES, COMMON_WORDS, PREPOSITIONS

#: Vowels that count syllables in alignment, and those that do in timing checks.
ALIGNMENT_VOWELS = "aeiouáéíóúâêôãõàü"
TIMING_VOWELS = "aeiouáéíóúâêîôûàèìòùãõ"
NOT_WORD = r"[^\p{L}\p{N}_]"


def tokens(line: Column) -> Column:
    """Runs of characters that aren't white space, in any script."""
    return F.regexp_extract_all(line, F.lit(r"(?U)\S+"), F.lit(0))


def numbered_tokens(line: Column) -> Column:
    """Structs (pos, token, is_last) of a line's tokens. The array of one element names the tokens, so that they are found once."""
    each = lambda ts: F.transform(ts, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), (i == F.size(ts) - 1).alias("is_last")))
    return F.element_at(F.transform(F.array(tokens(line)), each), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_token(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), NOT_WORD, "")


def ends_sentence(word: Column) -> Column:
    """Whether a word ends in one of .!?;: (a comma doesn't count)."""
    return F.coalesce(word.rlike(r"(?U)[.!?;:]\s*$"), F.lit(False))


def is_liaison(before: Column, articles: Sequence[str] = ARTICLES, prepositions: Sequence[str] = PREPOSITIONS, quotes: bool = True) -> Column:
    """Whether a word is an article or preposition that runs into the next; quotes at its end may be passed over."""
    bare = F.regexp_replace(F.lower(before), "[.,!?;:'\"]+$" if quotes else "[.,!?;:]+$", "")
    return F.coalesce(bare.isin(*articles, *prepositions), F.lit(False))


def syllables(word: Column, vowels: str = ALIGNMENT_VOWELS) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(clean_token(word), F.lit(f"[{vowels}]+")))


def is_anchor(word: Column, before: Column) -> Column:
    """Long, numbered or sentence-opening words that aren't common."""
    clean = clean_token(word)
    strong = (F.length(clean) >= 6) | clean.rlike(r"\p{Nd}") | F.coalesce(before.rlike("[.!?;:]$"), F.lit(False))
    return ~clean.isin(*COMMON_WORDS) & strong


def is_round(t: Column) -> Column:
    """Within 10 ms of a quarter second."""
    r = t - 0.25 * F.floor(t / 0.25)
    return (r < 0.01) | (r > 0.24)


def is_very_round(t: Column) -> Column:
    """Within 20 ms of a half second."""
    r = t - 0.5 * F.floor(t / 0.5)
    return (r < 0.02) | (r > 0.48)


def clock(seconds: Column) -> Column:
    """m:ss; missing, negative, infinite and undefined times are 0:00."""
    s = seconds.cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf"))
    whole = F.floor(F.when(ok, s).otherwise(0.0)).cast("long")
    return F.concat(F.floor(whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def book_number(name: Column, default: int = 3) -> Column:
    return F.coalesce(F.regexp_extract(name, r"livro(\d+)", 1).try_cast("int"), F.lit(default))


def is_prose(text: Column, longest: int = 80) -> Column:
    """Whether a line after the first is longer than a verse."""
    lines = F.split(text, "\n")
    return F.exists(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.length(x) > longest)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def mime_type(path: Column) -> Column:
    """Of an audio file, by its extension; audio/mpeg where that is unknown."""
    # Media types of audio files.
    known = {"mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4", "webm": "audio/webm", "aac": "audio/aac"}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))), F.lit("audio/mpeg"))


def title_of(name: Column) -> Column:
    """A folder's name as a title."""
    return F.initcap(F.translate(name, "-_", "  "))

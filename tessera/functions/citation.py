"""Bibliographic citations as HTML, with the title of the cited work emphasised.

A citation is a row of sentences. An automaton reads them from the left: what a sentence looks like (its symbol) and the state give
the next state, by the table STEPS, and the state says whether the sentence still names authors or begins the title. What comes after the title is told by
markers, by an imprint (place: publisher) or by the data of an issue. Everything is a Column expression on one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html

# Phrases, particles of names, months and abbreviations of Brazilian citations; lengths in characters.
UNPUBLISHED, WITHIN, ONLINE = "Texto não publicado", "In:", "Disponível em:"
LITERALS = ("cultura popular", "sem referência.")
PARTICLES = ("de", "da", "do", "das", "dos")
MONTHS = ("jan", "fev", "mar", "abr", "maio", "jun", "jul", "ago", "set", "out", "nov", "dez")
COUNTED = ("ano", "n", "p", "v")
SHORTEST, LONGEST_PERIODICAL, LONGEST_LAST_PART = 15, 50, 30

#: Symbols: "caps" is a name in capitals before a mark, "name" starts with one capital, "other" is anything else; "+" is added where the
#: last word is an initial or a particle, so that a name may go on. States: "person" (authors, complete), "open" (a name that may go on),
#: "body" (one word in capitals, whose departments may follow), "title".
STEPS = {
    "person": {"caps": "person", "caps+": "open", "name": "title", "name+": "title", "other": "title", "other+": "title"},
    "open": {"caps": "person", "caps+": "open", "name": "person", "name+": "open", "other": "person", "other+": "open"},
    "body": {"caps": "title", "caps+": "title", "name": "body", "name+": "body", "other": "title", "other+": "title"},
    "title": {"caps": "title", "caps+": "title", "name": "title", "name+": "title", "other": "title", "other+": "title"},
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.?!])\s+")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _mark_after_capitals(sentence: Column) -> Column:
    """What stands after the words in capitals that a sentence starts with: a mark, a space, "." at its end; null where it starts otherwise."""
    capitals = F.regexp_extract(sentence, r"^\p{Lu}{2,}( \p{Lu}{2,})*(?!\p{L})", 0)
    return F.when(capitals != "", F.coalesce(F.nullif(F.substring(sentence, F.length(capitals) + 1, F.lit(1)), F.lit("")), F.lit(".")))


def _goes_on(sentence: Column) -> Column:
    """Whether a name may go on after a sentence: its last word is one letter or a particle."""
    last = F.lower(F.regexp_replace(F.element_at(F.split(sentence, r"[\s,;]+"), -1), r"\.$", ""))
    return F.endswith(sentence, F.lit(".")) & ((F.length(last) == 1) & last.rlike(r"\p{L}") | last.isin(*PARTICLES))


def symbol(sentence: Column) -> Column:
    kind = F.when(_mark_after_capitals(sentence).isin(",", ";", "."), "caps").when(sentence.rlike(r"^\p{Lu}\p{Ll}|^\p{Lu}\s"), "name").otherwise("other")
    return F.concat(kind, F.when(_goes_on(sentence), "+").otherwise(""))


def title_start(parts: Column) -> Column:
    """Number, from 1, of the sentence that the title begins with.

    That is 1 for a headline, whose first words are in capitals and run on, or a single sentence. After authors it is the sentence that the
    automaton takes for a title; where it takes none (all may be names or departments), the last one.
    """
    first = F.element_at(parts, 1)
    headline = F.coalesce(_mark_after_capitals(F.regexp_replace(first, r"^(\d+|\p{Lu}) ", "")) == " ", F.lit(False))
    begin = F.when(first.rlike(r"^\p{Lu}{2,}\.$"), "body").when(_goes_on(first), "open").otherwise("person")
    table = F.create_map(*(F.lit(x) for state, row in STEPS.items() for sign, after in row.items() for x in (f"{state} {sign}", after)))

    def step(s: Column, part: Column) -> Column:
        after = F.element_at(table, F.concat_ws(" ", s["state"], symbol(part)))
        return let(after, lambda a: F.struct(a.alias("state"), (s["k"] + 1).alias("k"), F.when((a == "title") & (s["start"] == 0), s["k"] + 1).otherwise(s["start"]).alias("start")))

    zero = F.struct(begin.alias("state"), F.lit(1).alias("k"), F.lit(0).alias("start"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.aggregate(rest, zero, step, lambda s: F.when(s["start"] > 0, s["start"]).otherwise(s["k"]))
    return F.when(headline | (F.size(parts) == 1), 1).otherwise(found)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def _without_stop(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(text), r"[.,;\s]+$", ""))


def title_of(text: Column) -> Column:
    """The title of a citation that ends with it."""
    return let(sentences(text), lambda parts: let(title_start(parts), lambda k: _without_stop(_joined(F.slice(parts, k, F.size(parts))))))


def _are_names(clause: Column) -> Column:
    """Whether all words are capitalised, or particles between such."""
    return let(words(clause), lambda ws: (F.size(ws) > 0) & F.element_at(ws, 1).rlike(r"^\p{Lu}") & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}[\p{L}.'-]*$") | w.isin(*PARTICLES)))


def imprint(text: Column) -> Column:
    """Place of the mark before a place of publication (names before a colon that a capital follows); 0 if there is none."""
    ends = F.transform(F.split(text, r":\s*(?=\p{Lu})"), lambda piece: F.regexp_extract(piece, r"[.,;!?][^.,;!?:]*$", 0))
    before_colons = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
    places = F.filter(before_colons, lambda e: (e != "") & _are_names(F.substring(e, F.lit(2), F.length(e))))
    return F.when(F.size(places) > 0, F.instr(text, F.concat(F.element_at(places, 1), F.lit(":")))).otherwise(0)


def _before_imprint(text: Column) -> Column:
    """The text up to its imprint and the mark before that; the whole text where it has none."""
    return let(imprint(text), lambda at: F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text))


def _first(parts: Column, test: Callable[..., Column]) -> Column:
    """Number, from 1, of the first element for which test holds; 0 if there is none."""
    holds = lambda p: F.coalesce(test(p), F.lit(False))
    numbered = lambda p, i: F.coalesce(test(p, i), F.lit(False))
    return F.array_position(F.transform(parts, numbered if test.__code__.co_argcount == 2 else holds), True).cast("int")


def _until(parts: Column, stop: Callable[[Column], Column]) -> Column:
    """The elements before the first for which stop holds."""
    return let(parts, lambda ps: let(_first(ps, stop), lambda at: F.when(at > 0, F.slice(ps, 1, F.greatest(at - 1, F.lit(0)))).otherwise(ps)))


def _is_edition(part: Column) -> Column:
    return part.rlike(r"^\d+\.?$") | F.lower(part).isin("ed.", "ed") | part.rlike(r"^\d+\s\p{Lu}") | (part == "s.")


def _starts_locator(clause: Column, following: Column) -> Column:
    """Whether a clause after a comma is a page, or a place that another clause follows."""
    return clause.rlike(r"^p\.") | _are_names(clause) & following.isNotNull()


#: Put after a sentence that a locator ends, for the moment.
_ENDS = "\u0000"


def _host(text: Column) -> Column:
    """Title of the work that a part stands in: after its own authors, up to edition, imprint or locator. Of two sentences a short last one is the periodical."""
    is_author = lambda p, i: F.startswith(symbol(p), F.lit("caps")) | (i > 0) & (F.length(p) == 2) & F.endswith(p, F.lit("."))

    def until_locator(part: Column) -> Column:
        def cut(clauses: Column) -> Column:
            first = _first(clauses, lambda c, i: (i > 0) & _starts_locator(c, F.get(clauses, i + 1)))
            return let(first, lambda at: F.when(at > 0, F.concat(F.array_join(F.slice(clauses, 1, F.greatest(at - 1, F.lit(0))), ", "), F.lit(_ENDS))).otherwise(part))

        return let(F.split(part, r",\s+"), cut)

    def own(parts: Column) -> Column:
        return let(_first(parts, lambda p, i: ~is_author(p, i)), lambda at: F.when(at > 0, F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts))).otherwise(parts))

    def up_to_locator(parts: Column) -> Column:
        return let(_first(parts, lambda p: F.endswith(p, F.lit(_ENDS))), lambda at: F.when(at > 0, F.slice(parts, 1, F.greatest(at, F.lit(1)))).otherwise(parts))

    def title(parts: Column) -> Column:
        last = _without_stop(F.element_at(parts, -1))
        return F.when(F.size(parts) == 0, None).otherwise(let(last, lambda x: F.when((F.size(parts) > 1) & F.length(x).between(1, LONGEST_LAST_PART - 1), x).otherwise(_without_stop(_joined(parts)))))

    parts = let(F.filter(sentences(_before_imprint(text)), lambda p: p != ""), own)
    cut = let(F.transform(_until(parts, _is_edition), until_locator), up_to_locator)
    return let(F.transform(cut, lambda p: F.replace(p, F.lit(_ENDS), F.lit(""))), title)


def _has_issue(text: Column) -> Column:
    """Whether a text counts years, numbers, pages or volumes, or names a month."""
    return text.rlike(rf"(?i)\b({'|'.join(MONTHS)})\b") | text.rlike(rf"(?i)\b({'|'.join(COUNTED)})\b\.?\s*\d")


def _periodical(text: Column) -> Column:
    """What stands before the first comma of the last sentence, after the first, from where on an issue is told; null if there is none."""
    parts = sentences(text)

    def name(i: Column) -> Column:
        rest = _joined(F.slice(parts, i + 1, F.size(parts)))
        first = F.substring_index(rest, ",", 1)
        fits = F.contains(rest, F.lit(",")) & first.rlike(r"^\p{Lu}") & (F.length(first) <= LONGEST_PERIODICAL) & ~first.rlike(r"[.?!]\s")
        return F.when(fits & _has_issue(F.substring(rest, F.length(first) + 2, F.length(rest))), first)

    named = F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), name))
    return F.when((F.size(parts) > 1) & (imprint(text) == 0) & (F.size(named) > 0), F.trim(F.element_at(named, -1)))


def _book(text: Column) -> Column:
    """The title before an imprint, without edition, illustrators and what a semicolon adds; of a headline the last sentence."""

    def of(parts: Column) -> Column:
        def titled(k: Column) -> Column:
            own = F.when(k == 1, F.slice(parts, -1, 1)).otherwise(_until(F.slice(parts, k, F.size(parts)), lambda p: _is_edition(p) | F.startswith(F.lower(p), F.lit("ilustra"))))
            return _without_stop(F.substring_index(_joined(own), ";", 1))

        return let(title_start(parts), titled)

    return F.when(imprint(text) > 0, let(F.filter(sentences(_before_imprint(text)), lambda p: p != ""), of))


def emphasised(html: Column, piece: Column) -> Column:
    """The text with the first occurrence of a piece emphasised; null and empty pieces change nothing."""
    def of(safe):
        def at_place(at):
            marked = F.concat(F.substring(html, F.lit(1), at - 1), F.lit("<em>"), safe, F.lit("</em>"), F.substring(html, at + F.length(safe), F.length(html)))
            return F.when((F.length(safe) > 0) & (at > 0), marked).otherwise(html)

        return let(F.instr(html, safe), at_place)

    return let(escape_html(piece), of)


def citation_html(text: Column) -> Column:
    """HTML of a citation; null stays null. The first kind of work that claims a citation names what to emphasise."""
    within, unpublished = rf"\.\s*{WITHIN}\s*", rf"\.\s*{UNPUBLISHED}"

    def of(bare):
        def marked(html):
            split = F.split(bare, within, 2)
            out = F.when((F.length(bare) < SHORTEST) | F.lower(bare).isin(*LITERALS), html)
            out = out.when(bare.rlike(unpublished), emphasised(html, title_of(F.element_at(F.split(bare, unpublished, 2), 1))))
            out = out.when(F.size(split) == 2, let(emphasised(html, F.trim(F.regexp_extract(bare, within, 0))), lambda h: emphasised(h, _host(F.element_at(split, -1)))))
            out = out.when(F.contains(bare, F.lit(ONLINE)), emphasised(html, title_of(_before_imprint(F.rtrim(F.substring_index(bare, ONLINE, 1))))))
            return out.otherwise(emphasised(html, F.coalesce(_periodical(bare), _book(bare))))

        return let(escape_html(bare), marked)

    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), of)

"""Text templates as Spark expressions: what a template says for each row is one Column, so pages are filled without Python.

{{ expression }} or {{ expression | filter }}; {% for x in array %} ... {% endfor %}; {% if condition %} ... {% elif condition %} ... {% else %} ... {% endif %}.
Expressions and conditions are SQL on the row's columns and the loops' variables. Values are escaped for HTML; null is empty. Filters:
raw (not escaped), json (for a script), number (a double to three places), clock (m:ss). A tag that stands alone on a line takes no line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"\{\{(?P<value>.*?)\}\}|(?P<own>^[ \t]*)?\{%(?P<tag>.*?)%\}(?P<end>[ \t]*\n)?", re.S | re.M)
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def quoted(text: str) -> str:
    """A literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def _html(sql: str) -> str:
    for raw, safe in _ESCAPES:
        sql = f"replace({sql}, {quoted(raw)}, {quoted(safe)})"
    return sql


def _text(sql: str) -> str:
    return f"coalesce(cast({sql} AS string), '')"


def _json(sql: str) -> str:
    # an array of one serves any type; no value ends a script or opens a comment
    inner = f"regexp_extract(to_json(array({sql})), {quoted('(?s)^.(.*).$')}, 1)"
    return f"replace({inner}, '<', {quoted(chr(92) + 'u003c')})"


def _number(sql: str) -> str:
    return f"regexp_replace(cast(cast({sql} AS decimal(24, 3)) AS string), {quoted(r'(\.[0-9]+?)0+$')}, '$1')"


def _clock(sql: str) -> str:
    whole = f"cast(floor(CASE WHEN {sql} > 0 AND NOT isnan({sql}) AND {sql} < double('Infinity') THEN {sql} ELSE 0 END) AS bigint)"
    return f"concat({whole} div 60, ':', lpad(cast({whole} % 60 AS string), 2, '0'))"


FILTERS = {"raw": _text, "json": lambda sql: f"coalesce({_json(sql)}, 'null')", "number": lambda sql: _text(_number(sql)), "clock": _clock}


def _value(inside: str) -> str:
    expression, bar, name = inside.rpartition("|")
    if bar and name.strip() in FILTERS and not expression.endswith("|"):
        return FILTERS[name.strip()](f"({expression.strip()})")
    return _html(_text(inside.strip()))


def sql_of(template: str) -> str:
    """The template as an expression of Spark SQL."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        alone = m["tag"] is not None and m["own"] is not None and m["end"] is not None
        before = template[at : m.start()] + ("" if alone or m["tag"] is None else m["own"] or "")
        pieces += [("text", before)] if before else []
        pieces.append(("value", m["value"]) if m["tag"] is None else ("tag", m["tag"].strip()))
        at = m.end() if alone or m["tag"] is None else m.end() - len(m["end"] or "")
    pieces += [("text", template[at:])] if template[at:] else []
    out, rest = _block(pieces, 0, ())
    if rest < len(pieces):
        raise ValueError(f"nothing was opened that this ends: {pieces[rest][1]}")
    return out


def _block(pieces: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[str, int]:
    """(expression, place of the tag that ends the block)."""
    parts = []
    while at < len(pieces):
        kind, what = pieces[at]
        word = what.split(None, 1)[0] if kind == "tag" and what else ""
        if kind == "text":
            parts.append(quoted(what))
        elif kind == "value":
            parts.append(_value(what))
        elif word in ("endfor", "endif", "else", "elif"):
            if word not in ends:
                break
            return _joined(parts), at
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", what, re.S)
            if not m:
                raise ValueError(f"no loop: {what}")
            body, at = _block(pieces, at + 1, ("endfor",))
            parts.append(f"coalesce(array_join(transform({m[2]}, {m[1]} -> {body}), ''), '')")
        elif word == "if":
            cases, condition, other = [], what[2:].strip(), "''"
            while True:
                body, at = _block(pieces, at + 1, ("elif", "else", "endif") if condition else ("endif",))
                if condition:
                    cases.append(f"WHEN {condition} THEN {body}")
                else:
                    other = body
                if pieces[at][1] == "endif":
                    break
                condition = pieces[at][1][4:].strip() if pieces[at][1].startswith("elif") else ""
            parts.append(f"CASE {' '.join(cases)} ELSE {other} END")
        else:
            raise ValueError(f"no tag: {what}")
        at += 1
    if ends:
        raise ValueError(f"not ended by {' or '.join(ends)}")
    return _joined(parts), at


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else "''"


def filled(template: str) -> Column:
    """The template's text for each row."""
    return F.expr(sql_of(template))

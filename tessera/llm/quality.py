"""Learned decision lists over text statistics.

``text_stats`` counts what a text holds. ``learn_rules`` grows and prunes threshold conjunctions
by sequential covering on labelled statistics: each rule names texts of poor quality.
``verdict`` emits the ordered list as one Spark conditional expression.

Null and empty texts have no words and count zero everywhere. With no labelled rows, or labels
of one kind only, the list is empty and keeps all. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

SYMBOLS = b"[#*$%&|<>]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_end")
#: What rules may test: rates, so that a rule says the same of short and long texts.
RATES = {
    "mean_word": lambda c: c("word_chars") / c("n_words"),
    "symbol_rate": lambda c: c("n_symbols") / c("word_chars"),
    "dup_line_rate": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_rate": lambda c: c("n_repeat_words") / c("n_words"),
    "distinct_rate": lambda c: c("n_distinct") / c("n_words"),
    "upper_rate": lambda c: c("n_upper") / c("word_chars"),
    "end_rate": lambda c: c("n_end") / c("n_words"),
    "n_words": lambda c: c("n_words") * 1.0,
}


def count_text(data: bytes) -> tuple[int, ...]:
    """The values of STATS for a text's UTF-8 bytes."""
    words = data.split()
    n = len(words)
    flat = b"".join(words)
    raw = np.frombuffer(flat, np.uint8)
    tally = np.bincount(raw, minlength=256)
    chars = n and int(len(raw) - tally[128:192].sum())
    lines = [x for x in data.split(b"\n") if x.split()] if n else []
    distinct: dict[bytes, int] = {}
    ids = [distinct.setdefault(w, len(distinct)) for w in words]
    repeat = 0
    if n > 3:
        x = np.array(ids, np.int64)
        key = (x[:-2] * len(distinct) + x[1:-1]) * len(distinct) + x[2:] if len(distinct) < 2_000_000 else np.unique(np.stack([x[:-2], x[1:-1], x[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            marked = np.zeros(n, bool)
            for k in range(3):
                marked[k : k + len(key)] |= twice
            repeat = int(marked.sum())
    symbols = int(sum(tally[c] for c in b"[#*$%&|<>]" if c not in b"[]"))
    ends = sum(w[-1] in b".!?" for w in words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), len(distinct), int(tally[65:91].sum()), ends


def text_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, STATS): counts of each whole text."""

    def count(batches):
        for b in batches:
            found = [count_text(x) for x in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(STATS)))], ["key", *STATS])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInArrow(count, f"key {kind}, " + ", ".join(f"{c} long" for c in STATS)).withColumnRenamed("key", key)


def filter_rows(df: DataFrame, text: str, kept: Column) -> DataFrame:
    """The rows of df for which `kept`, a condition on STATS, holds; columns as in df."""
    at, names = df.columns.index(text), [f"c{i}" for i in range(len(df.columns))]
    stats = [f"s_{c}" for c in STATS]

    def count(batches):
        for b in batches:
            found = [count_text(x) for x in text_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(STATS)))], [*names, *stats])

    plain = df.toDF(*names)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"{c} long" for c in stats])
    out = plain.mapInArrow(count, schema).select(*(F.col(c).alias(o) for c, o in zip(stats, STATS, strict=True)), F.struct(*names).alias("row"))
    return out.where(kept).select("row.*").toDF(*df.columns)


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.coalesce(RATES[self.rate](lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0))
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.rate] > self.limit if self.above else x[self.rate] <= self.limit


Rule = tuple[Condition, ...]


def rates(stats: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """RATES of rows of STATS, 0 where a divisor is 0."""
    c = np.array(stats, np.float64).reshape(-1, len(STATS))
    with np.errstate(all="ignore"):
        return {k: np.nan_to_num(f(lambda n: np.where(c[:, STATS.index(n)] == 0, np.nan, c[:, STATS.index(n)])), nan=0.0) for k, f in RATES.items()}


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 64) -> Rule:
    """Adds the threshold of most FOIL gain until no row of good quality is covered or none gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < 4 and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            seen = np.unique(values[inside])
            if len(seen) < 2:
                continue
            at = np.unique(np.linspace(0, len(seen) - 2, cuts).astype(int))
            for limit in (seen[at] + seen[at + 1]) / 2:
                high = values > limit
                for above in (True, False):
                    now = inside & (high if above else ~high)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, Condition(name, above, float(limit)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that does best on rows it wasn't grown on."""

    def worth(r: Rule) -> float:
        c = covers(r, x, len(bad))
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), len(r)), default=())


def learn_rules(stats: Sequence[Sequence[int]], bad: Sequence[bool], least_precision: float = 0.9, least_cover: int = 5, most: int = 12, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, keep rules precise on both."""
    y = np.array(bad, bool)
    x, n = rates(stats), len(y)
    left, rules = np.ones(n, bool), []
    order = np.random.default_rng(seed)
    while len(rules) < most and (left & y).sum() >= least_cover and (left & ~y).any():
        part = order.random(n) < 2 / 3
        a, b = left & part, left & ~part
        if not (a & y).any():
            break
        of = lambda m: {k: v[m] for k, v in x.items()}
        rule = prune(grow(of(a), y[a]), of(b), y[b])
        c = left & covers(rule, x, n) if rule else np.zeros(n, bool)
        p, q = (c & y).sum(), (c & ~y).sum()
        held_p, held_q = (c & b & y).sum(), (c & b & ~y).sum()
        if p < least_cover or p < least_precision * (p + q) or held_p < least_precision * (held_p + held_q):
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as CASE WHEN: the number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = (F if out is None else out).when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train_rules(df: DataFrame, labels: DataFrame, key: str, text: str, good: str, max_rows: int = 8000) -> list[Rule]:
    """Rules from at most `max_rows` labelled texts, taken by hash of the key; texts the base test rejects teach nothing."""
    rows = labels.where(F.col(good).isNotNull()).groupBy(key).agg(F.max(good).alias("good"))
    picked = rows.orderBy(F.xxhash64(F.col(key)), key).limit(max_rows)
    stats = text_stats(df.select(key, text).join(F.broadcast(picked.select(key)), key, "left_semi"), key, text)
    found = stats.join(F.broadcast(picked), key).where(~base_failed()).orderBy(key).select(*STATS, "good").collect()
    return learn_rules([r[: len(STATS)] for r in found], [r["good"] == 0 for r in found])

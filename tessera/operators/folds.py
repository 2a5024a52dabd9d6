"""Recurrences along a page's rows without Python: scans of an array with a state, and two-state automata by windows.

scan() carries any struct along an array; each element's state is kept, so that what it says of its element can be read off.
two_state() serves recurrences whose state is one flag: what a row does to the flag is a constant, a copy or a flip, so the last constant
before a row and the flips since then tell its state, and three windows over one sort replace the recurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Elements that a scan appends one by one; longer arrays are appended part by part, so that copying doesn't grow with the square of their length.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each element of items: step(state, element) is the next state, a struct like start. Without elements, empty; of null, null."""
    grown = lambda states, x: F.concat(states, F.array(step(F.element_at(states, -1), x)))
    parts = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(PART)), lambda at: F.slice(items, at + 1, F.lit(PART))))
    after = lambda done, part: F.concat(done, F.array(F.aggregate(part, F.array(F.element_at(F.element_at(done, -1), -1)), grown)))
    whole = F.aggregate(parts, F.array(F.array(start)), after, lambda done: F.flatten(F.transform(done, lambda p, k: F.when(k == 0, F.slice(p, 1, 0)).otherwise(F.slice(p, 2, PART)))))
    return F.when(F.size(items) > 0, whole).when(items.isNotNull(), F.slice(F.array(start), 1, 0))


def two_state(rows: DataFrame, order: W.WindowSpec, if_clear: Column, if_set: Column, before: str, after: str) -> DataFrame:
    """rows with a flag before and after each, along `order`: clear before the first row, then if_set or if_clear by what it was.

    if_clear and if_set may read neighbours over `order`; null counts as false.
    """
    so_far = order.rowsBetween(W.Window.unboundedPreceding, 0)
    clear, held = F.coalesce(if_clear, F.lit(False)), F.coalesce(if_set, F.lit(False))
    out = rows.withColumn("_clear", clear).withColumn("_set", held)
    out = out.withColumn("_flips", F.sum(F.when(F.col("_clear") & ~F.col("_set"), 1).otherwise(0)).over(so_far))
    known = F.when(F.col("_clear") == F.col("_set"), F.struct(F.col("_clear").alias("flag"), F.col("_flips").alias("flips")))
    out = out.withColumn("_known", F.last(known, ignorenulls=True).over(so_far))
    odd = (F.col("_flips") - F.coalesce("_known.flips", F.lit(0))) % 2 == 1
    out = out.withColumn(after, F.coalesce("_known.flag", F.lit(False)) != odd)
    return out.withColumn(before, F.coalesce(F.lag(after).over(order), F.lit(False))).drop("_clear", "_set", "_flips", "_known")

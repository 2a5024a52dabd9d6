"""Temperature mixing of sources, realised as budgeted block permutations.

Source i holds the share p_i of all tokens and gets the weight p_i^a / sum p_j^a. The exponent a,
from 0 (equal weights) to 1 (as the corpus), is bisected to the largest that reaches a target
entropy, or to the smallest that keeps a limit of repetition. A source's budget of tokens is then
filled epoch by epoch: each epoch is a permutation of the source's documents, dealt into blocks
by hash and ordered by hash within a block; the last epoch is cut where the budget ends.

The cut is found from sums by block and then within one block, so no task sees a whole source.
What each source needs is one row; that table is written, and Spark joins it by broadcast only
if its size is below the session's threshold. Documents are only read and projected.

A null source is a source of its own. Null and empty texts have no tokens, take no budget and stay once in
each whole epoch; a source without tokens stays once. Repeated rows are rows of their own, but those
that share a key are cut or kept together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import WORD, written

BLOCK_DOCS = 4096
STEPS = 50


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


@dataclass(frozen=True)
class Mix:
    """Exponent, its normaliser, tokens in all, and the budget of tokens."""

    exponent: float
    norm: float
    tokens: int
    budget: float


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def entropy(p: Column, a: Column) -> Column:
    """Of the weights p_i^a / sum p_j^a."""
    norm = _sum(p, lambda x: F.pow(x, a))
    return F.log(norm) - a * _sum(p, lambda x: F.pow(x, a) * F.log(x)) / norm


def bisected(high: Column, low: Column, goes_up) -> Column:
    """The place between low and high, after STEPS halvings, up to which goes_up holds."""
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        up = goes_up(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: s["lo"])


def choose(sources: DataFrame, entropy_ratio: float | None, max_repeats: float | None, budget: int | str) -> Mix:
    """Bisects the exponent over the sources' tokens; one row of numbers comes back.

    entropy_ratio: of the entropy of equal weights, that the weights shall reach.
    max_repeats: how often a source may be repeated. budget: tokens, "corpus" (as many as there
    are) or "cover" (so many that every source is seen once at least).
    """
    one = sources.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    one = one.withColumn("total", _sum(F.col("t"), lambda x: x)).withColumn("p", F.transform("t", lambda x: x / F.col("total")))
    p, n = F.col("p"), F.size("p")
    exponent = F.lit(1.0)
    if entropy_ratio is not None:
        target = F.lit(float(entropy_ratio)) * F.log(n.cast("double"))
        exponent = F.when(entropy(p, F.lit(1.0)) >= target, 1.0).otherwise(bisected(F.lit(1.0), F.lit(0.0), lambda a: entropy(p, a) >= target))
    elif max_repeats is not None:
        if budget == "cover":
            # weight over tokens is greatest for the least source and least for the greatest
            most = lambda a: F.pow(F.element_at(p, -1) / F.element_at(p, 1), 1 - a)
        else:
            b = F.col("total") if budget == "corpus" else F.lit(float(budget))
            most = lambda a: b / F.col("total") * F.pow(F.element_at(p, 1), a - 1) / _sum(p, lambda x: F.pow(x, a))
        over = bisected(F.lit(1.0), F.lit(0.0), lambda a: most(a) > float(max_repeats))
        exponent = F.when(most(F.lit(0.0)) <= float(max_repeats), 0.0).otherwise(over)
    one = one.where(n > 0).withColumn("a", F.round(exponent, 9))
    one = one.withColumn("norm", _sum(p, lambda x: F.pow(x, F.col("a"))))
    row = one.select("a", "norm", F.col("total").cast("long").alias("total"), F.element_at(p, -1).alias("top")).first()
    if row is None:
        return Mix(1.0, 1.0, 0, 0.0)
    size = row["total"] if budget == "corpus" else row["total"] * row["norm"] * row["top"] ** (1 - row["a"]) if budget == "cover" else budget
    return Mix(row["a"], row["norm"], row["total"], float(size))


def order_key(doc: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def block_of(key: Column, blocks: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % blocks


def mixing_plan(docs: DataFrame, doc: str, source: str, tokens: str, entropy_ratio: float | None = None, max_repeats: float | None = None, budget: int | str = "corpus", seed: int = 17, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each source: weight, whole epochs, and where the last epoch is cut.

    docs: (doc, source, tokens) rows; read three times, so best a narrow written table.
    """
    sources = docs.groupBy(source).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))
    mix = choose(sources, entropy_ratio, max_repeats, budget)
    share = F.col("tokens") / F.lit(float(max(mix.tokens, 1)))
    sources = sources.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(share, F.lit(mix.exponent)) / F.lit(mix.norm)).otherwise(0.0))
    due = F.lit(mix.budget) * F.col("weight")
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.try_divide(due, F.col("tokens")) + 1e-9)).otherwise(1))
    sources = sources.withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0).cast("long"), F.round(due - F.col("epochs") * F.col("tokens")).cast("long"))).otherwise(0))
    sources = written(sources.withColumn("blocks", F.ceil(F.col("docs") / block_docs)).withColumn("exponent", F.lit(mix.exponent)), "mix-sources")
    own = docs.select(F.col(doc).alias("d"), F.col(source).alias("s"), F.col(tokens).alias("n"))
    own = own.join(sources.select(F.col(source).alias("s2"), "epochs", "rest", "blocks"), F.col("s").eqNullSafe(F.col("s2"))).where("rest > 0")
    own = own.withColumn("key", order_key(F.col("d"), F.col("epochs"), seed)).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    by = W.Window.partitionBy("s").orderBy("block")
    sums = own.groupBy("s", "block", "rest").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(by) - F.col("n"))
    cut = sums.where("before < rest and before + n >= rest").groupBy(F.col("s").alias("s3")).agg(F.min("block").alias("cut_block"), F.min(F.col("rest") - F.col("before")).alias("left"))
    cut = written(cut, "mix-cuts")
    inside = own.join(cut, F.col("s").eqNullSafe(F.col("s3")) & (F.col("block") == F.col("cut_block")))
    rows = W.Window.partitionBy("s").orderBy("key", "n").rowsBetween(W.Window.unboundedPreceding, 0)
    inside = inside.withColumn("before", F.sum("n").over(rows) - F.col("n")).where(F.col("before") < F.col("left"))
    ends = inside.groupBy("s", "cut_block").agg(F.max("key").alias("cut_key"))
    return sources.join(ends.withColumnRenamed("s", "s4"), F.col(source).eqNullSafe(F.col("s4")), "left").drop("s4")


#: Columns that mixed() adds.
ADDED = ("weight", "epoch", "block", "order_key")


def mixed(df: DataFrame, doc: str, source: str, plan: DataFrame, seed: int = 17) -> DataFrame:
    """df's rows once for each epoch that takes them, with ADDED, which replace columns of these names; they are read by epoch, block, order_key."""
    p = written(plan.select(F.struct(F.col(source).alias("source"), "weight", "epochs", "blocks", "cut_block", "cut_key").alias("p")), "mix-plan")
    out = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row")).join(p, F.col("row")[source].eqNullSafe(F.col("p.source")))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.epochs").cast("long"))))
    out = out.withColumn("order_key", order_key(F.col("row")[doc], F.col("epoch"), seed)).withColumn("block", block_of(F.col("order_key"), F.col("p.blocks")))
    cut = (F.col("block") < F.col("p.cut_block")) | (F.col("block") == F.col("p.cut_block")) & (F.col("order_key") <= F.col("p.cut_key"))
    out = out.where((F.col("epoch") < F.col("p.epochs")) | F.coalesce(cut, F.lit(False)))
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in ADDED), F.col("p.weight").alias("weight"), "epoch", "block", "order_key")


def mix_documents(df: DataFrame, doc: str, source: str, text: str, seed: int = 17, **target) -> DataFrame:
    """df's rows, with the columns that mixed() adds and n_tokens."""
    narrow = written(df.select(F.col(doc).alias("d"), F.col(source).alias("s"), n_tokens(F.col(text)).alias("n")), "mix-docs")
    return mixed(df, doc, source, mixing_plan(narrow, "d", "s", "n", seed=seed, **target).withColumnRenamed("s", source), seed)

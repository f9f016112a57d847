"""Mixing sources to target weights by temperature.

A source with the share s of all tokens gets a weight in proportion to s ** a. The exponent a is bisected in [0, 1]
(0: all sources alike, 1: as they come): either to the largest one whose entropy reaches a target, or to the smallest
one at which no source runs more than max_repeats times. Then a budget of tokens realises the weights: a source with
the target t runs floor(t / its tokens) times in full, and once more in part. Every pass has its own order (a hash of id
and pass); the part is the longest run of that order within what is left of the target. It's found from the totals of
BLOCKS blocks of the order, then within the one block where the target falls, so that no task gets a source's rows, and
then it is one bound for each source: taking part is decided row by row. Without a budget it's the smallest at which
every source runs at least once in full: no document is lost, and small sources repeat.

The mixed sequence is cut in blocks of about block_tokens: a row's place is that of its pass and order in its source's
whole run, so that each block holds the sources in about the target weights; within a block rows go by a hash.

Cases: null is a source of its own; null and empty texts have no tokens and run with their source's full passes; a
source without any tokens runs once; repeated rows are rows of their own (with one id: in or out together); an empty
table gives no rows. Extra columns of any name are kept by mixed(), but for the three that it adds.

Sources may be as many as documents. The exponent is sought on the driver from a histogram of their tokens, a row for
each different number: D of these are of D * (D - 1) / 2 tokens at least, so that D grows with the square root of the
input at most. Up to BROADCAST_SOURCES sources are broadcast to the rows; of more, those with so large a part of the rows
that there can't be more of them, and the others meet their rows in a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import staged

BROADCAST_SOURCES = 100_000
BLOCKS = 4096
STEPS = 60


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(id_col: str, at):
    return F.xxhash64(F.col(id_col), at.cast("int"))


def _block(h):
    """0 to BLOCKS - 1 in the order of the signed hash."""
    return (F.shiftright(h, 64 - 12) + BLOCKS // 2).cast("int")


def _exponent(p: np.ndarray, n: np.ndarray, total: float, max_repeats: float | None, entropy: float | None, budget: int | None) -> float:
    """The exponent for n sources of each share in p."""
    norm = lambda a: float((n * p**a).sum())

    def bits(a):  # -sum w log w with w = p^a / z
        return math.log2(norm(a)) - a * float((n * p**a * np.log2(p)).sum()) / norm(a)

    def most_runs(a):
        ratio = p ** (a - 1.0)
        return ratio.max() / (ratio.min() if budget is None else norm(a) * total / budget)

    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        up = bits(mid) >= entropy if entropy is not None else max_repeats is not None and most_runs(mid) > max_repeats
        lo, hi = (mid, hi) if up else (lo, mid)
    return lo if entropy is not None else hi


def temperature_weights(totals: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """totals (source, tokens, docs) with a row for each source, to: source, tokens, docs, exponent, weight, target.

    entropy: in bits; it's the target if given.
    """
    found = totals.filter("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).orderBy("tokens").collect()
    tokens, n = (np.array([r[c] for r in found], float) for c in ("tokens", "n"))
    total, a, z, floor = float((tokens * n).sum()), 1.0, 1.0, 1.0
    if len(tokens):
        p = tokens / total
        a = _exponent(p, n, total, max_repeats, entropy, budget)
        z, floor = float((n * p**a).sum()), float((p ** (a - 1.0)).min())
    power = F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(a))
    weight = F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(F.lit(0.0))
    whole = total * z / floor if budget is None else float(budget)
    target = F.when(F.col("tokens") > 0, F.floor(F.col("weight") * F.lit(whole))).otherwise(F.lit(0))
    out = totals.select("source", "tokens", "docs", F.lit(a).alias("exponent"), weight.alias("weight"))
    # without a budget, rounding must not cut the source that runs exactly once
    return out.withColumn("target", F.greatest(target, F.col("tokens") if budget is None else F.lit(0)).cast("long"))


def _with_sources(df: DataFrame, source_col: str, table: DataFrame, key: str, docs: str, n: int, all_docs: int) -> DataFrame:
    """df's rows with those of table, which has one for each of some sources (named key) with its number of rows (named
    docs): n sources and all_docs rows are there in all."""
    same = F.col(source_col).eqNullSafe(F.col(key))
    if n <= BROADCAST_SOURCES:
        return df.join(F.broadcast(table), same)
    large = F.col(docs) * BROADCAST_SOURCES >= all_docs
    rest = df.join(F.broadcast(table.filter(large).select(key)), same, "left_anti")
    return df.join(F.broadcast(table.filter(large)), same).union(rest.join(table.filter(~large), same))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """A row for each source: source, tokens, docs, exponent, weight, target, full (passes), bound (the last hash of the
    part, null without one)."""
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("tokens")), "mix")
    totals = staged(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix")
    n, all_docs = totals.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    weights = temperature_weights(totals, **how)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(F.lit(1)).cast("int")
    plan = staged(weights.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("tokens")), "mix")
    partly = plan.filter("tokens > 0 and rest > 0").select(F.col("source").alias("ps"), "full", "rest", F.col("docs").alias("pd"))
    hashed = _with_sources(rows, "source", partly, "ps", "pd", n, all_docs).select("source", "full", "rest", "pd", "tokens", "id")
    hashed = hashed.withColumn("h", _hash("id", F.col("full"))).withColumn("block", _block(F.col("h"))).drop("id", "full")
    upto = lambda *by: F.sum("t").over(Window.partitionBy("source").orderBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = hashed.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.max("h").alias("last"), F.first("rest").alias("rest"), F.first("pd").alias("pd")).withColumn("upto", upto("block"))
    blocks = staged(blocks, "mix")
    whole = blocks.filter("upto <= rest").groupBy("source").agg(F.max("last").alias("bound"))
    split = blocks.filter("upto > rest").groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("t")).alias("before"))).alias("b"), F.first("pd").alias("sd"))
    split = split.select(F.col("source").alias("ss"), F.col("b.block").alias("sb"), F.col("b.before").alias("before"), "sd")
    inner = _with_sources(hashed, "source", split, "ss", "sd", n, all_docs).filter("block = sb").select("source", "h", "tokens", "before", "rest")
    inner = inner.groupBy("source", "h").agg(F.sum("tokens").alias("t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inner = inner.withColumn("upto", F.col("before") + upto("h")).filter("upto <= rest").groupBy("source").agg(F.max("h").alias("bound"))
    bounds = whole.union(inner).groupBy(F.col("source").alias("bs")).agg(F.max("bound").alias("bound"))
    return staged(plan.join(F.broadcast(bounds) if n <= BROADCAST_SOURCES else bounds, plan["source"].eqNullSafe(bounds["bs"]), "left").drop("bs", "rest"), "mix")


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_tokens: int = 1 << 20) -> DataFrame:
    """docs with a row for each pass that a row takes part in, and the columns mix_pass, mix_block, mix_order."""
    plan = plan.select(*(F.col(c).alias(f"_m_{c}") for c in ("source", "full", "bound", "target", "tokens", "docs")))
    total, n, all_docs = plan.agg(F.sum("_m_target"), F.count("*"), F.coalesce(F.sum("_m_docs"), F.lit(0))).first()
    total = max(1, total or 0)
    n_blocks = max(1, -(-total // block_tokens))
    # no column of docs meets a working one
    rows = docs.select(F.struct("*").alias("_m_row"), F.col(source_col).alias("_m_from"), F.col(id_col).alias("_m_id"))
    df = _with_sources(rows, "_m_from", plan, "_m_source", "_m_docs", n, all_docs)
    also = F.coalesce(_hash("_m_id", F.col("_m_full")) <= F.col("_m_bound"), F.lit(False)).cast("int")
    df = df.withColumn("_m_n", F.col("_m_full") + also).filter("_m_n > 0")
    df = df.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("_m_n") - 1)))
    h = _hash("_m_id", F.col("mix_pass"))
    within = (F.shiftright(h, 11) + (1 << 52)).cast("double") / float(1 << 53)
    runs = F.greatest(F.when(F.col("_m_tokens") > 0, F.col("_m_target") / F.greatest(F.col("_m_tokens"), F.lit(1))).otherwise(F.lit(1.0)), F.lit(1e-12))
    at = F.least((F.col("mix_pass") + within) / runs, F.lit(0.9999999999))
    df = df.withColumns({"mix_block": F.floor(at * n_blocks).cast("long"), "mix_order": F.xxhash64("_m_id", "mix_pass", F.lit(1))})
    return df.select(*(F.col("_m_row")[c].alias(c) for c in docs.columns), "mix_pass", "mix_block", "mix_order")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: no source runs more than twice, each at least once in full."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing_plan(docs, max_repeats=2.0)
    return mixed(docs, plan).select("doc_id", "source", word_count().alias("n_tokens"), "mix_pass", "mix_block", "mix_order")

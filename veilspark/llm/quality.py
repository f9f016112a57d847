"""Quality rules: text statistics in DataFrame functions, and learned decision lists over them.

Statistics need no shuffle: words, lines and windows are arrays within the row. Windows of words are compared by 64-bit
hashes (two different windows of a text count as equal with a probability of about 2^-64 a pair).

Learning: sequential covering over the statistics of a bounded sample of labelled rows (SAMPLE_ROWS, the smallest hashes
of the id; more rows than that change nothing but the sample). A rule for the rejected class grows by the threshold
condition with the largest information gain, then loses conditions from its end while that raises its worth on the
held-out third; it's kept if enough of the held-out rows that it covers are rejected ones. What it covers leaves the
growing rows, and the next rule starts. The ordered rules become one conditional expression, so that applying them is a
projection. The fit runs on the driver over the bounded sample; the rest is DataFrame functions.

Cases: a null text counts as empty; it, and white space, has no words and fails the base rule; one very long text is one
row's arrays; repeated rows and null ids are rows like others; without labelled rows of both classes there are no
learned rules; an empty table gives no rows. A label counts by the majority of its id's rows; ids whose labels tie, and
null ids and labels, are left out. Of several rows with a labelled id the one with the smallest hash of its text is the
sample. Extra columns of any name are kept by quality_filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Labelled rows that a fit reads at most.
SAMPLE_ROWS = 20_000
WINDOW = 8


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns _q_words .. _q_first: counts of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    df = docs.withColumn("_q_list", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumns({"_q_hash": F.transform("_q_list", lambda w: F.xxhash64(w)), "_q_rows": lines})
    df = df.withColumns({
        "_q_words": F.size("_q_list").cast("long"),
        "_q_chars": F.length(F.array_join("_q_list", "")).cast("long"),
        "_q_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_q_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
        "_q_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "_q_lines": F.size("_q_rows").cast("long"),
        "_q_dup_lines": (F.size("_q_rows") - F.size(F.array_distinct("_q_rows"))).cast("long"),
        "_q_distinct": F.size(F.array_distinct("_q_hash")).cast("long"),
    }).drop("_q_list", "_q_rows")
    window = lambda i: F.xxhash64(*(F.get("_q_hash", i + k) for k in range(WINDOW)))
    df = df.withColumn("_q_win", F.when(F.col("_q_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_q_hash") - WINDOW), window)).otherwise(F.array().cast("array<long>")))
    # only a text that has a window twice pays for finding where
    placed = F.array_sort(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.size("_q_win") > F.size(F.array_distinct("_q_win")), placed)).drop("_q_win", "_q_hash")
    same = lambda x, i: (F.get("_q_sorted", i - 1)["h"] == x["h"]) | (F.get("_q_sorted", i + 1)["h"] == x["h"])
    df = df.withColumn("_q_at", F.array_sort(F.transform(F.filter("_q_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))).drop("_q_sorted")
    reach = lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_at", j + 1), F.get("_q_at", j) + WINDOW) - p)
    covered = F.aggregate(F.transform("_q_at", reach), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("_q_repeat", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_at")


STATISTICS = ("_q_words", "_q_chars", "_q_symbols", "_q_bangs", "_q_capitals", "_q_lines", "_q_dup_lines", "_q_distinct", "_q_repeat")
#: What rules see: name and numerator, denominator.
FEATURES = {
    "n_words": ("_q_words", None), "mean_word": ("_q_chars", "_q_words"), "symbols": ("_q_symbols", "_q_words"), "bangs": ("_q_bangs", "_q_words"),
    "capitals": ("_q_capitals", "_q_chars"), "dup_lines": ("_q_dup_lines", "_q_lines"), "words_a_line": ("_q_words", "_q_lines"), "distinct": ("_q_distinct", "_q_words"), "repeats": ("_q_repeat", "_q_words"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


class DecisionList:
    """Ordered conjunctions for the rejected class; the first that covers a row decides, none: it's kept."""

    def __init__(self, rules: list[tuple[Condition, ...]]):
        self.rules = rules

    def rejected(self) -> Column:
        """One conditional expression over the statistics' columns."""
        out = None
        for rule in self.rules:
            cond = F.lit(True)
            for c in rule:
                cond = cond & c.column()
            out = F.when(cond, F.lit(True)) if out is None else out.when(cond, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    def __str__(self):
        return "\n".join(" and ".join(map(str, r)) + " -> reject" for r in self.rules) or "keep"


def merged(rule: list[Condition]) -> tuple[Condition, ...]:
    """A conjunction with the narrowest condition of each feature and side."""
    tight: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        held = tight.setdefault((c.name, c.above), c)
        if (c.threshold > held.threshold) == c.above and c.threshold != held.threshold:
            tight[c.name, c.above] = c
    return tuple(tight.values())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 8, conditions: int = 3, thresholds: int = 40, least_precision: float = 0.75, least_cover: int = 3) -> DecisionList:
    """Sequential covering on features x of labelled rows (bad: rejected ones). Every third row is held out."""
    n = len(bad)
    hold = np.arange(n) % 3 == 2
    if not bad[~hold].any() or bad[~hold].all():
        return DecisionList([])
    cuts = {f: np.unique(np.quantile(v[~hold], np.linspace(0.01, 0.99, thresholds))) for f, v in x.items()}
    left, found = ~hold, []
    while len(found) < rules and (left & bad).sum() >= least_cover:
        cover, rule = left.copy(), []
        while len(rule) < conditions:
            p0, n0 = (cover & bad).sum(), (cover & ~bad).sum()
            if not n0:
                break
            best = (0.0, None)
            for f, ts in cuts.items():
                for above in (True, False):
                    order = np.sort(x[f][cover & bad]), np.sort(x[f][cover & ~bad])
                    p, q = (np.searchsorted(o, ts, "right") for o in order)
                    p, q = (p0 - p, n0 - q) if above else (p, q)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least_cover, p * (np.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))), 0.0)
                    k = int(np.nanargmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), Condition(f, above, float(ts[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            cover &= best[1].covers(x)
        if not rule:
            break

        def worth(r):
            c = hold.copy()
            for cond in r:
                c &= cond.covers(x)
            p, q = int((c & bad).sum()), int((c & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0, p / (p + q) if p + q else 0.0

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        if worth(rule)[1] < least_precision:
            break
        found.append(merged(rule))
        cover = left.copy()
        for c in rule:
            cover &= c.covers(x)
        left &= ~cover
    return DecisionList(found)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Rules from at most sample_rows labelled rows (label 0: rejected)."""
    votes = labels.select(F.col(id_col).alias("_q_id"), (F.col(label_col) == 0).cast("int").alias("bad")).dropna().groupBy("_q_id").agg(F.avg("bad").alias("bad")).filter("bad <> 0.5")
    sample = votes.select("_q_id", (F.col("bad") > 0.5).alias("_q_bad")).orderBy(F.xxhash64("_q_id"), "_q_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text"))
    # the sample's size is bounded by its parameter
    rows = with_statistics(rows.join(F.broadcast(sample), "_q_id"), "_q_text").withColumn("_q_key", F.xxhash64("_q_text"))
    features = F.struct(*(feature(f).alias(f) for f in FEATURES))
    got = rows.groupBy("_q_id").agg(F.first("_q_bad").alias("bad"), F.min_by(features, "_q_key").alias("x")).orderBy(F.xxhash64("_q_id"), "_q_id").collect()
    if not got:
        return DecisionList([])
    return learn({f: np.array([r["x"][f] for r in got], float) for f in FEATURES}, np.array([r["bad"] for r in got]))


def base_failed() -> Column:
    return (F.col("_q_words") < 20) | (100 * F.col("_q_repeat") > 30 * F.col("_q_words"))


def quality_report(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the base statistics and the verdict."""
    df = with_statistics(docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text")), "_q_text")
    return df.select(
        F.col("_q_id").alias(id_col), F.col("_q_words").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"), F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"), base_failed().alias("base_failed"), (~base_failed() & ~rules.rejected()).alias("kept"),
    )


def quality_filter(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that the base rule and the learned ones keep, with the columns of docs."""
    # a filter moves below a projection by repeating its expressions, unless one of them is not deterministic: this one
    # (always true) keeps the arrays from being made again for each of their elements
    once = F.monotonically_increasing_id() >= 0
    rows = docs.select(F.struct("*").alias("_q_row"), F.col(text_col).alias("_q_text"))  # no column of docs meets a working one
    return with_statistics(rows, "_q_text").withColumn("_q_kept", ~base_failed() & ~rules.rejected() & once).filter("_q_kept").select("_q_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over all documents, with rules learned from the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_report(docs, fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

"""Findings, comparisons and audits over documents with spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns, spans as sp


def snippet(text: Column, pos: Column, txt: Column, window: int = 40) -> Column:
    """…before【match】after…, line breaks as blanks."""
    before = F.substring(text, F.greatest(F.lit(1), pos - window + 1), F.least(F.lit(window), pos))
    after = F.substring(text, pos + F.length(txt) + 1, F.lit(window))
    return F.translate(F.concat(F.lit("…"), before, F.lit("【"), txt, F.lit("】"), after, F.lit("…")), "\n\r", "  ")


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: str = "spans", window: int = 40) -> DataFrame:
    """id, type, text, occurrence_count, first_pos, context: a row for each distinct text of a type in a document. The
    context is cut out in the document's row, so that texts are not shuffled."""
    s = df.select(id_col, F.inline(F.transform(spans, lambda s: F.struct(s["etype"].alias("type"), s["txt"].alias("text"), s["pos"].alias("pos"), snippet(F.col(text_col), s["pos"], s["txt"], window).alias("context")))))
    return s.groupBy(id_col, "type", "text").agg(F.count("*").alias("occurrence_count"), F.min("pos").alias("first_pos"), F.min_by("context", "pos").alias("context"))


def totals(df: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """id, total_findings (overlapping ones included), type_count; from the row alone."""
    return df.select(id_col, F.size(spans).cast("long").alias("total_findings"), F.size(F.array_distinct(F.transform(spans, lambda s: s["etype"]))).cast("long").alias("type_count"))


def analysis(df: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """id, findings: map of type to its distinct texts in order of first occurrence; a projection."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["etype"]))
    texts = lambda k: F.array_distinct(F.transform(F.filter(spans, lambda s: s["etype"] == k), lambda s: s["txt"]))
    return df.select(id_col, F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, texts(k)))).alias("findings"))


def top_examples(found: DataFrame, k: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Of findings() the first k texts of each type in a document, and how many more there are."""
    w = Window.partitionBy(id_col, "type")
    rank = F.row_number().over(w.orderBy("first_pos", "text"))
    return found.withColumns({"rank": rank, "more": F.greatest(F.lit(0), F.count("*").over(w) - k)}).filter(F.col("rank") <= k)


def check_cases(cases: DataFrame, detected: DataFrame) -> DataFrame:
    """name, missing, unwanted: cases (name, must_detect, must_not_detect) against spans (name, spans)."""
    have = F.transform("spans", lambda s: F.struct(s["txt"].alias("text"), s["etype"].alias("type")))
    listed = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<text:string,type:string>>")), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type")))
    return cases.join(detected, "name").select("name", F.array_except(listed("must_detect"), have).alias("missing"), F.array_intersect(listed("must_not_detect"), have).alias("unwanted"))


def snapshot(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "type", "text").distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, type, added, removed, unchanged between two snapshots; one aggregation over their union."""
    both = old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(2))).groupBy(id_col, "type", "text").agg(F.bit_or("side").alias("side"))
    n = lambda k: F.count_if(F.col("side") == k)
    return both.groupBy(id_col, "type").agg(n(2).alias("added"), n(1).alias("removed"), n(3).alias("unchanged"))


def leaks(df: DataFrame, id_col: str = "doc_id", masked_col: str = "masked_text", only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """id, type, text of what detection still finds in masked texts, placeholders aside."""
    again = patterns.with_pattern_spans(df.select(id_col, masked_col), masked_col, only, exclude, "spans")
    s = sp.exploded(again, id_col).filter(~(F.startswith("txt", F.lit("[")) & F.endswith("txt", F.lit("]"))))
    return s.groupBy(id_col, F.col("etype").alias("type"), F.col("txt").alias("text")).agg(F.count("*").alias("occurrences"))


def capped(rows: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """The first k rows of each group: the cap of a report."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def coverage(model: Column, rules: Column) -> Column:
    """struct(covered, novel): the model's spans that overlap rule spans, and the others."""
    hit = lambda s: F.exists(rules, lambda r: sp.overlap(s, r))
    return F.struct(F.filter(model, hit).alias("covered"), F.filter(model, lambda s: ~hit(s)).alias("novel"))


def islands(rows: DataFrame, by: list[str], start: str, stop: str, gap: int, text_between: Column | None = None) -> DataFrame:
    """rows with island: neighbours within gap of what came before them in their group (and, if given, with a text
    between them that text_between accepts) share a number."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) - reach > gap)
    if text_between is not None:
        new = new | ~text_between
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def visual_rows(lines: DataFrame, by: list[str], y: str = "y_center", h: str = "h", x: str = "x0") -> DataFrame:
    """lines with row (by vertical gaps over max(half the average height, 5)) and place in it by x."""
    w = Window.partitionBy(*by).orderBy(y, x)
    limit = F.greatest(F.avg(h).over(Window.partitionBy(*by)) * 0.5, F.lit(5.0))
    new = F.coalesce((F.col(y) - F.lag(y).over(w) > limit).cast("int"), F.lit(0))
    out = lines.withColumn("_new", new).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("_new").withColumn("place", F.row_number().over(Window.partitionBy(*by, "row").orderBy(x, y)))


def upper_median(values: Column) -> Column:
    """The element n // 2 (from 0) of the sorted values."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))

"""Parts of layout-preserving output: lines, matching parts, offsets and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_part(a: Column, b: Column, least: int = 2) -> Column:
    """The first longest part of a, of at least a length, that is in b; empty if there is none."""
    sizes = F.reverse(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(a))))
    at = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - n + 1)), lambda p: F.substring(a, p, n)), lambda s: (F.length(s) == n) & F.contains(b, s))
    found = F.aggregate(sizes, F.lit(""), lambda acc, n: F.when(acc != "", acc).otherwise(F.coalesce(F.get(at(n), F.lit(0)), F.lit(""))))
    return F.when(F.length(a) >= least, found).otherwise(F.lit(""))


def least_match(entity: Column) -> Column:
    """How much of an entity a line must hold: four characters of ASCII ones, all of short ones, else three."""
    return F.when(entity.rlike("^[A-Za-z0-9]+$"), F.lit(4)).when(F.length(entity) <= 3, F.length(entity)).otherwise(F.lit(3))


def line_width(text: Column) -> Column:
    """Width in half characters: Chinese ones count two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[^\x00-\x7f]"))


def pixel_offset(line: Column, chars: Column, x0: Column, x1: Column) -> Column:
    """Where the character after so many others begins in a line's box."""
    head = F.substring(line, F.lit(1), chars)
    return x0 + (x1 - x0) * line_width(head) / F.greatest(line_width(line), F.lit(1))


def entity_boxes(chars: DataFrame, by: list[str], tolerance: float = 2.0) -> DataFrame:
    """chars (by, place, x0, y0, x1, y1) of one entity each to a box for each visual line: a new one begins where y0 moves
    by more than the tolerance. Characters without a box are left out."""
    w = Window.partitionBy(*by).orderBy("place")
    c = chars.filter("x0 is not null").withColumn("new", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > tolerance).cast("int"), F.lit(0)))
    c = c.withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return c.groupBy(*by, "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def near_rows(lines: DataFrame, marked: DataFrame, by: list[str], limit: float, cell: float | None = None) -> DataFrame:
    """Range semi-join: lines with a marked line of their group within limit of their y, by equal cells of y."""
    cell = cell or max(limit, 1e-9)
    cells = marked.select(*by, F.col("y").alias("my"), F.explode(F.sequence(F.floor(F.col("y") / cell) - 1, F.floor(F.col("y") / cell) + 1)).alias("cell")).distinct()
    own = lines.withColumn("cell", F.floor(F.col("y") / cell))
    return own.join(cells, [*(own[b] == cells[b] for b in by), own["cell"] == cells["cell"], F.abs(own["y"] - cells["my"]) <= limit], "left_semi").drop("cell")


def kept_lines(lines: Column, least: float, fallback: bool) -> Column:
    """Recognised lines with a score above least; all of them if none has one and fallback is set."""
    good = F.filter(lines, lambda x: x["score"] > least)
    return F.when((F.size(good) == 0) & F.lit(fallback), lines).otherwise(good)

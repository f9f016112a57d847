"""Span kernel: the array of spans of a document, as expressions over it and as plain Python for Arrow passes.

A span is a struct of pos (code points from 0), txt, etype, layer, prio, seq; a document's spans are one array in its
row, so that everything here is a projection without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<pos:int,txt:string,etype:string,layer:string,prio:int,seq:int>"
FIELDS = ("pos", "txt", "etype", "layer", "prio", "seq")


class Occupied:
    """Ranges of a text that are taken; ranges that touch or overlap are held as one, so that a look-up is a bisection."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for a, b in sorted(ranges):
            if self.stops and a <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def free(self, start: int, stop: int) -> bool:
        """Whether a range that isn't empty overlaps nothing here."""
        k = bisect_left(self.starts, stop)
        return k == 0 or self.stops[k - 1] <= start

    def add(self, start: int, stop: int) -> None:
        a, b = bisect_left(self.stops, start), bisect_right(self.starts, stop)
        if a < b:
            start, stop = min(start, self.starts[a]), max(stop, self.stops[b - 1])
        self.starts[a:b], self.stops[a:b] = [start], [stop]

    def take(self, start: int, stop: int) -> bool:
        """Takes a range if it is free, and says whether it was."""
        clear = self.free(start, stop)
        if clear:
            self.add(start, stop)
        return clear


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def end(s: Column) -> Column:
    return s["pos"] + F.length(s["txt"])


def overlap(a: Column, b: Column) -> Column:
    return (a["pos"] < end(b)) & (b["pos"] < end(a))


def span(pos: Column, txt: Column, etype, layer: str, prio=0, seq=0) -> Column:
    as_col = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(pos.cast("int").alias("pos"), txt.alias("txt"), as_col(etype, "string").alias("etype"), F.lit(layer).alias("layer"), as_col(prio, "int").alias("prio"), as_col(seq, "int").alias("seq"))


def exploded(df: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """A row for each span: id_col, pos, txt, etype, layer, prio, seq."""
    return df.select(id_col, F.inline(spans))

"""Minimax contiguous sharding.

Equal texts stay together: the atomic groups are the texts, by their 64-bit hash, in order of that hash. They get the
smallest shard capacity for which cutting greedily gives at most n_shards runs, found by binary search; then the runs
are the shards. The groups are as many as different texts, so the driver never sees all of them: it holds 2^TOP_BITS
ranges of hashes at first, and finds two bounds of the capacity, one that these ranges allow as they are, one as if each
range of several texts could be cut anywhere. While the bounds differ, the ranges where a cut may fall between them (at
most SPLIT of them at once, the largest first) are split in 2^STEP_BITS each by an aggregation over the rows. At the
end the capacity is the least one over all texts, exactly, and the driver has held some 10^5 ranges.

Slots number a shard's rows from 0 without gaps: by range of the hash, then by part of the range (a hash of the rest of
the row), then by id. Rows that are alike in id and text are counted, not carried one by one; each part has its offset,
so that no task gets all copies of a text. The result doesn't depend on how the table was read.

Cases: a null text has size 1 like an empty one and stays with those; repeated rows are rows of their own; null ids come
first in their part; one group larger than the rest of the table makes its shard as large; fewer groups than shards
leave the last shards empty; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import staged

TOP_BITS = 16
STEP_BITS = 8
SPLIT = 512
#: Rows of a part, and parts at most.
PART_ROWS = 500
PARTS = 200_000


class Ranges:
    """Ordered ranges of groups: where each starts, its bytes, whether it is one group alone."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        """rows: start, bytes, bits of the hash below the range, single; ascending."""
        self.rows = rows
        self.ends = [0, *accumulate(r[1] for r in rows)]
        self.most = max((r[1] for r in rows if r[3]), default=0)

    def cuts(self, capacity: int, whole: bool) -> list[tuple[int, int]]:
        """(range, bytes before it in all) where each greedy run after the first begins. whole: ranges are not cut;
        otherwise those of several groups may be cut anywhere. Ends early where nothing fits."""
        out, at, total = [], 0, self.ends[-1]
        while at + capacity < total:
            k = bisect_right(self.ends, at + capacity) - 1
            nxt = self.ends[k] if whole or self.rows[k][3] else at + capacity
            if nxt <= at:
                return [*out, *[(k, at)] * len(self.rows)]
            out.append((k, nxt))
            at = nxt
        return out

    def least(self, n_shards: int, whole: bool) -> int:
        """The smallest capacity with at most n_shards runs."""
        total = self.ends[-1]
        low, high = max(-(-total // n_shards), max((r[1] for r in self.rows), default=0) if whole else self.most), max(total, 1)
        while low < high:
            mid = (low + high) // 2
            if len(self.cuts(mid, whole)) < n_shards:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, low: int, high: int, n_shards: int) -> list[int]:
        """The ranges of several groups in which a greedy cut may fall for a capacity between low and high."""
        first, last, out = self.cuts(low, True)[: n_shards - 1], self.cuts(high, False), set()
        for k, (_, near) in enumerate(first):
            far = last[k][1] if k < len(last) else self.ends[-1]
            a, b = max(0, bisect_right(self.ends, near) - 1), bisect_left(self.ends, far)
            out |= {r for r in range(a, min(b + 1, len(self.rows))) if not self.rows[r][3]}
        return sorted(out, key=lambda r: -self.rows[r][1])


def minimax_cuts(rows: DataFrame, n_shards: int, top_bits: int = TOP_BITS, step_bits: int = STEP_BITS, split: int = SPLIT) -> tuple[int, list[int]]:
    """rows (h: the group's hash, size, n: equal rows) to the least capacity and the first hash of each shard but the
    first."""

    def summed(df: DataFrame, bits) -> list[tuple[int, int, int, bool]]:
        start = F.expr(f"shiftleft(shiftright(h, {bits}), {bits})") if isinstance(bits, int) else F.coalesce(*(F.when(b, F.expr(f"shiftleft(shiftright(h, {k}), {k})")) for k, b in bits.items()))
        below = F.lit(bits) if isinstance(bits, int) else F.coalesce(*(F.when(b, F.lit(k)) for k, b in bits.items()))
        got = df.groupBy(start.alias("start"), below.alias("bits")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        return [(r.lo if r.lo == r.hi else r.start, r.bytes, r.bits, r.lo == r.hi) for r in got.collect()]

    ranges = Ranges(sorted(summed(rows, 64 - top_bits)))
    while True:
        low, high = ranges.least(n_shards, False), ranges.least(n_shards, True)
        wanted = ranges.open(low, high, n_shards)[:split] if low < high else []
        if not wanted:
            break
        by_bits: dict[int, list[int]] = {}
        for r in wanted:
            by_bits.setdefault(ranges.rows[r][2], []).append(ranges.rows[r][0])
        inside = {max(0, k - step_bits): F.expr(f"shiftleft(shiftright(h, {k}), {k})").isin(starts) for k, starts in by_bits.items()}
        some = None
        for b in inside.values():
            some = b if some is None else some | b
        finer = summed(rows.filter(some), inside)
        gone = set(wanted)
        ranges = Ranges(sorted([x for k, x in enumerate(ranges.rows) if k not in gone] + finer))
    return high, [ranges.rows[k][0] for k, _ in ranges.cuts(high, True)]


def sharded(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", part_rows: int | None = None, **how) -> DataFrame:
    """A row for each row of docs: id_col, size, text_crc32, shard, slot. how: of minimax_cuts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = staged(rows.groupBy("id", "size", "text_crc32", "h").agg(F.count("*").alias("n")), "sizes")
    part_rows = part_rows or max(PART_ROWS, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PARTS))
    _, cuts = minimax_cuts(rows, n_shards, **how)
    shard = F.lit(0)
    for c in cuts:  # under n_shards
        shard = shard + F.when(F.col("h") >= c, 1).otherwise(0)
    rows = rows.withColumns({"shard": shard.cast("int"), "range": F.shiftright("h", 64 - TOP_BITS).cast("int")})
    before = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    groups = groups.select("shard", "range", (1 + F.floor(F.col("n") / part_rows)).cast("int").alias("parts"), before("n", "shard", "range").alias("first"))
    # 2^TOP_BITS ranges, and those that a cut divides
    placed = rows.join(F.broadcast(groups), ["shard", "range"])
    # very many equal rows are counted in several parts
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part_rows))))
    placed = placed.withColumn("n", F.least(F.lit(part_rows), F.col("n") - F.col("copy") * part_rows)).withColumn("part", F.pmod(F.xxhash64("id", "size", "text_crc32", "copy"), "parts").cast("int"))
    parts = placed.groupBy("shard", "range", "part").agg(F.sum("n").alias("m")).select("shard", "range", "part", before("m", "shard", "range", "part").alias("before"))
    # PARTS and the number of ranges bound the table
    ranked = placed.join(F.broadcast(parts), ["shard", "range", "part"])
    order = F.sum("n").over(Window.partitionBy("shard", "range", "part").orderBy("id", "size", "text_crc32", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumn("at", F.col("first") + F.col("before") + order - F.col("n"))
    slots = F.sequence(F.col("at").cast("long"), (F.col("at") + F.col("n") - 1).cast("long"))
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.explode(slots).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: 16 shards of near equal bytes over all documents."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

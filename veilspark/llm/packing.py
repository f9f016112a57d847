"""Packing in optimal length buckets.

One histogram of all lengths (words) has a row for each length that occurs; dynamic programming over it chooses the
n_buckets upper lengths with the least padding in all, exactly. A bucket's batches hold as many documents as the token
budget has room for when each is padded to the bucket's length (one, if none fits). Within a bucket documents go by a
hash of id and text, however the table was read; numbering is by PARTS parts of the hash order with an offset for each,
so that no task gets a bucket. With blocks (of a mixed sequence) each block's documents have batches of their own.

The driver gets the histogram as two numbers a length. D different lengths are of texts with D * (D - 1) / 2 words at
least, so that D grows with the square root of the input at most: 100,000 for five thousand million words.

Cases: null and empty texts have length 0 and form documents like others; repeated rows are rows of their own; a text
longer than the budget has batches of one; null ids are kept; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.mixing import word_count
from veilspark.llm.shared import staged

PARTS = 1024
BUCKETS = 16
TOKEN_BUDGET = 8192


def best_edges(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, k: int) -> list[int]:
    """The at most k upper lengths with the least padding: lengths ascend, counts and sums are of their documents."""
    v = len(lengths)
    if not v:
        return []
    c = [0, *np.cumsum(counts, dtype=np.int64).tolist()]
    s = [0, *np.cumsum(sums, dtype=np.int64).tolist()]
    xs = np.asarray(lengths).tolist()
    best = [0] + [None] * v  # with no bucket only no length is covered
    back = []
    for _ in range(min(k, v)):
        # ending a bucket at x = xs[j] after one that ended before i costs best[i] + s[i] - c[i] * x, plus what depends
        # on j alone: the least of lines in x, whose slopes fall with i while x grows, so that one pass finds it
        new, at = [0] * (v + 1), np.zeros(v + 1, np.int32)
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, i
        head = 0
        for j in range(v):
            if best[j] is not None:
                m, b = -c[j], best[j] + s[j]
                while len(hull) - head > 1 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j))
            x = xs[j]
            while len(hull) - head > 1 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            new[j + 1] = hull[head][0] * x + hull[head][1] + x * c[j + 1] - s[j + 1]
            at[j + 1] = hull[head][2]
        back.append(at)
        best = new
    edges, j = [], v
    for at in reversed(back):
        if j:
            edges.append(int(lengths[j - 1]))
            j = int(at[j])
    return sorted(edges)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, block: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: id_col, length, bucket, padded_length, block, batch, place, and the columns of keep.

    block: a number of each row (null: -1); batches hold rows of one block alone, so that an order of blocks stays. Without
    it all rows are one block. The edges are of all rows."""
    rows = docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("length"), F.xxhash64(id_col, F.xxhash64(text_col)).alias("h"), F.coalesce(block if block is not None else F.lit(0), F.lit(-1)).cast("long").alias("block"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    rows = staged(rows.withColumn("part", (F.shiftright("h", 64 - 10) + PARTS // 2).cast("int")), "pack")
    found = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toArrow()
    lengths, counts = (found[c].to_numpy() for c in ("length", "n"))
    edges = best_edges(lengths, counts, lengths * counts, n_buckets) or [0]
    bucket, size = F.lit(len(edges) - 1), F.lit(edges[-1])
    for k in reversed(range(len(edges) - 1)):
        bucket = F.when(F.col("length") <= edges[k], k).otherwise(bucket)
        size = F.when(F.col("length") <= edges[k], edges[k]).otherwise(size)
    rows = rows.withColumns({"bucket": bucket.cast("int"), "padded_length": size.cast("long")})
    if block is not None:  # a block is a part of its own; large ones should be many
        rank = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("h", "id")).cast("long") - 1
    else:
        order = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = rows.groupBy("bucket", "part").agg(F.count("*").alias("n")).select("bucket", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
        # PARTS rows a bucket at most
        rows = rows.join(F.broadcast(before), ["bucket", "part"])
        rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", "id")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    rows = rows.withColumns({"rank": rank, "room": room})
    return rows.select(F.col("id").alias(id_col), "length", "bucket", "padded_length", "block", F.floor(F.col("rank") / F.col("room")).cast("long").alias("batch"), (F.col("rank") % F.col("room")).cast("int").alias("place"), *(F.col("kept")[c].alias(c) for c in keep))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in batches of 8192 words at most, in 16 length buckets."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("block")

"""What several operators of this subpackage need: shared storage, code shipping, numpy kernels over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.shipping import ship

#: Bytes of text that a numpy kernel works on at once (one longer text is worked on alone).
SLAB_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of its own for a
    local master (tests); with another master there is no such folder, so that it raises ValueError."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="veilspark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


_STAGED: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. The table stays, as results read it,
    until drop_staged()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_tables(spark: SparkSession) -> int:
    """How many tables staged() has written in this application and drop_staged() has left."""
    return len(_STAGED.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Deletes tables of staged() of this application, from the one numbered first up to last (all without it); says how
    many. Nothing that reads them may run any more."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    gone = paths[first:last]
    jvm = spark.sparkContext._jvm
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths[first:last] = []
    return len(gone)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it can reach.

    Alternates the large-star and small-star steps, each cut by a table in the shared folder, until only
    stars are left. Self loops and repeated edges are fine; no edges give no rows. A centre with very many neighbours is
    reduced by a partial minimum, and only its own edges meet it in a join that Spark may split.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    e = staged(directed(edges), "cc")
    # stars alone are left once no node is both an end and a centre
    while e.join(e.select(F.col("b").alias("c")), F.col("a") == F.col("c"), "left_semi").limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a moves to the smallest of a's neighbourhood
        large = e.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = directed(large)
        # small star: a and its smaller neighbours meet at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = staged(directed(small), "cc")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# ---- expressions on arrays -------------------------------------------------------------------------------------

#: Stands around matches while a text is cut at them; a text that holds it already is cut by the pattern alone.
MARK = "\x01"


def running(values: Column, more=None) -> Column:
    """Running sums of an array of numbers, in n log n steps: each step adds the value 1, 2, 4, ... places before. more: a
    function of (value, earlier value) in place of the sum, for which the order within a run of values doesn't matter."""
    more = more or (lambda x, y: x + y)
    strides = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(values))
    return F.aggregate(strides, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, more(x, F.get(acc, i - d))).otherwise(x)))


def parts(text: Column, pattern: str) -> Column:
    """text cut at the matches of a pattern (without groups that the caller needs): gap, match, gap, ..., gap. One pass of
    the pattern, compiled once. Make it a column of its own: occurrences() uses it several times."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    slow = F.flatten(F.zip_with(gaps, found, lambda g, f: F.when(f.isNull(), F.array(g)).otherwise(F.array(g, f))))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(marked)


def occurrences(cut: Column, left: int = 24, right: int = 8) -> Column:
    """array of struct(pos, txt, before, after) from a column of parts(): before and after are what stands around a match
    in its gaps, at most so many characters. (A substring of the whole text for each match would cost its position.)"""
    ends = running(F.transform(cut, F.length))
    # gap 0, match 1, gap 2, ...: the match at 2k - 1 begins where the part before it ends
    places = F.transform(ends, lambda e, i: F.struct(e.alias("pos"), F.get(cut, i + 1).alias("txt"), F.substring(F.get(cut, i), -left, left).alias("before"), F.substring(F.get(cut, i + 2), 1, right).alias("after"), (i % 2 == 0).alias("gap")))
    hits = F.filter(places, lambda p: p["gap"] & p["txt"].isNotNull())
    return F.transform(hits, lambda p: F.struct(*(p[c].alias(c) for c in ("pos", "txt", "before", "after"))))


def runs(ordered: Column, start, stop) -> Column:
    """Arrays of spans that overlap each other, directly or by others, in an array of spans ordered by start: nothing
    overlaps across two of them. start and stop give a span's ends."""
    reach = running(F.transform(ordered, lambda s: stop(s)), lambda x, y: F.greatest(x, y))
    held = F.struct(ordered.alias("s"), reach.alias("r"))

    def cut(h):
        first = F.filter(F.sequence(F.lit(0), F.size(h["s"]) - 1), lambda i: (i == 0) | (start(F.get(h["s"], i)) >= F.get(h["r"], i - 1)))
        firsts = F.struct(first.alias("f"), h["s"].alias("s"))
        return F.get(F.transform(F.array(firsts), lambda c: F.transform(c["f"], lambda a, k: F.slice(c["s"], a + 1, F.coalesce(F.get(c["f"], k + 1), F.size(c["s"])) - a))), F.lit(0))

    # a one-element array binds what is used for each element, so that it is worked out once
    return F.get(F.transform(F.array(held), cut), F.lit(0))


# ---- numpy kernels --------------------------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for each byte value, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLAB_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def piece_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes, equal hash, wherever they stand."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slabs(text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of an Arrow string array: first row, end row, UTF-8 bytes, offsets in them. Null counts as empty."""
    import pyarrow as pa

    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    n = len(text)
    if not n:
        return
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if text.null_count:  # bytes under a null may be anything
        valid = np.asarray(text.is_valid())
        if (np.diff(offs)[~valid] != 0).any():
            text = text.fill_null("")
            yield from slabs(text)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLAB_BYTES, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, and the first word of each text (one more at the end)."""
    solid = ~IS_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:] = solid[:-1]
    after[:-1] = solid[1:]
    first, last = offs[:-1], offs[1:] - 1
    filled = offs[1:] > offs[:-1]
    before[first[filled]] = False
    after[last[filled]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_sets(text, size: int = 5) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """For parts of an Arrow string array: the first row, each text's set of shingle hashes in ascending order, and a
    fingerprint of each set (0 for an empty one). Words are lower-cased in A-Z; a text with fewer words than size has
    its whole sequence as the one shingle."""
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for i, j, buf, offs in slabs(text):
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs)
        words = piece_hashes(buf, starts, ends)
        count = np.diff(first)
        whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            if len(whole):
                whole += words[k : k + len(whole)] * factors[k]
        whole = mix64(whole)
        sets, prints = [], np.zeros(j - i, np.uint64)
        for d in range(j - i):
            a, c = first[d], count[d]
            if c >= size:
                s = whole[a : a + c - size + 1].copy()
                s.sort()
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            elif c:
                s = mix64((words[a : a + c] * factors[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c))
            else:
                s = whole[:0]
            sets.append(s)
        sizes = np.array([len(s) for s in sets], np.int64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            flat = mix64(np.concatenate(sets) ^ _M1)
            sums = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[filled])
            prints[filled] = mix64(sums + sizes[filled].astype(np.uint64))
        yield i, sets, prints

"""N-gram Jaccard join by a prefix tree.

Each text is a set of shingle hashes in one global order (ascending hash). The join runs in these steps:

1. Every text gives its set size and a fingerprint of its set; equal sets are one class from here on.
2. A link needs an overlap of at least t of the larger set, so two linked sets share shingles among the first
   (1 - t) of each; here a slack of g more is taken, which then must hold several shared ones. These prefixes, as
   packed arrays, meet by shingle. The most frequent shingles, which step 1 counts in each of its batches, don't meet:
   they count as shared, come last in the order of frequency and are dealt by class. A class with too few shared
   shingles is linked with nothing. Of the others, each keeps its shared shingles but the most frequent ones that it
   could do without, and classes that meet at one of those are candidates of each other. (All these filters lose no
   link.)
3. The connected parts of the candidates are the units of the exact join. A unit's sets, ordered by how few of them have
   a shingle, go in a prefix tree whose nodes are runs of shingles; a probe walks it level by level, counts the overlap of each node once for all
   sets below it, and leaves the sets that can't reach the needed overlap with the rest of either set. What a probe
   links leaves the tree, and probes in its turn, so that each set probes once and a dense group is walked once.
   A part that is too large for a task is cut in chunks and each pair of chunks is a unit: nothing is left out.
4. The links' connected components are the result.

Memory of a task: one shuffle partition of packed prefixes, or one unit (UNIT_SHINGLES). The classes that share one
shingle meet in a task as packed ids (20 bytes each); a shingle that a batch of rows has in one of BATCH_SHARE prefix
entries, and all batches together HOT_CLASSES times, isn't met that way, so that no task has to hold its classes. Which ones
these are (at most HOT_SHINGLES, known to every task) changes what is shuffled where, and never the result.
Hashes have 64 bits: two different shingles or sets count as equal with a probability of about 2^-64 a pair.

Cases: a null or empty text, or one of white space, has no shingles and is linked with nothing, not even with its like;
equal non-empty sets are linked; repeated rows are rows of their own, with equal results; a null doc_id takes part but is
never a component_id unless nothing else is in its component. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import connected_components, partitions, shared_dir, shingle_sets, ship, staged

#: Shingles in a unit of the exact join: some 8 bytes each in the task, and as much again for the tree.
UNIT_SHINGLES = 4_000_000
#: Slack of the prefixes, as a part of the set.
SLACK = 0.15
#: Shingles that are dealt by class: those in one of BATCH_SHARE prefix entries of a batch (at least 4 times) and
#: HOT_CLASSES times in all of these counts, the HOT_SHINGLES most frequent of them.
BATCH_SHARE = 4096
HOT_CLASSES = 2000
HOT_SHINGLES = 4096
_HOT_ORDER = 1 << 48
_FLUSH = 400_000
#: Keys of a join that are dealt apart at most, from how many rows on, and to how many tasks each.
LARGEST = 4096
LARGE_ROWS = 300
SALT = 64


def _need(n: np.ndarray | int, num: int, den: int):
    """The least overlap that a set of n needs with any linked set: ceil(n * num / den)."""
    return -((-n * num) // den)


def _slack(n):
    return np.maximum(1, np.ceil(np.asarray(n) * SLACK)).astype(np.int64)


def _width(n: int, num: int, den: int) -> int:
    """How many of a set's shingles are its prefix."""
    return min(n, n - _need(n, num, den) + int(_slack(n)))


def _frequent(prefixes: dict[int, np.ndarray]) -> bytes | None:
    """The shingles that many prefixes of a batch's distinct sets have, and how many do: packed, or None."""
    flat = np.concatenate(list(prefixes.values()))
    tok, k = np.unique(flat, return_counts=True)
    many = k >= max(4, len(flat) / BATCH_SHARE)
    return np.concatenate([tok[many], k[many].astype(np.uint64)]).tobytes() if many.any() else None


def _frequent_rows(batches) -> Iterator:
    """Unpacks what _frequent() packed: (shingle, count)."""
    import pyarrow as pa

    for batch in batches:
        for x in batch.column(0):
            got = np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[: len(got) // 2]), pa.array(got[len(got) // 2 :])], ["tok", "k"])


def _hot_order(tok: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each shingle its place in the order of frequency if it is hot, else 0."""
    names, order = hot
    if not len(names):
        return np.zeros(len(tok), np.int64)
    at = np.minimum(np.searchsorted(names, tok), len(names) - 1)
    return np.where(names[at] == tok, order[at], 0)


def _prefix_rows(batches, size: int, num: int, den: int, pieces: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator:
    """The packed prefixes: rows (piece, shingles, classes, least count of shared shingles)."""
    import pyarrow as pa

    held: list[tuple] = []
    count = 0

    def flush():
        tok, cls, low = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.where(_hot_order(tok, hot) > 0, cls, tok)
        piece = ((by >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(piece, kind="stable")
        piece, tok, cls, low = piece[order], tok[order], cls[order], low[order]
        cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        pack = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(piece[cuts[:-1]], pa.int32()), pack(tok), pack(cls), pack(low)], ["piece", "tok", "cls", "low"])

    for batch in batches:
        for _, sets, prints in shingle_sets(batch.column(0), size):
            seen = set()
            for s, p in zip(sets, prints.tolist(), strict=True):
                n = len(s)
                if not n or p in seen:
                    continue
                seen.add(p)
                width = _width(n, num, den)
                held.append((s[:width], np.full(width, p, np.uint64), np.full(width, int(_slack(_need(n, num, den))), np.int32)))
                count += width
            if count >= _FLUSH:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _unpacked(batches, *kinds) -> list[np.ndarray]:
    """The packed columns after the first, each as one array over all rows."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            parts[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k + 1)]
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


def _shared_rows(batches, hot: tuple[np.ndarray, np.ndarray]) -> Iterator:
    """Of a partition of packed prefixes, the shingles that two classes or more have, and the hot ones:
    (class, shingle, classes, low)."""
    import pyarrow as pa

    tok, cls, low = _unpacked(batches, np.uint64, np.uint64, np.int32)
    if not len(tok):
        return
    order = np.lexsort((cls, tok))
    tok, cls, low = tok[order], cls[order], low[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
    tok, cls, low = tok[new], cls[new], low[new]
    heads = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    sizes = np.diff(np.append(heads, len(tok)))
    order = _hot_order(tok, hot)
    df = np.where(order > 0, order, np.repeat(sizes, sizes))
    keep = df > 1
    out = [cls[keep].view(np.int64), tok[keep].view(np.int64), df[keep], low[keep]]
    for i in range(0, len(out[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], ["cls", "tok", "df", "low"])


def _candidate_rows(batches) -> Iterator:
    """Of all shared shingles of some classes: links (kind 0) to the smallest class here that has the same shingle, and
    for each shingle (kind 1) that class, to be met with other partitions'."""
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    cls, tok, df, low = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(4))
    order = np.lexsort((tok, df, cls))
    cls, tok, low = cls[order], tok[order], low[order]
    heads = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    sizes = np.diff(np.append(heads, len(cls)))
    place = np.arange(len(cls)) - np.repeat(heads, sizes)
    keep = place <= np.repeat(sizes, sizes) - low
    cls, tok = cls[keep], tok[keep]
    if not len(cls):
        return
    order = np.lexsort((cls, tok))
    cls, tok = cls[order], tok[order]
    heads = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    least = np.repeat(cls[heads], np.diff(np.append(heads, len(tok))))
    pairs = np.unique(np.stack([cls, least], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    a = np.concatenate([pairs[:, 0], tok[heads]])
    b = np.concatenate([pairs[:, 1], cls[heads]])
    kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(heads)])
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (kind, a, b)], ["kind", "a", "b"])


class PrefixTree:
    """A prefix tree over integer sets, each in one order (the elements that fewest sets have first). A level holds the
    next run of each set's elements; sets with the same elements so far share a node.

    A probe starts at the sets that have one of its first elements among their own first ones: two sets that are linked
    always do (n less the needed overlap, and one more). Sets that were taken out are not found again.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.n) - self.n
        values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(values))
        self.flat = rank[back]
        for a, n in zip(self.start.tolist(), self.n.tolist(), strict=True):
            self.flat[a : a + n].sort()
        self.mark = np.zeros(len(values), bool)
        self.first = self.n - _need(self.n, num, den) + 1
        self.alive = np.ones(len(sets), bool)
        self._list()
        self.levels = []  # (node of each set or -1, first element of each node's run, its end, depth at its end)
        mixed = np.zeros(len(self.flat) + 1, np.uint64)
        up = np.random.default_rng(7).integers(1, 1 << 63, len(values), dtype=np.uint64)
        np.cumsum(up[self.flat], out=mixed[1:])
        at, width = 0, 8
        deepest = int(self.n.max())
        while at < deepest:
            live = np.flatnonzero(self.n > at)
            end = np.minimum(self.n[live], at + width)
            # a set's elements ascend, so that the sum of its first ones' random values names them
            key = mixed[self.start[live] + end] - mixed[self.start[live]] + end.astype(np.uint64)
            _, rep, node = np.unique(key, return_index=True, return_inverse=True)
            of = np.full(len(sets), -1, np.int64)
            of[live] = node
            lead = live[rep]
            self.levels.append((of, self.start[lead] + at, self.start[lead] + np.minimum(self.n[lead], at + width), end[rep]))
            at += width
            width = min(2 * width, 4096) if len(self.levels) > 1 else 8

    def _list(self) -> None:
        """Lists, for each element, the sets that have it among their first ones."""
        sets = np.flatnonzero(self.alive)
        size = self.first[sets]
        owner = np.repeat(sets, size)
        ends = np.cumsum(size)
        element = self.flat[np.arange(len(owner)) + np.repeat(self.start[sets] - (ends - size), size)]
        order = np.argsort(element, kind="stable")
        self.owner, self.bounds = owner[order], np.searchsorted(element[order], np.arange(len(self.mark) + 1))
        self.listed = len(sets)

    def remove(self, sets: np.ndarray) -> None:
        self.alive[sets] = False
        if 2 * np.count_nonzero(self.alive) < self.listed:
            self._list()

    def probe(self, p: int) -> np.ndarray:
        """The sets that are linked with the set at p, of those in the tree."""
        np_, own = int(self.n[p]), self.flat[self.start[p] : self.start[p] + self.n[p]]
        head = own[: self.first[p]]
        lo, hi = self.bounds[head], self.bounds[head + 1]
        size = hi - lo
        ends = np.cumsum(size)
        met = np.unique(self.owner[np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)])
        ds = met[self.alive[met]]
        n = self.n[ds]
        # num/den is the least Jaccard similarity: den * I >= num * (union)
        ds = ds[(n * self.den >= np_ * self.num) & (np_ * self.den >= n * self.num)]
        need = -((-(np_ + self.n[ds]) * self.num) // (self.num + self.den))
        over = np.zeros(len(ds), np.int64)
        found = []
        self.mark[own] = True
        for of, a, b, depth in self.levels:
            if not len(ds):
                break
            nodes, back = np.unique(of[ds], return_inverse=True)
            lo, hi = a[nodes], b[nodes]
            size = hi - lo
            ends = np.cumsum(size)
            take = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
            got = np.add.reduceat(self.mark[self.flat[take]].astype(np.int64), ends - size)
            left = np_ - np.searchsorted(own, self.flat[hi - 1], "right")
            over += got[back]
            hit = over >= need
            if hit.any():
                found.append(ds[hit])
            more = ~hit & (over + np.minimum(left[back], self.n[ds] - depth[nodes][back]) >= need)
            ds, need, over = ds[more], need[more], over[more]
        self.mark[own] = False
        return np.concatenate(found) if found else ds[:0]


def linked_roots(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each non-empty ordered set, the first set of its component under 'Jaccard similarity at least num/den'."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    tree = PrefixTree(sets, num, den)
    for r in range(len(sets)):
        if not tree.alive[r]:
            continue
        tree.remove(np.array([r]))
        queue = [r]
        while queue and tree.listed:
            links = tree.probe(queue.pop())
            root[links] = r
            queue += links.tolist()
            tree.remove(links)
    return root


def _unit_rows(batches, num: int, den: int) -> Iterator:
    """Rows (unit, class, set) in order of unit to the links (class, root) that connect each unit's components."""
    import pyarrow as pa

    def done(cls, sets):
        order = np.argsort(np.array(cls))
        cls = np.array(cls)[order]
        first = np.concatenate(([True], cls[1:] != cls[:-1]))
        cls, order = cls[first], order[first]
        root = linked_roots([np.frombuffer(sets[k], np.uint64) for k in order], num, den)
        move = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(cls[move]), pa.array(cls[root[move]])], ["a", "b"])

    unit, cls, sets = None, [], []
    for batch in batches:
        for u, c, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if u != unit and sets:
                yield done(cls, sets)
                cls, sets = [], []
            unit = u
            cls.append(c)
            sets.append(s)
    if sets:
        yield done(cls, sets)


def _largest(counted: DataFrame, key: str) -> list[int]:
    """The keys with most rows, LARGEST at most, of those with LARGE_ROWS."""
    return [r[0] for r in counted.filter(F.col("rows") >= LARGE_ROWS).orderBy(F.desc("rows"), key).limit(LARGEST).select(key).collect()]


def _met(many: DataFrame, one: DataFrame, key: str, hot: list[int], *spread: str) -> DataFrame:
    """many's rows with those of one (a row for each key); rows of hot keys are dealt by a hash of the columns in spread."""
    if not hot:
        return many.join(one, key)
    apart = F.col(key).isin(hot)
    salted = many.withColumn("salt", F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int")).otherwise(0))
    copies = F.explode(F.when(apart, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(one.withColumn("salt", copies), [key, "salt"]).drop("salt")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (3, 4), unit_shingles: int = UNIT_SHINGLES, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, class (fingerprint of the set), component_id.

    Two texts link when den * |A and B| >= num * |A or B| for threshold (num, den). See the module for the method and
    for null, empty and repeated input.
    """
    spark = docs.sparkSession
    ship(spark)
    num, den = threshold
    pieces = 8 * partitions(spark)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def described(batches):
        import pyarrow as pa

        for batch in batches:
            n, prints, often, held, count = [], [], [], {}, 0
            for _, sets, fp in shingle_sets(batch.column(1), size):
                n += [len(s) for s in sets]
                prints.append(fp.view(np.int64))
                for s, p in zip(sets, prints[-1].tolist(), strict=True):
                    held[p] = s[: _width(len(s), num, den)].copy()
                    count += len(held[p])
                often += [None] * len(sets)
                if count >= _FLUSH:
                    often[-1], held, count = _frequent(held), {}, 0
            cls = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            if count:
                often[-1] = _frequent(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls), batch.column(2), pa.array(often, pa.binary())], ["id", "n", "cls", "key", "often"])

    kind = dict(text.dtypes)["id"]
    described_rows = staged(text.withColumn("key", F.xxhash64("text")).mapInArrow(described, f"id {kind}, n long, cls long, key long, often binary"), "sets")
    rows = described_rows.drop("often")
    often = described_rows.select("often").filter("often is not null").mapInArrow(_frequent_rows, "tok long, k long")
    often = often.groupBy("tok").agg(F.sum("k").alias("k")).filter(F.col("k") >= hot_classes).orderBy(F.desc("k"), "tok").limit(HOT_SHINGLES)
    found = sorted((r.tok % (1 << 64), _HOT_ORDER + r.k) for r in often.collect())
    hot = (np.array([t for t, _ in found], np.uint64), np.array([k for _, k in found], np.int64))
    classes = rows.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("rep"), F.count("*").alias("rows"))

    n_parts = partitions(spark)
    prefixes = text.select("text").mapInArrow(lambda b: _prefix_rows(b, size, num, den, pieces, hot), "piece int, tok binary, cls binary, low binary")
    shared = prefixes.repartition(n_parts, "piece").mapInArrow(lambda b: _shared_rows(b, hot), "cls long, tok long, df long, low int")
    met = staged(shared.repartition(n_parts, "cls").mapInArrow(_candidate_rows, "kind int, a long, b long"), "met")
    across = met.filter("kind = 1").groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs")).filter("size(bs) > 1")
    across = across.select(F.explode("bs").alias("a"), F.col("m").alias("b"))
    parts = connected_components(met.filter("kind = 0").select("a", "b").union(across))

    members = staged(parts.withColumnRenamed("node", "cls").join(classes.select("cls", "n", "rep"), "cls"), "members")
    volume = members.groupBy("root").agg(F.ceil(2 * F.sum("n") / unit_shingles).cast("int").alias("v"))
    volume = volume.select("root", F.when(F.col("v") <= 2, 1).otherwise(F.col("v")).alias("chunks"))
    cut = bool(volume.filter("chunks > 1").limit(1).count())
    chosen = members.join(volume, "root").select(F.col("rep.id").alias("rid"), F.col("rep.key").alias("rkey"), "cls", "root", "chunks")
    # a merge join at any size: how much is shuffled follows the input evenly
    full = text.withColumn("key", F.xxhash64("text")).join(chosen.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")))

    def with_sets(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for _, sets, _ in shingle_sets(batch.column(3), size):
                out += [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["cls", "root", "chunks", "set"])

    sets = full.select("cls", "root", "chunks", "text").mapInArrow(with_sets, "cls long, root long, chunks int, set binary")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    units = sets.withColumn("own", own).select("cls", "root", F.explode(pairs).alias("p"), "set")
    units = units.select(F.xxhash64("root", "p.i", "p.j").alias("unit"), "cls", "set")
    links = units.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInArrow(lambda b: _unit_rows(b, num, den), "a long, b long")
    links = staged(links, "links")
    # the links of whole parts are stars already; those of chunks have to meet
    roots = connected_components(links) if cut else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # the rows of the largest classes and the classes of the largest components are dealt to SALT tasks each; with
    # LARGEST of them apart, each of the others has one in LARGEST of all rows at most. Rows without shingles meet nothing
    hot_roots, hot_cls = _largest(placed.groupBy("root").agg(F.count("*").alias("rows")), "root"), _largest(classes, "cls")
    ids = _met(placed, smallest, "root", hot_roots, "cls").select("cls", "component_id")
    out = _met(rows.filter("n > 0"), ids, "cls", hot_cls, "id", "key").unionByName(rows.filter("n = 0").withColumn("component_id", F.lit(None).cast(kind)))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("text_hash"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of rows with that id one. Rows without
    shingles or without an id all stay."""
    found = ngram_components(docs, id_col, text_col, **how).select(F.col(id_col).alias("_j_id"), F.col("text_hash").alias("_j_key"), "n_shingles", "component_id")
    linked = staged(found.filter("n_shingles > 0 and _j_id is not null").drop("n_shingles"), "linked")
    heads = linked.filter("_j_id = component_id").groupBy("component_id").agg(F.min("_j_key").alias("head"), F.count("*").alias("rows"))
    gone = linked.join(heads, "component_id").filter("_j_id <> component_id or _j_key <> head").select("_j_id", "_j_key").distinct()
    same = lambda other: (docs[id_col] == other["_j_id"]) & (F.xxhash64(docs[text_col]) == other["_j_key"])
    out = docs.join(gone, same(gone), "left_anti")
    repeated = heads.filter("rows > 1").select(F.col("component_id").alias("_j_id"), F.col("head").alias("_j_key"))
    if repeated.limit(1).count():  # rows with the same id and text
        once = docs.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(repeated, (out[id_col] == repeated["_j_id"]) & (F.xxhash64(out[text_col]) == repeated["_j_key"]), "left_anti").unionByName(once)
    return out


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id over all documents, five words and 75 of 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_components(docs).select("doc_id", "n_shingles", "component_id")

"""Batches: many documents with one dictionary and one mapping, review, versions, refinement, progress and expiry.

in order: documents one after the other in order of idx, each with the names of those before it. A batch is one fold in
one task, as the feedback from document to document asks for; batches are independent of each other. A document that
fails is a row with its error, and the others go on. global: all documents at once; names are numbered over the whole
batch by (type, length, name), so that equal names have equal placeholders everywhere and the work is parallel; the
numbers differ from those in order.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import masks, spans as sp
from veilspark.functions.shipping import ship, span_lists, struct_maps, tuples, with_columns_from
from veilspark.functions.spans import Occupied
from veilspark.operators.detect import Layers, detect
from veilspark.operators.dictionary import Held

MAPPING = f"map<string,{masks.FACT}>"
#: Names that are broadcast in global mode: the most frequent ones; the others have few rows each.
FREQUENT = 4096
#: Documents of a fold whose results are sent on at once.
ROWS = 512


def masked_in_order(items: DataFrame, by: str = "batch", dictionary: Sequence[tuple[str, str]] = (), mapping: dict | None = None, scoped: dict[int, Sequence[tuple[str, str]]] | None = None, excluded: dict[int, Sequence[tuple[str, str]]] | None = None, style: str = "english_bracket", overrides: dict[str, str] | None = None, everything: str | None = None, **how) -> DataFrame:
    """items (by, idx, text) to by, idx, status (done or error), error, masked_text, placeholders (used in it, ascending),
    mapping (its own entries). mapping: what all batches start with; scoped, excluded: (type, name) added to, or taken
    from, what is found in the document with an idx. A task goes through its batches row by row, sorted by batch and idx
    (equal ones by text); the mapping of one batch is in its memory, its texts aren't."""
    ship(items.sparkSession)
    if style not in masks.STYLES:
        raise ValueError(f"style is one of {tuple(masks.STYLES)}")
    chosen, first, extra, gone = masks.strategies(overrides, everything), dict(mapping or {}), dict(scoped or {}), {k: set(v) for k, v in (excluded or {}).items()}
    entries = list(dict.fromkeys(dictionary))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        knowing = lru_cache(256)(Layers(**how).knowing)  # the same few names stand in many documents
        batch, fold = None, None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                rows = []
                for key, idx, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if fold is None or not (key == batch or (key != key and batch != batch)):
                        batch, fold = key, Fold()
                    rows.append(fold.one(knowing, idx, text or ""))
                new = [struct_maps(v, t) if pa.types.is_map(t) else pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], [by, "idx", *made.names])

    class Fold:
        """One batch so far."""

        def __init__(self):
            self.known, self.names = masks.Known({k: (v["type"], v["original"]) for k, v in first.items()}), Held(entries)
            self.given = len(self.names.entries)
            for t, n in self.known.owner.values():
                self.names.add(t, n)

        def one(self, knowing, idx, text):
            try:
                known, names = self.known, self.names
                held = names(text)
                at = bisect_left(held, self.given)
                wanted = [*(names.entries[k] for k in held[:at]), *((t, n) for t, n in extra.get(idx, ()) if n and n in text), *(names.entries[k] for k in held[at:])]
                spans, short = knowing(tuple(wanted))([text])[0]
                spans = [s[:3] for s in spans if (s[2], s[1]) not in gone.get(idx, ())]
                out, facts, log, free = masks.mask_with(known, text, spans, chosen, style, short, logged=False)
                mine = {x: known.owner.get(x) for x in log}
                row = ("done", None, out, sorted(mine), [(k, facts[k] if old is None else masks.fact(*old)) for k, old in mine.items()])
                known.learn(facts, free)
                for v in facts.values():
                    names.add(v["type"], v["original"])
                return row
            except Exception as e:  # one document's failure is its own
                return ("error", f"{type(e).__name__}: {e}"[:500], None, [], [])

    made = T.StructType.fromDDL(f"status string, error string, masked_text string, placeholders array<string>, mapping {MAPPING}")
    rows = items.select(by, F.col("idx").cast("long").alias("idx"), "text")
    n = max(items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a number of its own: small rows are long work, and would be put together in a few tasks
    rows = rows.repartition(n, by).sortWithinPartitions(by, "idx", "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *made.fields]))


def run_exact(items: DataFrame, dictionary: Sequence[tuple[str, str]] = (), mapping: dict | None = None, **how) -> tuple[list[dict], dict]:
    """One batch (idx, text) to (rows with idx, status, error, masked_text, placeholders; the mapping after all of them).
    For batches of some hundred documents: their rows and the mapping are in the driver's memory."""
    rows, known = [], dict(mapping or {})
    for r in masked_in_order(items.withColumn("batch", F.lit(0)), "batch", dictionary, mapping, **how).orderBy("idx").collect():
        known |= {k: v.asDict() for k, v in (r["mapping"] or {}).items()}
        rows.append({k: r[k] for k in ("idx", "status", "error", "masked_text", "placeholders")})
    return rows, known


def reviewed(found: DataFrame, review: DataFrame) -> tuple[dict[int, list], dict[int, list]]:
    """(scoped, excluded) for masked_in_order() from a review (idx, action, type, name, new_name): deleted findings are taken
    away; edited ones too, and their new names are added to the same document; custom names are added. Findings that a
    review names but that weren't found change nothing. Reviews are as many as a person makes."""
    scoped: dict[int, list] = {}
    excluded: dict[int, list] = {}
    had = review.join(found.select("idx", "type", F.col("text").alias("name")).distinct().withColumn("had", F.lit(True)), ["idx", "type", "name"], "left")
    for r in had.orderBy("idx", "type", "name").collect():
        if r.action in ("deleted", "edited") and r.had:
            excluded.setdefault(r.idx, []).append((r.type, r.name))
        if r.action == "edited" and r.had and (r.new_name or "").strip():
            scoped.setdefault(r.idx, []).append((r.type, r.new_name.strip()))
        if r.action == "custom" and (r.name or "").strip():
            scoped.setdefault(r.idx, []).append((r.type or "other", r.name.strip()))
    return scoped, excluded


def _longest(spans: list[tuple]) -> list[tuple]:
    """Spans that stay where longer ones, then earlier ones, come first."""
    taken = Occupied()
    return [s for s in sorted(spans, key=lambda s: (-len(s[1]), s[0], s[1], s[2])) if taken.take(s[0], s[0] + len(s[1]))]


def _kept(df: DataFrame) -> DataFrame:
    """df worked out once: checkpointed, or kept on the executors' disks where spark.checkpoint.dir isn't set."""
    sc = df.sparkSession.sparkContext
    return df.persist(StorageLevel.DISK_ONLY) if sc._jsc.sc().getCheckpointDir().isEmpty() else df.checkpoint()


def run_global(items: DataFrame, dictionary: Sequence[tuple[str, str]] = (), style: str = "english_bracket", id_col: str = "idx", **how) -> tuple[DataFrame, DataFrame]:
    """(id_col, masked_text; mapping rows placeholder, type, original): one pass to detect, one shuffle by name to number.
    All spans become placeholders; rows that share an id are rows of their own.

    Numbers are ranks within a label by (length, long first, name, type), in two steps (counts of ranges of names, then
    within a range), so that no task holds all names of a label. Detection runs once: its result is checkpointed, or kept on
    disk where no folder is set.
    """
    df = detect(items.select(id_col, "text"), dictionary, **how)
    df = with_columns_from(df, ["spans"], f"sel array<{sp.SPAN}>", lambda rows: [span_lists([_longest(r) for r in tuples(rows, *sp.FIELDS)])])
    df = df.select(id_col, "text", "sel").withColumn("_row", F.monotonically_increasing_id())
    df = _kept(df)
    label = masks._lookup(masks.labels(style), F.col("etype"), "UNKNOWN")
    names = df.select(F.inline("sel")).groupBy("etype", "txt").agg(F.count("*").alias("uses")).withColumn("label", label).withColumn("short", -F.length("txt"))
    # ranks by ranges of the order: each range is one partition, and its names count from where the ranges before it end
    names = _kept(names.repartitionByRange("label", "short", "txt", "etype").withColumn("range", F.spark_partition_id()))
    before = names.groupBy("label", "range").agg(F.count("*").alias("n"))
    before = before.select("label", "range", F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("label", "range").orderBy("short", "txt", "etype"))
    left, right = masks.STYLES[style]
    sep = "_" if style == "english_bracket" else ""
    numbered = names.join(before, ["label", "range"]).select(F.concat(F.lit(left), "label", F.lit(sep), number.cast("string"), F.lit(right)).alias("placeholder"), F.col("etype").alias("type"), F.col("txt").alias("original"), "uses")
    rows = df.select("_row", F.inline("sel"))
    same = (F.col("etype") == F.col("type")) & (F.col("txt") == F.col("original"))
    often = numbered.orderBy(F.desc("uses"), "type", "original").limit(FREQUENT)  # the others meet their rows in a shuffle
    rest = rows.join(F.broadcast(often), same, "left_anti").join(numbered, same)
    used = rows.join(F.broadcast(often), same).unionByName(rest)
    used = used.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "txt", F.col("placeholder").alias("m")))).alias("r"))

    def spliced(texts, marks):
        out = []
        for t, ms in zip(texts.to_pylist(), tuples(marks, "pos", "txt", "m"), strict=True):
            if t is None or not ms:
                out.append(t)
                continue
            at, parts = 0, []
            for p, x, m in ms:
                parts += [t[at:p], m]
                at = p + len(x)
            out.append("".join([*parts, t[at:]]))
        return [out]

    out = with_columns_from(df.select("_row", id_col, "text").join(used, "_row", "left"), ["text", "r"], "masked_text string", spliced)
    return out.select(id_col, "masked_text"), numbered.select("placeholder", "type", "original")


def updated(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """mapping with new rows in place of those with the same placeholder."""
    return mapping.join(new, "placeholder", "left_anti").unionByName(new)


def refined(items: DataFrame, dictionary: Sequence[tuple[str, str]], mapping: dict, additions: Sequence[tuple[str, str]], targets: Sequence[int] | None = None, **how) -> tuple[list[dict], dict, list[tuple[str, str]]]:
    """The next version: (rows, mapping, dictionary). Originals are masked again with the larger dictionary; old
    placeholders stay. Raises ValueError if there is nothing new."""
    new = [x for x in dict.fromkeys(additions) if x not in set(dictionary)]
    if not new:
        raise ValueError("nothing new to mask")
    wider = [*dictionary, *new]
    chosen = items if targets is None else items.filter(F.col("idx").isin(list(targets)))
    rows, mapping = run_exact(chosen, wider, mapping, **how)
    return rows, mapping, wider


def mapping_document(mapping: dict, batch_id: str, version: int) -> str:
    """The exported mapping of a version as JSON: format_version 2, no contexts."""
    facts = ("type", "original", "is_abbreviation", "full_name", "full_placeholder")
    return json.dumps({"format_version": 2, "batch_id": batch_id, "version": version, "mapping": {k: {f: v.get(f) for f in facts} for k, v in sorted(mapping.items())}}, ensure_ascii=False, indent=1)


class History:
    """A batch's versions: rows, mapping and dictionary of each; originals are masked again for every version."""

    def __init__(self, items: DataFrame, dictionary: Sequence[tuple[str, str]] = (), **how):
        self.items, self.how = items, how
        rows, mapping = run_exact(items, dictionary, **how)
        self.versions = [{"version": 1, "rows": {r["idx"]: r for r in rows}, "mapping": mapping, "dictionary": list(dictionary)}]
        self.running = False

    def refine(self, additions: Sequence[tuple[str, str]], targets: Sequence[int] | None = None) -> dict:
        """The next version; documents that aren't targets keep their rows. RuntimeError while another one is made."""
        if self.running:
            raise RuntimeError("a version is being made")
        self.running = True
        try:
            last = self.versions[-1]
            rows, mapping, wider = refined(self.items, last["dictionary"], last["mapping"], additions, targets, **self.how)
            self.versions.append({"version": last["version"] + 1, "rows": last["rows"] | {r["idx"]: r for r in rows}, "mapping": mapping, "dictionary": wider})
            return self.versions[-1]
        finally:
            self.running = False


def relations_cleaned(rel: DataFrame) -> DataFrame:
    """type, full_name, abbreviation: trimmed, under 501 characters, different from each other, once each."""
    t = rel.select(*(F.trim(c).alias(c) for c in ("type", "full_name", "abbreviation")))
    return t.filter("full_name <> '' and abbreviation <> '' and full_name <> abbreviation and length(full_name) <= 500 and length(abbreviation) <= 500").dropDuplicates()


def progress(items: DataFrame, status: str = "status") -> DataFrame:
    """total, done (or failed), percent."""
    done = F.count_if(F.col(status).isin("done", "error"))
    return items.agg(F.count("*").alias("total"), done.alias("done"), F.floor(100 * done / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("percent"))


def unexpired(rows: DataFrame, ts: str, now, hours: dict[str, float], kind: str) -> DataFrame:
    """Rows younger than their kind's hours."""
    limit = F.lit(None).cast("double")
    for k, h in hours.items():
        limit = F.when(F.col(kind) == k, F.lit(float(h))).otherwise(limit)
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col(ts))) / 3600.0
    return rows.filter(limit.isNull() | (age < limit))


def restore_report(texts: DataFrame, mapping: Sequence[tuple[str, str]], id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """id_col, restored_text, occurrences (of the placeholders of one dictionary) for many texts: placeholders are replaced
    one after the other, longer ones first, as in restored(); only those that a text holds cost anything."""
    order = sorted({p: o for p, o in mapping if p and o}.items(), key=lambda x: (-len(x[0]), x[0]))
    brackets = sorted({p[0] for p, _ in order})

    def run(rows):
        texts, counts = [], []
        for t in rows.to_pylist():
            if t is not None and any(b in t for b in brackets):
                held = [(p, o, t.count(p)) for p, o in order if p in t]
                n = sum(k for *_, k in held)
                for p, o, _ in held:
                    t = t.replace(p, o)
            else:
                n = 0
            texts.append(t)
            counts.append(n)
        return [texts, counts]

    return with_columns_from(texts.select(id_col, F.col(text_col).alias("_text")), ["_text"], "restored_text string, occurrences long", run).drop("_text")

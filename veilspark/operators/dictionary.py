"""Dictionaries of names: cleaning, merging, scopes, and where their names occur."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.shipping import span_lists, with_columns_from
from veilspark.functions import spans as sp

#: Bytes of names that a task may hold.
AUTOMATON_BYTES = 256 << 20


def cleaned(entries: DataFrame) -> DataFrame:
    """type, name, item_indices: trimmed, default type other, without empty names and those over 500 characters, once
    each; scopes ascend without repeats."""
    trim = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    scope = F.array_sort(F.array_distinct(F.coalesce(F.col("item_indices"), F.array().cast("array<int>")))) if "item_indices" in entries.columns else F.array().cast("array<int>")
    out = entries.select(F.when(trim("type") == "", F.lit("other")).otherwise(trim("type")).alias("type"), trim("name").alias("name"), scope.alias("item_indices"))
    return out.filter("name <> '' and length(name) <= 500").groupBy("type", "name").agg(F.min("item_indices").alias("item_indices"))


def added(current: DataFrame, additions: DataFrame) -> DataFrame:
    """Those additions, cleaned, that current lacks (by type, name and scope): their count is the number added."""
    return cleaned(additions).join(current, ["type", "name", "item_indices"], "left_anti").select(current.columns)


def merged(current: DataFrame, additions: DataFrame) -> DataFrame:
    """current and those additions that it lacks."""
    return current.unionByName(added(current, additions))


def replaced(current: DataFrame, entries: DataFrame) -> DataFrame:
    """A session's dictionary set anew: entries, cleaned, in place of current's."""
    return cleaned(entries).select(current.columns)


def without(current: DataFrame, removed: DataFrame) -> DataFrame:
    return current.join(removed.select("type", "name").distinct(), ["type", "name"], "left_anti")


def for_item(dictionary: DataFrame, item: int, mapping: DataFrame | None = None) -> DataFrame:
    """type, name that hold for one item: unscoped entries, those scoped to it, and all originals of a mapping."""
    own = dictionary.filter(F.col("item_indices").isNull() | (F.size("item_indices") == 0) | F.array_contains("item_indices", item)).select("type", "name")
    return (own if mapping is None else own.union(mapping.select("type", F.col("original").alias("name")))).distinct()


class Search:
    """Finds the names of a dictionary (type, name) in texts: one automaton for all names, built once in a task."""

    def __init__(self, entries: Iterable[tuple[str, str]], only: list[str] | None = None, exclude: list[str] | None = None):
        self.wanted = [(t, n) for t, n in dict.fromkeys(entries) if n and (not only or t in only) and t not in (exclude or ())]
        if sum(len(n.encode()) for _, n in self.wanted) > AUTOMATON_BYTES:
            raise ValueError("the dictionary is too large for a task: split it by type and union the spans")
        self.automaton = None

    def __getstate__(self):
        return {"wanted": self.wanted, "automaton": None}

    def __call__(self, text: str) -> list[tuple]:
        """Spans in order of the dictionary, then position; occurrences of one name don't overlap each other."""
        if not self.wanted or not text:
            return []
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            by_name: dict[str, list[tuple[int, str]]] = {}
            for k, (t, n) in enumerate(self.wanted):
                by_name.setdefault(n, []).append((k, t))
            for n, types in by_name.items():
                self.automaton.add_word(n, (n, types))
            self.automaton.make_automaton()
        last, found = {}, []
        for stop, (n, types) in self.automaton.iter(text):
            at = stop - len(n) + 1
            if at >= last.get(n, 0):
                last[n] = stop + 1
                found += [(k, at, n, t) for k, t in types]
        return [(p, n, t, "custom", 0, 0) for _, p, n, t in sorted(found)]


class Held:
    """Which names of a growing list a text holds. Names are found by their first characters and their length, so that a
    look-up costs the text's length and not the number of names."""

    HEAD, FEW = 4, 16

    def __init__(self, entries: Iterable[tuple[str, str]] = ()):
        self.entries: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.heads: dict[int, dict[str, dict[int, dict[str, list[int]]]]] = {}
        for t, n in entries:
            self.add(t, n)

    def add(self, etype: str, name: str) -> None:
        if name and (etype, name) not in self.seen:
            self.seen.add((etype, name))
            head = name[: self.HEAD]
            self.heads.setdefault(len(head), {}).setdefault(head, {}).setdefault(len(name), {}).setdefault(name, []).append(len(self.entries))
            self.entries.append((etype, name))

    def __call__(self, text: str) -> list[int]:
        """Places in the list, ascending."""
        if len(self.entries) <= self.FEW:
            return [k for k, (_, n) in enumerate(self.entries) if n in text]
        found: set[int] = set()
        for size, heads in self.heads.items():
            for at in range(len(text) - size + 1):
                for length, names in heads.get(text[at : at + size], {}).items():
                    found.update(names.get(text[at : at + length], ()))
        return sorted(found)


def with_dictionary_spans(docs: DataFrame, entries: list[tuple[str, str]], text_col: str = "text", only: list[str] | None = None, exclude: list[str] | None = None, into: str = "custom_spans") -> DataFrame:
    """docs with the spans of dictionary names (type, name); see Search, whose size is checked before it's sent."""
    search = Search(entries, only, exclude)
    return with_columns_from(docs, [text_col], f"{into} array<{sp.SPAN}>", lambda texts: [span_lists([search(t) for t in texts.to_pylist()])])


class UserDictionary:
    """A stored dictionary (type, name, item_indices) in a folder: each change writes a new version beside the old one and
    then moves a pointer file, so that a reader never meets half a change. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> list[str]:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        place = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
        return sorted(f.getPath().toString() for f in fs.listStatus(place) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if fs.exists(place) else []

    def entries(self) -> DataFrame:
        """type, name, item_indices of the last whole version."""
        have = self._versions()
        empty = self.spark.createDataFrame([], "type string, name string, item_indices array<int>")
        return self.spark.read.schema(empty.schema).parquet(have[-1]) if have else empty

    def _store(self, rows: DataFrame) -> None:
        have = self._versions()
        number = int(have[-1].rsplit("v", 1)[1]) + 1 if have else 1
        rows.select("type", "name", "item_indices").coalesce(1).write.parquet(f"{self.folder}/v{number:09d}")

    def add(self, additions: DataFrame) -> int:
        """Adds what is new (cleaned); says how many."""
        current = self.entries()
        new = added(current, additions)
        n = new.count()
        if n:
            self._store(current.unionByName(new))
        return n

    def remove(self, removed: DataFrame) -> int:
        """Takes entries of these (type, name) away; says how many."""
        current = self.entries()
        kept = without(current, removed)
        n = current.count() - kept.count()
        if n:
            self._store(kept)
        return n

    def clear(self) -> None:
        self._store(self.entries().limit(0))

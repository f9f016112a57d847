"""Detection: dictionary, pattern, rule-entity and model layers fused into one array of spans in each document's row.

One pass in Arrow batches, without a shuffle: a text crosses to Python once and meets all layers there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import names, patterns, spans as sp
from veilspark.functions.shipping import span_lists, with_columns_from
from veilspark.functions.spans import Occupied
from veilspark.operators.dictionary import Search

#: A model layer: texts to lists of (position, text, type); runs in Python workers.
Detector = Callable[[list[str]], list[list[tuple[int, str, str]]]]
# Which rule types a model's span of a type may take a longer match from.
COMPATIBLE = {"company": {"company"}, "institution": {"institution", "company"}, "government": {"government"}, "person": {"person"}, "full_address": {"full_address", "house_number"}}


def model_wins(model: tuple[int, str, str], rule: tuple[int, str, str]) -> bool:
    """Whether a model's span takes the place of a rule's span that it overlaps."""
    (p, t, kind), (rp, rt, rkind) = model, rule
    covers = p <= rp and p + len(t) >= rp + len(rt)
    inside = rp <= p and rp + len(rt) >= p + len(t)
    return (
        (rkind == "person" and kind in ("company", "institution", "government"))
        or (rkind == kind == "person" and (len(t) > len(rt) or (len(t) >= 3 and t[:2] in names.COMPOUND_SURNAMES)))
        or (kind == "full_address" and rkind in ("house_number", "postal_code", "full_address") and covers and len(t) > len(rt))
        or (rkind in COMPATIBLE.get(kind, ()) and inside and len(t) < len(rt) <= 2 * len(t))
    )


def arbitrated(rules: list[tuple[int, str, str]], model: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """rules with each of model's spans that overlaps nothing, or wins against all that it overlaps (these go)."""
    at = lambda s: (s[0], s[0] + len(s[1]))
    out, taken = dict.fromkeys(rules), Occupied(map(at, rules))
    for m in model:
        a, b = at(m)
        met = [] if taken.free(a, b) else [r for r in out if a < r[0] + len(r[1]) and r[0] < b]
        if all(model_wins(m, r) for r in met):
            for r in met:
                del out[r]
            out[m] = None
            taken.add(a, b)
    return list(out)


def filled(kept: list[tuple[int, str, str]], more: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """kept and, in order, those of more that overlap nothing so far."""
    taken = Occupied((p, p + len(t)) for p, t, _ in kept)
    return [*kept, *(m for m in more if taken.take(m[0], m[0] + len(m[1])))]


class Layers:
    """All layers over a batch of texts; see detect()."""

    def __init__(self, dictionary: Sequence[tuple[str, str]] = (), only: list[str] | None = None, exclude: list[str] | None = None, entities: bool = True, arbiter: Detector | None = None, detectors: Sequence[Detector] = (), expand: bool = True, surnames: str = names.SURNAMES):
        self.search, self.specs = Search(dictionary, only, exclude), patterns.selected(only, exclude)
        self.only, self.exclude, self.manual = set(only or ()), set(exclude or ()), tuple(dictionary)
        self.entities, self.arbiter, self.detectors, self.expand, self.surnames = entities, arbiter, tuple(detectors), expand, surnames

    def knowing(self, dictionary: Sequence[tuple[str, str]]) -> Layers:
        """The same layers with another dictionary."""
        other = copy(self)
        other.search, other.manual = Search(dictionary, self.only, self.exclude), tuple(dictionary)
        return other

    def __call__(self, texts: list[str]) -> list[tuple[list[tuple], dict[str, str]]]:
        """(spans by position, abbreviation -> full name) of each text."""
        ask = lambda m: m(texts) if m else [()] * len(texts)
        first, later = ask(self.arbiter), [ask(m) for m in self.detectors]
        return [self._one(t, first[k], [m[k] for m in later]) for k, t in enumerate(texts)]

    def _one(self, text: str, first, later) -> tuple[list[tuple], dict[str, str]]:
        custom, pattern = self.search(text), patterns.scan(text, self.specs) if text else []
        reserved = Occupied((s[0], s[0] + len(s[1])) for s in custom)
        clear = lambda xs: [x for x in xs if reserved.free(x[0], x[0] + len(x[1]))] if custom else list(xs)
        if not self.entities and not first and not any(later):
            return sorted([*custom, *clear(pattern)], key=lambda s: (s[0], s[5], s[2], s[1])), {}
        own, layer = [s[:3] for s in custom], {s[:3]: s for s in pattern}
        found, short = names.auto_entities(text, self.only, self.exclude, self.manual, self.surnames) if self.entities else (set(), {})
        wanted = {(n, t) for t, n in self.search.wanted} if self.entities else set()
        hits = own + clear([*layer, *(x for x in names.located(text, found | wanted) if x not in layer)])
        if first:
            hits = arbitrated(hits, list(first))
        for m in later:
            hits = filled(hits, list(m))
        if self.expand and self.entities and hits:
            hits = hits + names.expanded(text, hits)
        mine = set(own)
        hits = dict.fromkeys([*own, *(x for x in clear(hits) if x not in mine)])
        return [(*x, "custom", 0, 0) if x in mine else layer.get(x, (*x, "entity", 9, 99)) for x in sorted(hits)], short


def detect(df: DataFrame, dictionary: Sequence[tuple[str, str]] = (), only: list[str] | None = None, exclude: list[str] | None = None, entities: bool = True, arbiter: Detector | None = None, detectors: Sequence[Detector] = (), expand: bool = True, text_col: str = "text", surnames: str = names.SURNAMES) -> DataFrame:
    """df with spans (by position) and abbreviations (map of short to full names).

    Order of the layers: dictionary (always wins), patterns, rule entities (unless entities is False); the arbiter's spans
    may replace rule spans; detectors fill gaps; known names and brands spread to their other occurrences. Patterns and
    entities may overlap each other: masking decides. only and exclude act on pattern types, and on company (all
    organisations) and person.
    """
    layers = Layers(dictionary, only, exclude, entities, arbiter, detectors, expand, surnames)

    def found(texts):
        rows = layers([t or "" for t in texts.to_pylist()])
        return [span_lists([s for s, _ in rows]), [list(short.items()) for _, short in rows]]

    return with_columns_from(df, [text_col], f"spans array<{sp.SPAN}>, abbreviations map<string,string>", found)


def without_excluded(df: DataFrame, excluded: Sequence[tuple[str, str]], spans: str = "spans") -> DataFrame:
    """df without the spans of the given (type, text) pairs."""
    gone = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(x).alias("x")) for t, x in excluded)) if excluded else None
    if gone is None:
        return df
    return df.withColumn(spans, F.filter(spans, lambda s: ~F.array_contains(gone, F.struct(s["etype"].alias("t"), s["txt"].alias("x")))))


def reviewed_abbreviations(df: DataFrame, reviewed: str, column: str = "abbreviations") -> DataFrame:
    """abbreviations from a reviewed map column; null means automatic, empty means none."""
    return df.withColumn(column, F.coalesce(F.col(reviewed), F.col(column)))

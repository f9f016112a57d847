"""Secret scans: fixed formats, and character Markov models of random strings and ordinary identifiers.

Fixed formats (BASE) are found leftmost and without overlap, each kind by itself. Beyond them, every maximal run of
CANDIDATE characters (SHORTEST at least: shorter random strings can't be told from words) with two kinds of character of
small letters, capitals and digits is scored: the logarithm of its probability as a random string less that as an
identifier, both by first-order character models with added counts, for each character. Runs above the threshold of their
length are spans of the kind "markov", unless a fixed format has found part of them. The threshold of each class of lengths
is the highest that lets all but MISSED of the held-out random strings of that class through, so that identifiers unlike
the trained ones stay below it as far as can be, and not below the score that one in a thousand held-out identifiers
exceeds. Models are trained from labelled strings: by default some that are made from a fixed seed, else the caller's own.

Cases: null and empty texts have no spans; texts are scanned whole; repeated rows, null ids and extra columns are kept
as they are; an empty table gives no rows. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math
import random
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import ship

KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Fixed patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Part of the random strings that a threshold may miss.
MISSED = 0.01
#: First lengths of the classes that have a threshold of their own.
LENGTHS = (16, 20, 32)
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Words of which ordinary identifiers are made.
PARTS = tuple("get set user name index value count list file path data time date page text line node item type key id url size max min sum old new load save read write open close start stop next last first left right main test case error result config option buffer stream record field table column row query filter order group".split())


def labelled_strings(n: int = 12_000, seed: int = 11) -> list[tuple[str, bool]]:
    """n made strings, half of them random (True) and half identifiers, paths and words (False)."""
    rng = random.Random(seed)
    made = []
    sets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-"]
    syllables = [a + b for a in "bcdfghlmnprstvz" for b in ("a", "e", "i", "o", "u", "en", "er", "on", "an", "th")]
    # common parts of words of several European languages
    syllables += ["sch", "ung", "keit", "lich", "heit", "berg", "stadt", "tion", "ment", "que", "eux", "ado", "ción", "iert", "tz", "pf", "str", "schaft", "zeug", "ly", "wh", "nd"]
    syllables = [x for x in syllables if x.isascii()]
    for k in range(n // 2):
        made.append(("".join(rng.choices(sets[k % len(sets)], k=rng.randint(16, 64))), True))
        words = [rng.choice(PARTS) if rng.random() < 0.6 else "".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(rng.randint(3, 8))]
        style = k % 7
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            text = "-".join(words) + (str(rng.randint(1, 2030)) if rng.random() < 0.5 else "")
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "".join(words)
        elif style == 5:
            text = "".join(words).capitalize()
        else:
            text = "_".join(w.upper() for w in words) + (f"_{rng.randint(1, 99)}" if rng.random() < 0.5 else "")
        made.append((text, False))
    return made


class MarkovModels:
    """First-order character models of the two classes, and the threshold between them."""

    def __init__(self, labelled: list[tuple[str, bool]], added: float = 0.5, false_rate: float = 0.001):
        self.added = added
        held = [x for k, x in enumerate(labelled) if k // 2 % 4 == 0]
        rest = [x for k, x in enumerate(labelled) if k // 2 % 4]
        tables = [self._train([s for s, y in rest if y is kind]) for kind in (True, False)]
        self.ratio = {a: {b: tables[0][a][b] - tables[1][a][b] for b in ALPHABET} for a in (*ALPHABET, "^")}
        self.thresholds = {}
        for first, end in zip(LENGTHS, (*LENGTHS[1:], 1 << 60), strict=True):
            scores = lambda kind: sorted(self.score(x) for x, y in held if y is kind and first <= len(x) < end)  # noqa: B023, E731
            clean, wild = scores(False)[::-1], scores(True)
            bounds = [*(clean[int(len(clean) * false_rate)],) * bool(clean), *(wild[int(len(wild) * MISSED)],) * bool(wild)]
            self.thresholds[first] = max(bounds, default=math.inf)

    def threshold(self, s: str) -> float:
        return self.thresholds[max((k for k in LENGTHS if k <= len(s)), default=LENGTHS[0])]

    def _train(self, strings: list[str]) -> dict:
        counts = {a: dict.fromkeys(ALPHABET, self.added) for a in (*ALPHABET, "^")}
        for s in strings:
            for a, b in zip("^" + s, s, strict=False):
                counts[a][b] += 1
        return {a: {b: math.log(v / sum(row.values())) for b, v in row.items()} for a, row in counts.items()}

    def score(self, s: str) -> float:
        """Log-likelihood ratio for each character; positive: rather random."""
        return sum(self.ratio[a][b] for a, b in zip("^" + s, s, strict=False)) / max(1, len(s))

    def random(self, s: str) -> bool:
        kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
        return kinds >= 2 and self.score(s) > self.threshold(s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def all_spans(text: str, models: MarkovModels) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        if not any(s < m.end() and m.start() < e for _, s, e in base) and models.random(m[0]):
            more.append(("markov", m.start(), m.end()))
    return ordered(base + more)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at, open_to = [], 0, None
    for _, s, e in spans:
        if open_to is not None and s < open_to:
            open_to = max(open_to, e)
            continue
        if open_to is not None:
            at = open_to
        out += [text[at:s], mark]
        open_to = e
    return "".join(out) + text[open_to or 0 :]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[tuple[str, bool]] | None = None) -> DataFrame:
    """id_col, spans (array of kind, start, end, by start) for every row."""
    ship(docs.sparkSession)
    models = MarkovModels(labelled or labelled_strings())
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def scanned(batches):
        import pyarrow as pa

        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(t.as_py() or "", models)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scanned, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", labelled: list[tuple[str, bool]] | None = None) -> DataFrame:
    """docs with every span in text_col replaced by mark; other columns and rows as they are (null stays null)."""
    ship(docs.sparkSession)
    models = MarkovModels(labelled or labelled_strings())
    place = docs.columns.index(text_col)

    def cleaned(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t.as_py() for t in batch.column(place)]
            clean = [t if not t or not (s := all_spans(t, models)) else redacted(t, s, mark) for t in texts]
            yield batch.set_column(place, text_col, pa.array(clean, batch.schema.field(place).type))

    return docs.mapInArrow(cleaned, docs.schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for every document."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


__all__ = ["MarkovModels", "all_spans", "base_spans", "labelled_strings", "op10_secret_scan", "redact_secrets", "redacted", "secret_spans"]

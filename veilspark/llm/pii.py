"""Personal data: fixed formats, and loose candidates that boosted trees accept or not.

Fixed formats (email, ip, card, phone) are found leftmost and without overlap, each kind by itself; what fails the
kind's test is dropped. Beyond them, generators with a high recall propose spans (spaced, bracketed, spelled or local
forms, which may overlap), features of format and context describe each, and gradient boosted trees of depth two give a
score. Each kind has a threshold of its own: the smallest score with the wanted precision on held-out cases of the kind
by isotonic regression. What reaches it is a span of the kind with "_like", unless a fixed format has found part of it;
of accepted spans that overlap, the one further above its threshold goes first. Training uses made cases with known
spans from a fixed seed (CASES of them), through the same DataFrame functions; the trees are fitted on the driver from
these and become one conditional expression each. Everything over the texts is DataFrame functions: no Python runs
there. Positions come from running sums, so that the work in a text grows with n log n of its matches; only candidates
that overlap each other, directly or by others, are compared pair by pair.

Cases: null and empty texts have no spans; texts are scanned whole; repeated rows and null ids are rows like others; an
empty table gives no rows. Positions are code points, the end exclusive. Extra columns are not read.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.shared import occurrences, parts, running, runs

KINDS = ("email", "ip", "card", "phone")
LIKE = tuple(f"{k}_like" for k in KINDS)
#: Made training cases.
CASES = 6000
PRECISION = 0.98
#: Fixed patterns of the base kinds: what a text must have at least, the pattern.
BASE = {
    "email": (r"@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    # the possessive form finds the same runs as the greedy one, of those with 16 digits or more
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email_like": (
        r"[(\[{<]\x20?(?i:at|dot)\x20?[)\]}>]|\x20(?i:at|dot)\x20|\x20[@.]|@\x20",
        # the run of characters before the sign is taken as a whole, from its start: nothing in it can be the sign
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:\x20?[(\[{<]\x20?(?i:at)\x20?[)\]}>]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]+(?:(?:\x20?(?:\.|[(\[{<]\x20?(?i:dot)\x20?[)\]}>])\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]+)+"
        r"|@[A-Za-z0-9-]+(?:(?:\x20?[(\[{<]\x20?(?i:dot)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20|\x20\.\x20?)[A-Za-z0-9-]+)+)",
    ),
    "ip_like": (r"[0-9](?:\x20|\[|\(){0,2}\.(?:\x20|\]|\)){0,2}[0-9]|[0-9]\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?[0-9]", r"[0-9]{1,3}(?:(?:(?:\x20|\[|\(){0,2}\.(?:\x20|\]|\)){0,2}|\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?)[0-9]{1,3}){3}"),
    "card_like": (r"[0-9][\x20./_-]{0,2}[0-9]", r"[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}+"),
    "phone_like": (r"[0-9][)\x20./-]", r"\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?:[\x20./-][0-9]{2,4})?"),
}
CONTEXT = {
    "email_like": r"mail|contact|write|reach|send|address",
    "ip_like": r"\bip|host|address|server|log|from|client|node|ping|ssh",
    "card_like": r"card|visa|master|credit|pa(y|id)|amex|charge|pan\b",
    "phone_like": r"phone|call|tel|mob|cell|fax|dial|ring|sms|text|reach|whatsapp",
}
OTHER = r"order|invoice|version|isbn|ref|section|page|id\b|no\.|#|\$|total|score|range"
FEATURES = ("kind", "digits", "luhn", "marks", "context", "other", "glued", "distinct", "length", "highest", "brackets", "spelled", "capital", "at", "tail", "equal", "around")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _scans(df: DataFrame, patterns: dict, text: Column) -> DataFrame:
    """df with _p_<kind>: the spans (start, end, txt, before, after) of each pattern in text, which only a text with its least sign is
    searched for."""
    may = lambda sign: F.contains(text, F.lit("@")) if sign == "@" else text.rlike(sign)
    df = df.withColumns({f"_p_{kind}": F.when(may(sign), parts(text, pattern)) for kind, (sign, pattern) in patterns.items()})
    none = F.array().cast("array<struct<start:int,end:int,txt:string,before:string,after:string>>")
    named = lambda cut: F.transform(occurrences(cut), lambda o: F.struct(o["pos"].alias("start"), (o["pos"] + F.length(o["txt"])).alias("end"), *(o[c].alias(c) for c in ("txt", "before", "after"))))
    return df.withColumns({f"_p_{k}": F.when(F.size(f"_p_{k}") > 1, named(F.col(f"_p_{k}"))).otherwise(none) for k in patterns})


def _features(kind: str, s: Column) -> Column:
    x = s["txt"]
    before = F.lower(s["before"])
    near = F.concat(F.substring(s["before"], -1, 1), F.lit("\n"), F.substring(s["after"], 1, 1))
    d = _digits(x)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    highest = F.array_max(F.transform(F.filter(F.split(x, "[^0-9]+"), lambda p: p != ""), lambda p: F.least(F.lit(9999.0), F.substring(p, 1, 8).cast("double"))))
    values = {
        "kind": F.lit(float(LIKE.index(kind))), "digits": F.length(d).cast("double"), "luhn": flag((F.length(d) >= 13) & F.call_function("luhn_check", d)), "marks": F.regexp_count(x, F.lit(r"[^0-9]")).cast("double"),
        "context": flag(before.rlike(CONTEXT[kind])), "other": flag(before.rlike(OTHER)), "glued": flag(near.rlike(r"[A-Za-z0-9_.$/#@-]")),
        "distinct": F.size(F.array_distinct(F.split(d, ""))).cast("double"), "length": F.length(x).cast("double"), "highest": F.coalesce(highest, F.lit(0.0)),
        # brackets around at, dot or a dot; these words; the length of a last part of letters; digit groups of one length
        "brackets": F.regexp_count(x, F.lit(r"[(\[{<]\x20?(?i:at|dot|\.)\x20?[)\]}>]")).cast("double"), "spelled": F.regexp_count(x, F.lit(r"(?i)\x20(?:at|dot)\x20")).cast("double"), "capital": F.regexp_count(x, F.lit("AT|DOT")).cast("double"), "at": F.regexp_count(x, F.lit("@")).cast("double"),
        "tail": F.length(F.regexp_extract(x, "[A-Za-z]*$", 0)).cast("double"), "equal": F.size(F.array_distinct(F.transform(F.filter(F.split(x, "[^0-9]+"), lambda p: p != ""), lambda p: F.length(p)))).cast("double"),
        # digits close by make a row of numbers
        "around": F.regexp_count(F.concat(F.substring(before, -8, 8), F.lit(" "), s["after"]), F.lit("[0-9]")).cast("double"),
    }
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.struct(*(values[f].alias(f) for f in FEATURES)).alias("f"))


def _candidates() -> Column:
    described = lambda kind: lambda s: _features(kind, s)
    return F.concat(*(F.transform(F.col(f"_p_{k}"), described(k)) for k in LIKE))


class BoostedTrees:
    """Gradient boosting of depth-two trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 45, rate: float = 0.3, least: int = 8):
        self.trees, self.base = [], math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        score = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[:-1])) for c in x.T]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            root = self._split(x, g, h, cuts, np.ones(len(y), bool), least)
            if root is None:
                break
            tree, step = [root], np.zeros(len(y))
            for low in (True, False):
                side = (x[:, root[0]] <= root[1]) == low
                sub = self._split(x, g, h, cuts, side, least)
                leaves = []
                for part in (True, False) if sub else (True,):
                    m = side & ((x[:, sub[0]] <= sub[1]) == part) if sub else side
                    v = rate * g[m].sum() / (h[m].sum() + 1.0)
                    leaves.append(float(v))
                    step[m] = v
                tree.append((sub, leaves))
            self.trees.append(tree)
            score += step

    @staticmethod
    def _split(x, g, h, cuts, m, least):
        best, found = 1e-9, None
        base = g[m].sum() ** 2 / (h[m].sum() + 1.0)
        for f, ts in enumerate(cuts):
            v = x[m, f]
            order = np.argsort(v, kind="stable")
            sg, sh = np.concatenate(([0], np.cumsum(g[m][order]))), np.concatenate(([0], np.cumsum(h[m][order])))
            k = np.searchsorted(v[order], ts, "right")
            gain = sg[k] ** 2 / (sh[k] + 1) + (sg[-1] - sg[k]) ** 2 / (sh[-1] - sh[k] + 1) - base
            gain[(k < least) | (len(v) - k < least)] = -1
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (f, float(ts[int(gain.argmax())]))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for root, low, high in self.trees:
            for side, (sub, leaves) in ((x[:, root[0]] <= root[1], low), (x[:, root[0]] > root[1], high)):
                out[side] += np.where(x[side, sub[0]] <= sub[1], leaves[0], leaves[1]) if sub else leaves[0]
        return out

    def column(self, f: Column) -> Column:
        out = F.lit(self.base)
        leaf = lambda sub, v: F.when(f[FEATURES[sub[0]]] <= sub[1], v[0]).otherwise(v[1]) if sub else F.lit(v[0])
        for root, low, high in self.trees:
            out = out + F.when(f[FEATURES[root[0]]] <= root[1], leaf(*low)).otherwise(leaf(*high))
        return out


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on all accepted held-out cases have the precision, by isotonic probabilities."""
    order = np.argsort(-score, kind="stable")
    blocks: list[list[float]] = []  # pool adjacent violators from the highest score down: [sum, count, least score]
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-1][0] / blocks[-1][1] > blocks[-2][0] / blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    bound, right, total = math.inf, 0.0, 0.0
    for r, n, s in blocks:
        right, total = right + r, total + n
        if right / total >= precision and r / n >= 0.5:
            bound = s
    return bound


#: How the made cases lead up to personal data of each kind, and to numbers that are none.
LEADS = {
    "email_like": ("mail ", "mail: ", "contact ", "write to ", "e-mail: ", "reach me at ", "address "),
    "ip_like": ("ip ", "host ", "from ", "server at ", "login from ", "address ", "ip: "),
    "card_like": ("card ", "visa ", "card no ", "credit card: ", "payment by ", "mastercard ", "paid with "),
    "phone_like": ("call ", "phone: ", "tel ", "mobile ", "cell ", "fax ", "dial ", "ring "),
}


def made_cases(n: int = CASES, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the ranges of the personal data in them, and texts with numbers and words that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "in", "es", "ti", "or"], k=rng.randint(1, 4)))
    text = lambda: " ".join(word() for _ in range(rng.randint(2, 8)))
    octet = lambda: str(rng.randint(0, 255))

    def card(good=True):
        body = [int(c) for c in rng.choice("3456") + num(rng.choice([11, 13, 14, 14, 14, 15]))]
        total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(body)))
        return "".join(map(str, body)) + str((-total if good else -total + rng.randint(1, 9)) % 10)

    def grouped(s, mark, size=4):
        if len(s) == 15 and size == 4:
            return mark.join((s[:4], s[4:10], s[10:]))
        return mark.join(s[i : i + size] for i in range(0, len(s), size))

    def email():
        at = rng.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}", "<at>", " AT ", " at ", " @ ", " @ ", " @ ", "@"])
        dot = rng.choice([" (dot) ", "(dot)", "[dot]", " dot ", " DOT ", " . ", "[.]" if "[" in at else "(dot)"] if at.strip() != "@" else [" . ", " . ", " . ", " (dot) ", "(dot)", "[dot]"])
        if dot == "[.]":
            dot = "[dot]"
        name = rng.choice([f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{num(2)}", word()])
        return f"{name}{at}{word()}{dot}{rng.choice(['com', 'com', 'org', 'net', 'io', 'de', 'fr', 'es', 'uk', 'edu'])}"

    def phone():
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}", "({})-{}-{}"]).format(num(rng.choice([2, 3, 3, 4])), num(3), num(4))

    hit = {
        "email_like": email, "ip_like": lambda: rng.choice(["[.]", " . ", "(.)", " [.] ", "[dot]", " (dot) ", ". "]).join(octet() for _ in range(4)),
        "card_like": lambda: grouped(card(), rng.choice(["/", ".", "_", "  ", ". ", " - "]), rng.choice([4, 4, 4, 1, 5])) if rng.random() < 0.8 else grouped(card(), rng.choice([" ", "-", ""])),
        "phone_like": phone,
    }
    noise = {
        "email_like": [lambda: f"{word()} at {word()} . {word()}", lambda: f"{word()} at {num(2)}.{num(2)}", lambda: f"@ {word()}.{word()}", lambda: f"{word()} at {word()} dot", lambda: f"looked at {word()}. {word().capitalize()}", lambda: f"{num(2)} @ {num(1)}.{num(2)}", lambda: f"stay at {word()}. {word()}"],
        "ip_like": [lambda: f"version {rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}", lambda: f"{rng.randint(1, 999)}.{rng.randint(300, 999)}.{rng.randint(0, 999)}.{rng.randint(300, 999)}", lambda: f"section {rng.randint(1, 9)} . {rng.randint(1, 9)} . {rng.randint(1, 9)} . {rng.randint(1, 9)}", lambda: f"total {num(3)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"rows {rng.randint(1, 99)}. {rng.randint(1, 99)}. {rng.randint(1, 99)}. {rng.randint(1, 99)}", lambda: f"in {num(2)}. {num(2)}. {num(2)}. {num(2)}"],
        "card_like": [lambda: grouped(card(False), rng.choice(["/", ".", " ", "-", "_", "  "])), lambda: card(False), lambda: f"id {num(17)}", lambda: f"isbn {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: " ".join(num(rng.randint(2, 4)) for _ in range(rng.randint(4, 7))), lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}.{num(2)}.{num(2)}", lambda: f"range {num(5)}-{num(5)} {num(5)}"],
        "phone_like": [lambda: f"order {num(3)}-{num(4)}-{num(4)}", lambda: f"{num(4)}-{num(3)}-{num(4)}", lambda: f"isbn {num(3)}-{num(4)} {num(4)}", lambda: " ".join(num(rng.randint(2, 4)) for _ in range(rng.randint(3, 7))), lambda: f"total {num(3)}.{num(3)}.{num(3)}", lambda: f"ref {num(3)}/{num(4)}-{num(4)}", lambda: f"pages {num(3)} {num(3)} {num(4)}", lambda: f"score {num(2)}-{num(3)}-{num(3)}"],
    }
    out = []
    for k in range(n):
        kind = LIKE[k // 2 % len(LIKE)]
        lead = rng.choice([text, text, text, lambda: f"{text()} {rng.choice(['#', '$$', 'id', 'page 3', '12'])}"])() + rng.choice([" ", "\n", ", ", ". "])
        if k % 2 == 0:
            # a phone number in a local form is known by what leads up to it, the others by their form too
            lead += rng.choice(LEADS[kind]) if kind == "phone_like" or rng.random() < 0.7 else ""
            found = hit[kind]()
            out.append((lead + found + rng.choice([" ", ", ", ". ", "\n"]) + text(), [(len(lead), len(lead) + len(found))]))
        else:
            lead += rng.choice(LEADS[kind]) if kind in ("card_like", "email_like") and rng.random() < 0.15 else ""
            out.append((lead + rng.choice(noise[kind])() + rng.choice([" ", ", ", ". "]) + text(), []))
    return out


_MODELS: dict[tuple, tuple[BoostedTrees, dict[str, float]]] = {}


def trained(spark: SparkSession, cases: int = CASES, precision: float = PRECISION) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees, and the threshold of each kind, from the made cases; the same ones again within a process."""
    if (cases, precision) not in _MODELS:
        made = made_cases(cases)
        df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "k long, text string")
        df = _scans(df, LOOSE, F.col("text")).select("k", F.explode(_candidates()).alias("c"))
        rows = df.select("k", "c.start", "c.end", *(F.col("c.f")[f].alias(f"f_{f}") for f in FEATURES)).orderBy("k", "start", "end", "f_kind").collect()
        x = np.array([[r[f"f_{f}"] for f in FEATURES] for r in rows], float)
        own = [LIKE[int(r["f_kind"])] == LIKE[r["k"] // 2 % len(LIKE)] for r in rows]
        y = np.array([o and any(r["start"] < e and s < r["end"] and r["end"] - r["start"] >= 0.7 * (e - s) for s, e in made[r["k"]][1]) for r, o in zip(rows, own, strict=True)], float)
        # a third of the cases of each kind, good and bad ones, is held out
        held = np.array([r["k"] // (2 * len(LIKE)) % 3 == 2 for r in rows])
        trees = BoostedTrees(x[~held], y[~held])
        score = trees.score(x)
        of = lambda k: held & (x[:, 0] == k)
        _MODELS[cases, precision] = trees, {kind: calibrated_threshold(score[of(k)], y[of(k)], precision) for k, kind in enumerate(LIKE)}
    return _MODELS[cases, precision]


_SPAN = "struct<kind:string,start:int,end:int>"


def _clear(more: Column, base: Column) -> Column:
    """Of candidates (by start) those that overlap no base span: one sweep over both, in n log n steps."""
    both = F.array_sort(F.concat(F.transform(more, lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("own"), c["end"].alias("end"), c.alias("c"))), F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("own"), b["end"].alias("end"), F.lit(None).cast(f"struct<kind:string,start:int,end:int,rank:double>").alias("c")))))
    # how far the base spans before reach, and where the next one begins (from the right, as running least)
    before = running(F.transform(both, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
    after = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["own"] == 0, x["at"]).otherwise(2**31 - 1))), lambda a, b: F.least(a, b)))
    marked = F.zip_with(F.zip_with(both, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), after, lambda y, a: F.struct(y["x"].alias("x"), (y["b"] <= y["x"]["at"]).alias("l"), (a >= y["x"]["end"]).alias("r")))
    return F.transform(F.filter(marked, lambda y: (y["x"]["own"] == 1) & y["l"] & y["r"]), lambda y: y["x"]["c"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, spans (array of kind, start, end by kind as listed, then start) for every row of docs."""
    trees, thresholds = trained(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    df = _scans(df, BASE | LOOSE, text)
    plain = lambda kind, xs: F.transform(xs, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    tested = lambda kind: lambda s: _valid(kind, s["txt"])
    base = F.concat(*(plain(k, F.filter(F.col(f"_p_{k}"), tested(k))) for k in KINDS))
    least = F.create_map(*(F.lit(x) for k, v in thresholds.items() for x in (k, v if math.isfinite(v) else 1e300)))
    ranked = F.transform(_candidates(), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (trees.column(c["f"]) - least[c["kind"]]).alias("rank")))
    # most texts have no candidates: the trees are not looked at for those
    some = F.size(F.concat(*(F.col(f"_p_{k}") for k in LIKE))) > 0
    df = df.withColumns({"base": base, "more": F.when(some, F.filter(ranked, lambda c: c["rank"] >= 0))}).drop(*(f"_p_{k}" for k in (*KINDS, *LIKE)))
    df = df.withColumn("more", F.when(F.size("more") > 0, _clear(F.array_sort(F.transform("more", lambda c: F.struct(c["start"].alias("at"), c.alias("c"))))["c"], F.col("base"))))
    df = df.withColumn("runs", F.when(F.size("more") > 0, runs(F.col("more"), lambda c: c["start"], lambda c: c["end"]))).drop("more")
    none = F.array().cast(f"array<{_SPAN}>")
    # of accepted spans that overlap each other: by the margin over the threshold, then the longer, then the first
    best = lambda run: F.array_sort(F.transform(run, lambda c: F.struct((-c["rank"]).alias("a"), (c["start"] - c["end"]).alias("b"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    step = lambda a, c: F.when(F.exists(a, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), a).otherwise(F.concat(a, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    kept = F.flatten(F.transform("runs", lambda run: F.aggregate(best(run), none, step)))
    rank = F.create_map(*(x for k, v in enumerate((*KINDS, *LIKE)) for x in (F.lit(v), F.lit(k))))
    df = df.withColumn("spans", F.concat("base", F.when(F.col("runs").isNotNull(), kept).otherwise(none))).drop("base", "runs")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return df.select(F.col("id").alias(id_col), "text", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(spans: DataFrame) -> DataFrame:
    """pii_spans' rows with the column clean: each run of overlapping spans replaced by its first kind in brackets."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        done = F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct(done.alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    clean = F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return spans.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for every document."""
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

"""What happens to spans that models propose, before fusion; and layers around models that the caller injects.

A raw span is a struct label, pos, txt, score. The filters are expressions on arrays; merging of neighbours is a fold in
order of position. No model comes with this package: chunked_layer() wraps a function or loader, reply_layer() a client of
a generative service; both are detectors for detect(), loaded once in a Python worker, and give nothing where they fail.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import names

RAW = "struct<label:string,pos:int,txt:string,score:double>"
# Labels of the two model families and the types that they become.
NER_TYPES = {"name": "person", "company": "company", "organization": "institution", "government": "government", "address": "full_address"}
PII_TYPES = {"private_person": "person", "private_email": "email", "private_phone": "phone", "private_address": "full_address", "private_url": "website", "private_date": "date", "account_number": "bank_account", "secret": "secret"}
REPLY_TYPES = "person company law_firm institution government court full_address bank_account case_number phone email id_card secret website".split()


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _row(s: Column, **new: Column) -> Column:
    return F.struct(*(new.get(k, s[k]).alias(k) for k in ("label", "pos", "txt", "score")))


def usable(spans: Column, least: float = 0.7) -> Column:
    """Labels without their B-, I-, O-, E-, S- prefix; spans with the score and two characters besides blanks."""
    bare = lambda s: _row(s, label=F.regexp_replace(s["label"], "^[BIOES]-", ""))
    return F.transform(F.filter(spans, lambda s: (s["score"] >= least) & (F.length(F.trim(s["txt"])) >= 2)), bare)


def in_order(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(F.array_distinct(spans), lambda s: F.struct(s["pos"].alias("a"), s["label"].alias("b"), s["txt"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def glued_surnames(spans: Column) -> Column:
    """A compound surname that the model took for a position, and the name right behind it, as one name."""
    start = F.array().cast(f"array<{RAW}>")
    last = lambda acc: F.element_at(acc, -1)
    join = lambda a, s: (a["label"] == "position") & a["txt"].isin(*names.COMPOUND_SURNAMES) & (s["label"] == "name") & (a["pos"] + F.length(a["txt"]) == s["pos"])
    one = lambda a, s: _row(s, pos=a["pos"], txt=F.concat(a["txt"], s["txt"]), score=F.least(a["score"], s["score"]))
    return F.aggregate(in_order(spans), start, lambda acc, s: F.when((F.size(acc) > 0) & join(last(acc), s), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one(last(acc), s)))).otherwise(F.concat(acc, F.array(s))))


# What the Chinese model's spans must not be.
PERSON_TAILS = "的了过是为与和或及在"
GENERIC_BODIES = "人民法院 第一审人民法院 第二审人民法院 第三审人民法院 原审人民法院 再审人民法院 审判人民法院 人民检察院 本院 法院 检察院 原审 一审 二审 再审".split()
#: What goes at the ends of the other model's spans.
ENDS = " \t\n,，。；;"


def typed(spans: Column, types: dict[str, str]) -> Column:
    """Spans with known labels, as types."""
    return F.filter(F.transform(spans, lambda s: _row(s, label=_map(types, s["label"]))), lambda s: s["label"].isNotNull())


def plausible(spans: Column) -> Column:
    """The Chinese model's typed spans without those that have no Chinese character, people that end in a particle, general
    words for bodies, and bodies that begin with a counted article."""
    body = lambda s: s["label"].isin("government", "court", "institution")
    bad = lambda s: ((s["label"] == "person") & s["txt"].rlike(f"[{PERSON_TAILS}]$")) | (body(s) & (s["txt"].isin(*GENERIC_BODIES) | s["txt"].rlike(r"(?U)^第[一二三四五六七八九十百千\d]+[条款项审]")))
    return F.filter(spans, lambda s: s["txt"].rlike("[一-鿿]") & ~bad(s))


def anchored(spans: Column, text: Column, latin_people: bool = True) -> Column:
    """The other model's typed spans: cut out of text anew by their place, without marks and blanks at the ends, two
    characters or more; with latin_people people need an ASCII letter or digit."""
    marks = "[ \\t\\n,，。；;]"

    def one(s):
        cut = F.substring(text, s["pos"] + 1, F.length(s["txt"]))
        bare = F.regexp_replace(cut, f"^{marks}+", "")
        return _row(s, pos=s["pos"] + F.length(cut) - F.length(bare), txt=F.regexp_replace(bare, f"{marks}+$", ""))

    return F.filter(F.transform(spans, one), lambda s: (F.length(s["txt"]) >= 2) & ((s["label"] != "person") | F.lit(not latin_people) | s["txt"].rlike("[A-Za-z0-9]")))


def merged_neighbours(spans: Column, text: Column, gap: int = 3) -> Column:
    """Neighbours of one type with at most gap characters between them, all of these blanks or joining marks, as one."""
    start = F.array().cast(f"array<{RAW}>")
    last = lambda acc: F.element_at(acc, -1)
    stop = lambda s: s["pos"] + F.length(s["txt"])
    between = lambda a, s: F.substring(text, stop(a) + 1, s["pos"] - stop(a))
    near = lambda a, s: (a["label"] == s["label"]) & (s["pos"] - stop(a)).between(0, gap) & between(a, s).rlike(r"^[ \t.,\-:/@·]*$")
    one = lambda a, s: _row(a, txt=F.substring(text, a["pos"] + 1, stop(s) - a["pos"]), score=F.least(a["score"], s["score"]))
    return F.aggregate(in_order(spans), start, lambda acc, s: F.when((F.size(acc) > 0) & near(last(acc), s), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one(last(acc), s)))).otherwise(F.concat(acc, F.array(s))))


def joined_urls(spans: Column) -> Column:
    """A website and the secret right behind it that begins like the rest of an address, as one website."""
    start = F.array().cast(f"array<{RAW}>")
    last = lambda acc: F.element_at(acc, -1)
    near = lambda a, s: (a["label"] == "website") & (s["label"] == "secret") & (a["pos"] + F.length(a["txt"]) == s["pos"]) & s["txt"].rlike("^(://|/)")
    one = lambda a, s: _row(a, txt=F.concat(a["txt"], s["txt"]))
    return F.aggregate(in_order(spans), start, lambda acc, s: F.when((F.size(acc) > 0) & near(last(acc), s), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one(last(acc), s)))).otherwise(F.concat(acc, F.array(s))))


# Characters of which things of a type are made.
TAILS = {"phone": r"[0-9 \-]", "secret": r"[A-Za-z0-9_\-.]", "bank_account": r"[0-9 \-]", "website": r"[A-Za-z0-9:/.\-?=&%#_~+@]"}


def extended(spans: Column, text: Column) -> Column:
    """Phones, accounts, secrets and websites up to the end of the characters that such things are made of; blanks and
    hyphens at the end of what was added go."""
    stop = lambda s: s["pos"] + F.length(s["txt"])

    def one(s):
        rest = F.substring(text, stop(s) + 1, F.length(text))
        more = F.lit("")
        for kind, chars in TAILS.items():
            more = F.when(s["label"] == kind, F.regexp_extract(rest, f"^{chars}+", 0)).otherwise(more)
        return _row(s, txt=F.when(more == "", s["txt"]).otherwise(F.rtrim(F.concat(s["txt"], more), F.lit(" -"))))

    return F.transform(spans, one)


def parsed_reply(reply: Column) -> Column:
    """array of struct(text, type) from a generated answer: code fences go, the outermost braces are JSON; known types and
    two characters or more."""
    body = F.regexp_extract(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    got = F.from_json(body, "struct<entities:array<struct<text:string,type:string>>>")["entities"]
    return F.filter(F.coalesce(got, F.array().cast("array<struct<text:string,type:string>>")), lambda e: e["type"].isin(*REPLY_TYPES) & (F.length(F.trim(e["text"])) >= 2))


def everywhere(text: Column, word: Column) -> Column:
    """Positions (from 0) of all occurrences of word, those that overlap each other too."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.length(word))), lambda p: F.substring(text, p + 1, F.length(word)) == word)
    return F.when((word != "") & F.contains(text, word), starts).otherwise(F.array().cast("array<int>"))


def stub_detector(words: dict[str, str]):
    """A stand-in for a model: finds fixed words. For tests; no model comes with this package."""

    def run(texts: list[str]) -> list[list[tuple[int, str, str]]]:
        out = []
        for t in texts:
            hits = []
            for w, kind in words.items():
                at = t.find(w)
                while at >= 0:
                    hits.append((at, w, kind))
                    at = t.find(w, at + len(w))
            out.append(sorted(hits))
        return out

    return run


#: Chunk sizes of the model families and what they are cut at.
CHUNKS = {"ner": (400, ("\n\n", "\n", "。", "；")), "pii": (8000, ("\n\n", "\n", "。", ". ")), "reply": (3000, ("\n\n", "\n", "。", ". "))}


def chunks(text: str, size: int, marks: tuple[str, ...]) -> list[tuple[str, int]]:
    """normalize.chunked() for one string: (chunk, offset)."""
    out, at = [], 0
    while at < len(text):
        head = text[at : at + size]
        if len(text) - at > size:
            ends = (head.rfind(m) + len(m) for m in marks if m in head)
            head = head[: next((e for e in ends if e > size // 2), size)]
        out.append((head, at))
        at += len(head)
    return out


_LOADED: dict[str, object] = {}


def chunked_layer(name: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, int, str, float]]]]], refine: Callable[[list[tuple], str], list[tuple[int, str, str]]], family: str = "ner"):
    """A detector around a model: load gives a function from chunks to raw spans (label, position, text, score); it's called
    once in a worker (by name), and a model that can't be loaded or fails gives nothing. refine makes (position, text,
    type) of a text's raw spans."""
    size, marks = CHUNKS[family]

    def run(texts: list[str]) -> list[list[tuple[int, str, str]]]:
        if name not in _LOADED:
            try:
                _LOADED[name] = load()
            except Exception:
                _LOADED[name] = None
        if _LOADED[name] is None:
            return [[] for _ in texts]
        out = []
        for t in texts:
            try:
                cut = chunks(t, size, marks)
                raw = [(label, p + at, x, score) for (_, at), spans in zip(cut, _LOADED[name]([c for c, _ in cut]), strict=True) for label, p, x, score in spans]
                out.append(refine(raw, t))
            except Exception:
                out.append([])
        return out

    return run


def ner_spans(raw: list[tuple[str, int, str, float]], text: str, least: float = 0.7) -> list[tuple[int, str, str]]:
    """refine of the Chinese model: usable(), glued_surnames(), typed() and plausible() for one text."""
    good = sorted({(p, re.sub("^[BIOES]-", "", label), x) for label, p, x, score in raw if score >= least and len(x.strip()) >= 2})
    out: list[tuple[int, str, str]] = []
    for p, label, x in good:
        if out and label == "name" and out[-1][2] == "position" and out[-1][1] in names.COMPOUND_SURNAMES and out[-1][0] + len(out[-1][1]) == p:
            out[-1] = (out[-1][0], out[-1][1] + x, "name")
        else:
            out.append((p, x, label))
    rows = [(p, x, NER_TYPES[k]) for p, x, k in out if k in NER_TYPES and re.search("[一-鿿]", x)]
    article = re.compile(r"第[一二三四五六七八九十百千\d]+[条款项审]")
    body = lambda k: k in ("government", "court", "institution")
    return [r for r in rows if not (r[2] == "person" and r[1][-1] in PERSON_TAILS) and not (body(r[2]) and (r[1] in GENERIC_BODIES or article.match(r[1])))]


def pii_spans(raw: list[tuple[str, int, str, float]], text: str, least: float = 0.5, latin_people: bool = True) -> list[tuple[int, str, str]]:
    """refine of the other model: typed(), anchored(), merged_neighbours(), joined_urls(), extended() and in_order() for one
    text."""
    good = []
    for label, p, x, score in raw:
        kind = PII_TYPES.get(re.sub("^[BIOES]-", "", label))
        cut = text[p : p + len(x)]
        bare = cut.strip(ENDS)
        if kind and score >= least and len(bare) >= 2 and (kind != "person" or not latin_people or re.search("[A-Za-z0-9]", bare)):
            good.append((p + len(cut) - len(cut.lstrip(ENDS)), bare, kind))
    out: list[tuple[int, str, str]] = []
    for p, x, kind in sorted(set(good)):
        a, t, k = out[-1] if out else (0, "", "")
        gap = p - a - len(t)
        if k == kind and 0 <= gap <= 3 and re.fullmatch(r"[ \t.,\-:/@·]*", text[a + len(t) : p]):
            out[-1] = (a, text[a : p + len(x)], kind)
        elif k == "website" and kind == "secret" and gap == 0 and x.startswith(("://", "/")):
            out[-1] = (a, t + x, k)
        else:
            out.append((p, x, kind))
    for k, (p, x, kind) in enumerate(out):
        more = re.compile(f"{TAILS[kind]}+").match(text, p + len(x)) if kind in TAILS else None
        if more:
            out[k] = (p, (x + more[0]).rstrip(" -"), kind)
    return sorted(set(out))


PROMPT = (
    'Find personal and sensitive information in the text. Answer with one JSON object alone: {"entities": [{"text": "...", "type": "..."}]}. '
    "Copy each text exactly as it stands. Types: " + ", ".join(REPLY_TYPES) + '. Without findings answer {"entities": []}.'
)


def reply_spans(reply: str) -> list[tuple[str, str]]:
    """parsed_reply() for one string: (text, type)."""
    m = re.search(r"(?s)\{.*\}", re.sub(r"```(?:json)?", "", reply or ""))
    try:
        rows = json.loads(m[0]).get("entities") or [] if m else []
        return [(r["text"], r["type"]) for r in rows if isinstance(r, dict) and isinstance(r.get("text"), str) and r.get("type") in REPLY_TYPES and len(r["text"].strip()) >= 2]
    except (ValueError, AttributeError):
        return []


def reply_layer(ask: Callable[[str, str], str], probe: Callable[[], bool] = lambda: True):
    """A detector around a generative service: ask(prompt, text) gives its answer, probe() says once in a worker whether it
    is there. Answers differ from run to run: checkpoint what detect() gives. A failing call gives nothing, and a failed
    connection (OSError) takes the service out for the rest of the batch of texts."""
    size, marks = CHUNKS["reply"]
    there: list[bool] = []

    def run(texts: list[str]) -> list[list[tuple[int, str, str]]]:
        if not there:
            there.append(bool(probe()))
        up, out = there[0], []
        for t in texts:
            found = set()
            for chunk, _ in chunks(t, size, marks) if up else ():
                try:
                    found |= set(reply_spans(ask(PROMPT, chunk)))
                except OSError:
                    up = False
                    break
                except Exception:
                    continue
            out.append(sorted((m.start(), x, k) for x, k in found for m in re.finditer(f"(?={re.escape(x)})", t)))
        return out

    return run


def http_client(base_url: str, model: str, timeout: float = 60) -> Callable[[str, str], str]:
    """ask() for a service with the path /v1/chat/completions, at temperature 0."""

    def ask(prompt: str, text: str) -> str:
        from urllib.request import Request, urlopen

        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}]}).encode()
        with urlopen(Request(base_url.rstrip("/") + "/v1/chat/completions", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    return ask


def http_probe(base_url: str, path: str = "/api/tags", timeout: float = 5) -> Callable[[], bool]:
    """probe() for such a service."""

    def probe() -> bool:
        from urllib.request import urlopen

        try:
            with urlopen(base_url.rstrip("/") + path, timeout=timeout):
                return True
        except OSError:
            return False

    return probe


def enabled(spark: SparkSession, layer: str) -> bool:
    """Whether the session's setting veilspark.<layer>.enabled says 1, true, yes or on."""
    return (spark.conf.get(f"veilspark.{layer}.enabled", "") or "").strip().lower() in ("1", "true", "yes", "on")

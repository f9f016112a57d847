"""Masking: strategies, partial masks, numbered placeholders, splicing, the log and the mapping."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.shipping import tuples, with_columns_from
from veilspark.functions.spans import Occupied

# The types that are masked in part by default; all others get placeholders.
PARTIAL = ("id_card", "phone", "fax", "toll_free", "bank_account", "email", "passport", "hk_macau_pass", "taiwan_pass", "military_id", "credit_code", "license_plate", "vin")
#: Types without a strategy of their own: setting one for all leaves them at placeholders.
UNSET = ("court", "unknown")
#: Types whose English placeholder isn't their name in capitals; unknown types share one.
ENGLISH = {"toll_free": "PHONE", "full_address": "ADDRESS", "permit_number": "PERMIT", "patent_number": "PATENT", "document_number": "DOC_NUMBER", "project_name": "PROJECT"}
CHINESE = {
    "person": "人物", "company": "公司", "address": "地址", "full_address": "地址", "law_firm": "律所", "institution": "机构", "government": "政府", "court": "法院", "city": "城市", "district": "区县",
    "location": "地点", "signature": "签名", "bank_name": "银行", "branch_name": "支行", "account_name": "账户名", "project_name": "项目", "product_name": "产品", "asset": "资产", "vehicle": "车辆",
    "property": "房产", "stock": "股票", "seal": "印章", "id_card": "身份证", "phone": "电话", "fax": "传真", "toll_free": "电话", "email": "邮箱", "bank_account": "银行卡", "passport": "护照",
    "hk_macau_pass": "港澳通行证", "taiwan_pass": "台胞证", "military_id": "军官证", "credit_code": "社会信用代码", "case_number": "案号", "contract_number": "合同号", "invoice_number": "发票号",
    "license_plate": "车牌", "vin": "车架号", "ip_address": "IP地址", "mac_address": "MAC地址", "amount": "金额", "price": "价格", "date": "日期", "time": "时间", "datetime": "时间", "postal_code": "邮编",
    "house_number": "房号", "website": "网址", "org_code": "机构代码", "tax_number": "税号", "social_account": "社交账号", "other": "其他", "property_cert": "产权证", "permit_number": "证书号",
    "patent_number": "专利号", "document_number": "文书号", "secret": "密钥", "unknown": "未知",
}
STYLES = {"english_bracket": ("[", "]"), "chinese_angle": ("<", ">"), "chinese_bracket": ("〔", "〕")}
ORGANISATIONS = ("company", "law_firm", "institution", "court", "government", "bank_name")
#: Endings that a partly masked organisation keeps, longest first.
KEPT_ENDINGS = ("中级人民法院", "高级人民法院", "会计师事务所", "股份有限公司", "有限责任公司", "集团有限公司", "管理委员会", "人民检察院", "律师事务所", "人民法院", "有限公司", "集团公司", "人民政府", "事务所", "司法厅", "司法部", "公司", "集团", "股份", "银行")
#: Kept characters at the start and at the end.
ENDS = {"id_card": (3, 2), "bank_account": (4, 4), "passport": (2, 2), "hk_macau_pass": (2, 2), "taiwan_pass": (2, 2), "military_id": (2, 2), "credit_code": (4, 4), "license_plate": (2, 1), "vin": (3, 3)}


def strategies(overrides: dict[str, str] | None = None, everything: str | None = None) -> dict[str, str]:
    """type -> partial or placeholder; types that are absent get placeholders."""
    known = set(CHINESE) - set(UNSET)
    base = {t: everything or ("partial" if t in PARTIAL else "placeholder") for t in known}
    return base | {t: s for t, s in (overrides or {}).items() if s in ("partial", "placeholder")}


@lru_cache(8)
def labels(style: str) -> dict[str, str]:
    """type -> label inside the brackets; types with one label share numbers."""
    if style == "english_bracket":
        return {t: ENGLISH.get(t, t.upper()) for t in CHINESE}
    return dict(CHINESE)


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def partly(txt: str, etype: str) -> str:
    """txt with a part of it kept, by type; types without a rule become stars."""
    n = len(txt)
    if etype in ENDS:
        a, b = ENDS[etype]
        return txt[:a] + "*" * (n - a - b) + txt[n - b :] if n >= a + b else "*" * n
    if etype in ("phone", "fax", "toll_free"):
        places = [k for k, c in enumerate(txt) if c.isdigit()]
        hidden = set(places[3:-2]) if len(places) >= 5 else set()
        return "".join("*" if k in hidden else c for k, c in enumerate(txt))
    if etype == "email":
        user, at, host = txt.partition("@")
        return txt if not at else ("*" * len(user) if len(user) <= 2 else user[:2] + "*" * (len(user) - 2)) + at + host
    if etype == "person":
        return txt[0] + "*" * (n - 1) if n >= 2 else txt
    if etype in ORGANISATIONS:
        tail = next((t for t in KEPT_ENDINGS if txt.endswith(t)), "")
        core = txt[: n - len(tail)]
        if tail:
            return core[0] + "*" * max(len(core) - 1, 1) + tail if core else tail
        return txt[0] + "*" * (n - 1) if n >= 2 else "*" * n
    return "*" * n


def fact(etype: str, original: str) -> dict:
    return {"type": etype, "original": original, "is_abbreviation": False, "full_name": None, "full_placeholder": None}


class Known:
    """A mapping that grows from text to text: placeholders with their (type, original), names with their placeholders, and
    for each label the number below which none is free, so that a text costs what is new in it and not what is known."""

    def __init__(self, seed: dict[str, tuple[str, str]]):
        self.owner, self.given = dict(seed), {k: ph for ph, k in seed.items()}
        self.free: dict[str, int] = {}

    def learn(self, facts: dict[str, dict], free: dict[str, int]) -> None:
        """Takes over what mask_with() has given."""
        for ph, v in facts.items():
            self.owner[ph] = (v["type"], v["original"])
            self.given[v["type"], v["original"]] = ph
        self.free |= free


def mask_with(known: Known, text: str, spans: list[tuple[int, str, str]], chosen: dict[str, str], style: str, short: dict[str, str], logged: bool = True) -> tuple[str, dict[str, dict], list, dict[str, int]]:
    """(masked text, new entries of the mapping, log, free numbers) of one text; known stays as it is until it learns them.
    Without logged the log holds the masks alone."""
    left, right = STYLES[style]
    english = style == "english_bracket"
    label = labels(style)
    given: dict[tuple[str, str], str] = {}
    new: set[str] = set()
    facts: dict[str, dict] = {}
    free: dict[str, int] = {}

    def numbered(series: str, made) -> str:
        n = free.get(series) or known.free.get(series, 1)
        while (ph := made(n)) in known.owner or ph in new:
            n += 1
        free[series] = n + 1
        return ph

    def placeholder(etype: str, name: str) -> str:
        key = (etype, name)
        ph = given.get(key) or known.given.get(key)
        if ph is None:
            full = short.get(name)
            if full is not None and full != name:
                base, mark = placeholder(etype, full), "_ABBR" if english else "简化名"
                ph = numbered(base, lambda k: base[:-1] + mark + (("_" if english else "") + str(k) if k > 1 else "") + right)
                facts[ph] = {"type": etype, "original": name, "is_abbreviation": True, "full_name": full, "full_placeholder": base}
            else:
                word = label.get(etype, "UNKNOWN" if english else "其他")
                ph = numbered(word, lambda n: f"{left}{word}{'_' if english else ''}{n}{right}")
                facts[ph] = fact(etype, name)
            given[key] = ph
            new.add(ph)
        return ph

    taken: list[tuple[int, int, str, str, str]] = []
    held = Occupied()
    for pos, txt, etype in sorted(spans, key=lambda s: (-len(s[1]), s[0], s[1], s[2])):
        if not held.take(pos, pos + len(txt)):
            continue
        if chosen.get(etype, "placeholder") == "partial":
            mask = partly(txt, etype)
            if mask not in known.owner:
                facts.setdefault(mask, fact(etype, txt))
        else:
            mask = placeholder(etype, txt)
        taken.append((pos, pos + len(txt), txt, etype, mask))
    out, tail, at, log = [], "", len(text), []
    for start, stop, txt, etype, mask in sorted(taken, reverse=True):
        gap = text[stop:at]
        if logged:
            tail = gap + tail if len(gap) < 40 else gap  # as much of the masked right side as a context shows
            log.append({"original_text": txt, "masked_text": mask, "type": etype, "position": start, "context_before": text[max(0, start - 40) : start], "context_after": tail[:40]})
            tail = (mask + tail)[:80]
        else:
            log.append(mask)
        out += [gap, mask]
        at = start
    return "".join(reversed([*out, text[:at]])), facts, log, free


def mask_one(text: str, spans: list[tuple[int, str, str]], chosen: dict[str, str], style: str, seed: dict[str, tuple[str, str]], short: dict[str, str]) -> tuple[str, dict[str, dict], list[dict]]:
    """(masked text, mapping, log) of one text; see masked()."""
    out, facts, log, _ = mask_with(Known(seed), text, spans, chosen, style, short)
    return out, {ph: fact(*k) for ph, k in seed.items()} | facts, log


FACT = "struct<type:string,original:string,is_abbreviation:boolean,full_name:string,full_placeholder:string>"
LOG = "array<struct<original_text:string,masked_text:string,type:string,position:int,context_before:string,context_after:string>>"


#: What masked() makes.
MADE = {"masked_text": "string", "mapping": f"map<string,{FACT}>", "log": LOG, "replacements": "long"}


def masked(df: DataFrame, spans: str = "spans", text_col: str = "text", overrides: dict[str, str] | None = None, everything: str | None = None, style: str = "english_bracket", seed: str | None = None, abbreviations: str | None = None, made: tuple[str, ...] = ("masked_text", "mapping", "log"), keep: list[str] | None = None) -> DataFrame:
    """df with masked_text, mapping (placeholder -> type, original, is_abbreviation, full_name, full_placeholder), log; or,
    with made and keep, its columns keep with these of the three, or replacements (how many the log has).

    Longer spans come first and overlapping shorter ones go; in that order new names get numbers. seed: a column like
    mapping; its placeholders stay and its numbers are not used again. abbreviations: a map column short -> full.
    One pass in Arrow batches over texts and spans: numbering with shared labels and seeds is a fold with state, which
    nested array functions would make anew for each of their elements.
    """
    if style not in STYLES:
        raise ValueError(f"style is one of {tuple(STYLES)}")
    chosen = strategies(overrides, everything)
    inputs = [text_col, spans, *(c for c in (seed, abbreviations) if c)]
    logged = "log" in made

    def run(texts, found, *more):
        texts = texts.to_pylist()
        empty = [None] * len(texts)
        old = more[0].to_pylist() if seed else empty
        short = more[-1].to_pylist() if abbreviations else empty
        out = {c: [] for c in MADE}
        for t, s, o, a in zip(texts, tuples(found, "pos", "txt", "etype"), old, short, strict=True):
            seeds = {k: (v["type"], v["original"]) for k, v in dict(o or {}).items()}
            m, facts, log, _ = mask_with(Known(seeds), t or "", s, chosen, style, dict(a or {}), logged)
            if "mapping" in made:
                out["mapping"].append([*({ph: fact(*k) for ph, k in seeds.items()} | facts).items()])
            out["masked_text"].append(m if t is not None else None)
            out["log"].append(log)
            out["replacements"].append(len(log))
        return [out[c] for c in made]

    return with_columns_from(df, inputs, ", ".join(f"{c} {MADE[c]}" for c in made), run, keep)


def restored(df: DataFrame, mapping: str = "mapping", text_col: str = "masked_text", into: str = "restored_text", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns keep, with placeholders replaced by their originals, longer placeholders first; empty originals
    are left out. A step of the pass that masks, where it follows one."""

    def run(mappings, texts):
        out = []
        for m, t in zip(mappings.to_pylist(), texts.to_pylist(), strict=True):
            if m and t:
                originals = {k: v["original"] for k, v in m if v and v["original"]}
                for k in sorted(originals, key=lambda k: (-len(k), k)):
                    t = t.replace(k, originals[k]) if k else t
            out.append(t)
        return [out]

    return with_columns_from(df, [mapping, text_col], f"{into} string", run, [c for c in df.columns if c != into] if keep is None else keep)


def flat_mapping(mapping: dict) -> dict[str, str]:
    """placeholder -> original of a mapping as JSON: with or without a wrapper, facts or plain strings; empty ones go."""
    inner = mapping.get("mapping", mapping) if isinstance(mapping.get("mapping"), dict) else mapping
    pairs = {k: v.get("original") if isinstance(v, dict) else v for k, v in inner.items()}
    return {k: v for k, v in pairs.items() if isinstance(v, str) and v}

"""The 35 structured identifier types: patterns, precedence, labels and the tests of a match in its context.

A failed test takes a match away before overlaps are resolved, so that it doesn't keep others out. The scan is one Arrow
pass with compiled patterns: a text is searched for a type only if it has digits enough in a row and one of the type's
marks, positions come from the matches, and overlaps are resolved by bisection, so that the work grows with n log n of a
text's matches. As expressions (three passes of each pattern and nested array functions) the same scan took 13 s to plan
and 2.5 times as long to run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from veilspark.functions.shipping import span_lists, with_columns_from
from veilspark.functions.spans import SPAN, Occupied


@dataclass(frozen=True)
class Spec:
    etype: str
    prio: int
    label: str
    #: Digits in a row that a text with a match has at least, and marks (in small letters too) of which it has one.
    run: int
    marks: tuple[str, ...]
    pattern: str


_CREDIT = "0-9A-HJ-NPQRTUWXY"
_PROVINCE = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"
_ALNUM = "A-Za-z0-9"
_URL = r"""[^\s<>"{}|\\^`\[\]））、。，；]"""
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"

# Types in order of precedence among equals, their priority (smaller wins), label and pattern; what a text
# must have for a search.
SPECS: tuple[Spec, ...] = (
    Spec("id_card", 2, "身份证号", 17, (), r"(?<!\d)[1-9]\d{5}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
    Spec("passport", 2, "护照号", 7, (), rf"(?<![{_ALNUM}])(?:[EeGg]\d{{8}}|[Pp]\d{{7}}|[Hh]\d{{8}}|[Mm]\d{{7}}|E[A-Z]\d{{7}})(?![{_ALNUM}])"),
    Spec("hk_macau_pass", 2, "港澳通行证", 8, (), rf"(?<![{_ALNUM}])[WwCc]\d{{8}}(?![{_ALNUM}])"),
    Spec("taiwan_pass", 2, "台湾通行证", 8, (), rf"(?<![{_ALNUM}])[Tt]\d{{8}}(?![{_ALNUM}])"),
    Spec("military_id", 2, "军官证", 4, ("字",), rf"(?<![{_ALNUM}])[军士官兵]\s?字\s?第\s?\d{{4,8}}\s?号(?![{_ALNUM}])"),
    Spec("credit_code", 2, "统一社会信用代码", 6, (), rf"(?<![{_CREDIT}])[{_CREDIT}]{{2}}\d{{6}}[{_CREDIT}]{{10}}(?![{_CREDIT}])"),
    Spec("org_code", 3, "组织机构代码", 0, ("-",), rf"(?<![{_CREDIT}])[{_CREDIT}]{{8}}-[{_CREDIT}](?![{_CREDIT}])"),
    Spec("tax_number", 6, "税务登记号", 15, (), r"(?<!\d)\d{15,20}(?!\d)"),
    Spec("case_number", 3, "案号", 4, ("号",), r"[\(（〈《﹝〔]\s*\d{4}\s*[\)）〉》﹞〕]\s*[一-龥A-Za-z0-9#\s]{1,25}号"),
    Spec("contract_number", 3, "合同编号", 0, ("合同编号", "协议编号", "Contract"), r"(?:合同编号|协议编号|Contract[-\s]?No)[：:.]\s*[A-Za-z0-9\-_]{6,30}"),
    Spec("invoice_number", 3, "发票号码", 8, ("发票",), r"(?:发票号码|发票代码)[：:.]\s*\d{8,20}"),
    Spec("phone", 3, "手机号", 11, (), r"(?<!\d)1[3-9]\d{9}(?![0-9A-Za-z])"),
    Spec("fax", 3, "座机/传真", 7, (), r"(?<!\d)(?:0\d{2,3}[- ]?\d{7,8}|\(0\d{2,3}\)\d{7,8})(?!\d)"),
    Spec("toll_free", 3, "400/800电话", 4, (), r"(?<!\d)[48]00[- ]?\d{3}[- ]?\d{4}(?!\d)"),
    Spec("email", 3, "邮箱", 0, ("@",), r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    Spec("website", 3, "网址", 0, ("http", "www."), rf"https?://{_URL}+|(?<![A-Za-z0-9.])www\.[A-Za-z0-9][-A-Za-z0-9.]*\.[A-Za-z]{{2,}}(?:/{_URL}*)?"),
    Spec("social_account", 2, "QQ/微信号", 0, ("微信", "微博", "wechat", "vx", "weibo", "qq", "q号"), r"(?i)(?:微信号?|wechat|VX|微博号?|weibo)[\s:：]*[a-zA-Z][a-zA-Z0-9_\-]{4,19}|(?<!\w)(?:QQ号码?|QQ号|Q号|QQ)[\s:：]*[1-9]\d{4,9}(?!\d)"),
    Spec("ip_address", 3, "IP地址", 1, (".",), rf"(?<!\d)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d)"),
    Spec("mac_address", 3, "MAC地址", 0, (":", "-"), r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
    Spec("bank_account", 5, "银行卡号", 8, (), r"(?<!\d)\d{16,19}(?!\d)|(?:账号|账户|帐号|帐户|户口号码|户口號碼|银行账号|银行账户|收款账号)[：:.\s]*\d{8,19}"),
    Spec("amount", 3, "金额", 0, ("元", "圆", "¥", "￥", "人民币"), r"(?:¥|人民币|￥)\s*\d{1,3}(?:[,，]\d{3})+(?:\.\d{1,2})?\s*(?:元|万元|亿元)?|(?:¥|人民币|￥)\s*\d+(?:\.\d{1,2})?\s*(?:元|万元|亿元)?"
         r"|(?<![,，\d.])\d{1,3}(?:[,，]\d{3})+(?:\.\d{1,2})?\s*(?:元|万元|亿元)|(?<![,，\d.])\d+(?:\.\d{1,2})?\s*(?:元|万元|亿元)"
         r"|[零壹贰叁肆伍陆柒捌玖拾佰仟万亿]+[元圆][整正]?(?:[零壹贰叁肆伍陆柒捌玖拾]+[角分])*"),
    Spec("price", 3, "价格", 0, ("USD", "EUR", "GBP", "HKD", "JPY", "CNY", "RMB", "AUD", "CAD", "CHF", "$", "€", "£"), r"(?:USD|EUR|GBP|HKD|JPY|CNY|RMB|AUD|CAD|CHF|US\$|€|£|HK\$)\s*[\d,]+\.?\d*"),
    Spec("license_plate", 3, "车牌号", 0, tuple(_PROVINCE), rf"[{_PROVINCE}][A-Z][A-Z0-9]{{4,5}}[A-Z0-9挂学警港澳]?"),
    Spec("vin", 3, "车辆识别码", 0, (), r"(?<![A-HJ-NPR-Z0-9])[A-HJ-NPR-Z0-9]{17}(?![A-HJ-NPR-Z0-9])"),
    Spec("date", 4, "日期", 4, ("-", "/", "年"), r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?|\d{4}年\d{1,2}月\d{1,2}日"),
    Spec("time", 4, "时间", 1, (":", "时"), r"\d{1,2}:\d{2}(?::\d{2})?|\d{1,2}时\d{1,2}分\d{1,2}秒?"),
    Spec("datetime", 1, "日期时间", 4, ("-", "/", "年"), r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号\s]\s*\d{1,2}:\d{2}(?::\d{2})?"),
    Spec("full_address", 2, "完整地址", 0, ("省", "市", "区", "县", "镇", "街道"), r"[一-龥]{2,10}(?:省|市|区|县|镇|街道)[一-龥\d]{2,50}(?:层|楼|室|栋|幢|单元|\d号|苑|园|城|座|铺|店|馆|厅|堂|坊|府|邸|庄|寓|舍|宅|村|组|路|街|巷|弄|里|胡同|大道|公路|大街|小区|花园|工业区|产业园|商务中心|\d{2,5})(?![一-龥\d%％股权])"),
    Spec("postal_code", 8, "邮政编码", 6, (), r"(?<!\d)\d{6}(?!\d)"),
    Spec("house_number", 7, "门牌号", 1, ("弄", "单元", "号楼", "号院", "号室", "栋", "座", "楼", "室"), r"\d+(?:弄|单元|号楼|号院|号室|栋|座|楼|室)(?:-\d+)?"),
    Spec("property_cert", 2, "房地产证号", 0, ("房地字第", "FH", "不动产权第"), rf"(?:[一-龥]{{1,4}}房地字第|FH)\s*\d{{5,15}}\s*号?|(?:[{_PROVINCE}])?\s*(?:[\(（]\s*\d{{4}}\s*[\)）])?\s*[一-龥]{{2,12}}\s*不动产权第\s*[A-Za-z0-9\s]{{1,15}}\s*号"),
    Spec("permit_number", 3, "证书/批文编号", 2, ("字",), r"[一-龥]{2,8}字\s*(?:第\s*)?\d{2,15}\s*号"),
    Spec("patent_number", 3, "专利/商标编号", 0, ("专利", "商标", "著作权", "CN", "US", "EP", "JP", "WO", "KR", "GB", "DE", "FR", "CA", "AU"), r"(?:专利|商标|著作权)(?:申请|注册|登记)号[：:]\s*[A-Z0-9.]+|(?:CN|US|EP|JP|WO|KR|GB|DE|FR|CA|AU)\d{4,}[A-Z]?\d?"),
    Spec("document_number", 3, "文件编号", 0, ("编号", "文件号", "协议号"), r"(?:文件编号|文件号|函件编号|协议号|编号)[：:.]\s*[A-Za-z0-9\-_]{4,30}"),
    Spec("project_name", 5, "项目名称", 0, ("项目", "工程", "系统", "平台", "计划"), r"([一-龥]{2,10}(?:项目|工程|系统|平台|计划))(?![一-龥])"),
)

# Words that take a match away, or are needed near it.
SECURITIES = ("证券代码", "债券代码", "股票代码", "基金代码", "代码：", "代码:", "代码为", "代码“", '代码"', "代码 ", "码为", "证券简称", "股票简称")
STOCK_PREFIXES = ("600", "601", "603", "605", "688", "689", "000", "001", "002", "003", "300", "301")
LEGAL_TERMS = ("证券交易所", "交易所", "监管指引", "管理办法", "管理条例", "实施细则", "上市")
DOCUMENT_WORDS = ("指导案例", "检例", "检例第", "案例第", "第", "公告", "通知", "决定", "规定", "条")
PASSPORT_WORDS = ("护照", "出入境", "签证", "passport", "证件号", "旅行证件")
ARTICLE_WORDS = ("第", "本条", "上条", "前条", "下条")
GENERIC_PROJECTS = tuple(
    "测试项目 示例项目 工程项目 系统项目 本项目 该项目 其他项目 相关项目 涉案项目 目标项目 拟建项目 建设项目 投资项目 合作项目 试点项目 重点项目 改造工程 建设工程 施工工程 本工程 该工程 "
    "管理系统 信息系统 业务系统 本系统 该系统 操作系统 交易平台 服务平台 管理平台 本平台 该平台 网络投票平台 投票平台 交易系统 信息披露平台 行动计划 工作计划 实施计划 本计划 该计划 加固改造工程".split()
)



_compiled = lru_cache(None)(re.compile)


@dataclass(frozen=True)
class Near:
    """A test of what stands around a match: so many characters before, the match itself or not, so many after."""

    says: str
    before: int = 0
    own: bool = False
    after: int = 0
    holds: bool = True
    joined: bool = False

    def __call__(self, text: str, start: int, stop: int) -> bool:
        near = text[max(0, start - self.before) : start] + (text[start:stop] if self.own else "") + text[stop : stop + self.after]
        if self.joined:
            near = near.replace("\r", "").replace("\n", "")
        return (_compiled(self.says).search(near) is not None) is self.holds


def _one_of(words) -> str:
    return "|".join(map(re.escape, words))


#: A match goes where all tests of one line hold. project_name and patent_number: tests of the match alone.
VETOES: dict[str, tuple[tuple[Near, ...], ...]] = {
    "full_address": ((Near("(?:人民法院|人民检察院)$", own=True),), (Near(_one_of(LEGAL_TERMS), own=True),)),
    "postal_code": (
        (Near(_one_of(SECURITIES), before=30, joined=True),),
        (Near(r"元|^\s*[x×*+\-月天年日]", after=5),),
        (Near(r"[+\-x×*=(（]\s*$", before=3),),
        (Near(f"^(?:{_one_of(STOCK_PREFIXES)})", own=True), Near("邮编|邮政|邮区", before=20, own=True, after=10, holds=False, joined=True)),
    ),
    "amount": (
        (Near(r"\d", before=1),),
        (Near(r"^[\d\-]", after=1), Near("(?:[元圆]|[元圆]整)$", own=True, holds=False)),
        (Near(_one_of(ARTICLE_WORDS), before=10), Near("第", before=4, own=True, after=2), Near("元", own=True)),
    ),
    "project_name": ((Near(f"^(?:{_one_of(GENERIC_PROJECTS)})$|\n", own=True),),),
    "patent_number": ((Near(r"(?s)^.{0,5}$", own=True),),),
    "house_number": ((Near(_one_of(DOCUMENT_WORDS), before=15),),),
    "passport": ((Near("^[Pp]", own=True), Near("(?i)" + _one_of(PASSPORT_WORDS), before=50, own=True, after=50, holds=False)),),
}
VETOES["price"] = VETOES["amount"]
#: What is cut off the start of a match.
PREFIXES = {"full_address": re.compile("住所地|住所|地址")}
_DIGITS = re.compile(r"\d+")
#: Marks of one character and longer ones, by type; characters of which a text with a match has one (the marks' first
#: ones, or what a pattern without marks begins with); fewest characters; types whose marks also stand for capitals.
_SINGLE = {s.etype: frozenset(m for m in s.marks if len(m) == 1) for s in SPECS}
_LONGER = {s.etype: tuple(m for m in s.marks if len(m) > 1) for s in SPECS}
_FIRST = {s.etype: frozenset(c for m in s.marks for c in (m[0], m[0].upper())) for s in SPECS if s.marks} | {
    k: frozenset(v) for k, v in {"passport": "EeGgPpHhMm", "hk_macau_pass": "WwCc", "taiwan_pass": "Tt", "phone": "1", "fax": "0", "toll_free": "48"}.items()
}
_LEAST = {"id_card": 18, "credit_code": 18, "vin": 17}
_ANY_CASE = {s.etype for s in SPECS if s.pattern.startswith("(?i)")}


class Selected(tuple):
    """(seq, spec) of the wanted types, with what a scan needs of each at hand."""

    def __init__(self, _=()):
        self.plan = [(seq, s, s.run, _LEAST.get(s.etype, 1), _FIRST.get(s.etype), s.etype, _compiled(s.pattern).finditer, VETOES.get(s.etype), PREFIXES.get(s.etype)) for seq, s in self]

    def __reduce__(self):
        return Selected, (tuple(self),)


def selected(only: list[str] | None = None, exclude: list[str] | None = None) -> Selected:
    """(seq, spec) of the wanted types; an empty list means no restriction. Patterns of others are never run."""
    names = lambda xs: {x.strip() for x in xs or ()}
    return Selected((k, s) for k, s in enumerate(SPECS) if (not only or s.etype in names(only)) and s.etype not in names(exclude))


def small(text: str) -> str:
    """text in small letters; two letters have small forms that str.lower() doesn't give but patterns without case accept."""
    return text.lower().replace("i\u0307", "i").replace("ı", "i")


def may_have(spec: Spec, text: str, low: str, longest: int, chars: set[str] | None = None) -> bool:
    """Whether a text (low: in small letters, longest: most digits in a row, chars: its characters) can have a match."""
    if longest < spec.run:
        return False
    if not spec.marks or not _SINGLE[spec.etype].isdisjoint(text if chars is None else chars):
        return True
    for m in _LONGER[spec.etype]:
        if m in text:
            return True
    if spec.etype in _ANY_CASE:
        for m in spec.marks:
            if m in low:
                return True
    return False


def scan(text: str, specs: Sequence[tuple[int, Spec]], resolve: bool = True) -> list[tuple]:
    """Spans (pos, txt, etype, layer, prio, seq) of a text by position. resolve: by priority, then length, type and
    position, overlapping ones go; without it all matches that pass their tests stay."""
    longest = max(map(len, _DIGITS.findall(text)), default=0)
    low, chars, size = small(text), set(text), len(text)
    found = []
    for seq, spec, run, least, first, etype, matches, vetoes, prefix in (specs if isinstance(specs, Selected) else Selected(specs)).plan:
        if longest < run or size < least or (first is not None and first.isdisjoint(chars)) or not may_have(spec, text, low, longest, chars):
            continue
        for m in matches(text):
            start, stop = m.span()
            if vetoes and any(all(test(text, start, stop) for test in tests) for tests in vetoes):
                continue
            cut = prefix.match(text, start, stop) if prefix else None
            found.append((spec.prio, start - stop, seq, start, cut.end() if cut else start, stop, etype))
    if resolve:
        found.sort()
        taken, kept = Occupied(), []
        for x in found:
            # a prefix that is cut off a match still counts while the match asks for its place, not once it has it
            if taken.free(x[3], x[5]):
                taken.add(x[4], x[5])
                kept.append(x)
        found = kept
    return [(pos, text[pos:stop], etype, "pattern", prio, seq) for pos, seq, etype, stop, prio in sorted((x[4], x[2], x[6], x[5], x[0]) for x in found)]


def with_pattern_spans(df: DataFrame, text_col: str = "text", only: list[str] | None = None, exclude: list[str] | None = None, into: str = "pattern_spans", resolve: bool = True) -> DataFrame:
    """df with the array of pattern spans of each text by position; see scan()."""
    specs = selected(only, exclude)
    return with_columns_from(df, [text_col], f"{into} array<{SPAN}>", lambda texts: [span_lists([scan(t, specs, resolve) if t else [] for t in texts.to_pylist()])])


def catalogue(spark) -> DataFrame:
    """seq, etype, prio, label of every type."""
    return spark.createDataFrame([(k, s.etype, s.prio, s.label) for k, s in enumerate(SPECS)], "seq int, etype string, prio int, label string")

"""Text normalisation as chains of expressions. Replacements consume both neighbours, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of organisations that a line break may cut off.
ORG_ENDINGS = (
    "有限公司 有限责任公司 股份有限公司 股份公司 集团公司 集团 律师事务所 会计师事务所 公证处 人民法院 人民检察院 人民政府 公安局 派出所 管理局 监督局 委员会 居委会 村委会 街道办事处 办事处 "
    "研究院 研究所 实验室 大学 学院 医院 银行 信用社 基金会 协会 商会 学会"
).split()
#: Characters that are folded before recognised lines are compared, and what they become.
FOLD_FROM, FOLD_TO = "【】《》＜＞，。；：！？", "<><><>,.;:!?"


def _chain(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, into in steps:
        x = F.regexp_replace(x, pattern, into)
    return x


def joined_lines(x: Column) -> Column:
    """Without control characters that XML forbids, and without single line breaks inside Chinese text."""
    cjk, pair = "[一-龥]", "$1$2"
    return _chain(
        x, (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (rf"({cjk})\n({cjk})", pair), (rf"({cjk})\n([（）《》、，。；：])", pair), (rf"([（《、，。；：])\n({cjk})", pair),
        (rf"(?U)({cjk})\n(\d)", pair), (rf"(?U)(\d)\n({cjk})", pair), (rf"({cjk})\n([A-Za-z])", pair), (rf"([A-Za-z])\n({cjk})", pair),
    )


def joined_names(x: Column) -> Column:
    """Organisation names and short line ends that a page's line breaks have cut."""
    ends = "|".join(ORG_ENDINGS)
    return _chain(x, (rf"([一-龥]{{1,15}})\n({ends})", "$1$2"), (rf"([一-龥])\n([一-龥]{{1,20}}(?:{ends}))", "$1$2"), (r"(?d)([一-龥])(?<![。！？；：，、）》」』】])\n(?=[一-龥]{1,3}(?:[。！？；：，、）》」』】\n]|$))", "$1"))


def without_ocr_noise(x: Column) -> Column:
    """Without bars, stray letters after closing marks, and blanks around Chinese characters."""
    cjk = "[一-龥]"
    x = _chain(x, (r"(?U)\s*\|\s*", ""), (r"(?dU)(?<=[。，、；：！？）\)）])\s*[a-zA-Z]{1,3}\s*(?=\n|$)", ""), (r"[ \t]{2,}", " "), *[(rf"(?U)({cjk})\s+({cjk})", "$1$2")] * 3)
    return _chain(x, (rf"(?U)({cjk})\s+(\d)", "$1$2"), (rf"(?U)(\d)\s+({cjk})", "$1$2"), (rf"(?U)({cjk})\s+([，。、；：！？）\)》」』】])", "$1$2"), (rf"(?U)([（\(《「『【])\s+({cjk})", "$1$2"))


def folded_ocr_lines(x: Column) -> Column:
    """Lines joined until one ends a sentence or is followed by an empty one; lines of under two letters go."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    put = lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"])))

    def step(a, line):
        new, joined = F.struct(line.alias("held"), put(a).alias("out")), F.struct(F.concat(a["held"], line).alias("held"), a["out"].alias("out"))
        noise = F.length(F.regexp_replace(line, "[^a-zA-Z0-9一-龥]", "")) < 2
        return F.when(line == "", F.struct(F.lit("").alias("held"), put(a).alias("out"))).when(noise, a).when((a["held"] == "") | a["held"].rlike("[。！？]$"), new).otherwise(joined)

    return F.aggregate(F.transform(F.split(x, "\n", -1), strip), start, step, lambda a: F.array_join(put(a), "\n"))


def fixed_ocr(x: Column) -> Column:
    return folded_ocr_lines(without_ocr_noise(x))


def folded_marks(x: Column) -> Column:
    return F.translate(x, FOLD_FROM, FOLD_TO)


def safe_filename(x: Column, fallback: str = "file") -> Column:
    """The last part of a path without separators, control characters, and blanks or dots at its ends."""
    base = F.element_at(F.split(F.coalesce(x, F.lit("")), r"[/]"), -1)
    clean = F.trim(F.regexp_replace(base, r"[\\/\x00-\x1f\x7f]+", "_"), F.lit(" ."))
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def placeholder_style(x: Column) -> Column:
    """chinese_bracket, or english_bracket for ten letters or more of which most are Latin."""
    cjk, latin = F.regexp_count(x, F.lit("[一-鿿]")), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when((cjk + latin < 10) | (cjk >= latin), F.lit("chinese_bracket")).otherwise(F.lit("english_bracket"))


def eta_seconds(suffix: Column, pages: Column, kb: Column, scanned: Column) -> Column:
    """Expected seconds for a file, by kind and size."""
    s = F.lower(suffix)
    pdf = F.when(scanned, F.greatest(F.lit(8.0), pages * 13.0 + 3)).otherwise(F.greatest(F.lit(2.0), pages * 0.8 + 1.5))
    return F.when(s == ".pdf", pdf).when(s.isin(".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".gif", ".webp"), F.lit(8.0)).when(s.isin(".doc", ".docx"), F.greatest(F.lit(2.0), kb / 100.0)).otherwise(F.greatest(F.lit(1.0), kb / 200.0))


def page_route(native: Column, use_ocr: Column) -> Column:
    """ocr or native for a page: forced recognition gives way to 200 characters of native text; a page with under 50 is
    recognised without being asked."""
    n = F.length(F.regexp_replace(native, r"(?U)^\s+|\s+$", ""))
    return F.when(n >= 200, F.lit("native")).when(use_ocr | (n < 50), F.lit("ocr")).otherwise(F.lit("native"))


def document_lines(x: Column) -> Column:
    """array of struct(line, title) of a written document: separators and page marks go, short headings are titles."""
    lines = F.filter(F.transform(F.split(x, "\n", -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: (s != "") & ~s.rlike(r"^={10,}") & ~s.rlike(r"(?U)^第\s*\d+\s*页"))
    title = lambda s: (F.length(s) <= 25) & s.rlike(r"(?U)^第[一二三四五六七八九十百\d]+[章节条部分]|^[一二三四五六七八九十]+、|^（[一二三四五六七八九十]+）|^\d+[.、]\s*[一-龥]|(判决书|裁定书|决定书|合同|协议|报告|通知|公告)$")
    return F.transform(lines, lambda s: F.struct(s.alias("line"), title(s).alias("title")))


def chunked(x: Column, size: int, marks: tuple[str, ...] = ("\n\n", "\n", "。", "；")) -> Column:
    """array of struct(chunk, offset): cuts after the last mark within size, if that's past half of it; the chunks
    joined are the text. Work is linear in the number of chunks."""

    def cut(rest):
        head = F.substring(rest, 1, size)
        found = [F.length(head) - F.length(F.substring_index(head, m, -1)) for m in marks]
        out = F.lit(size)
        for m, f in reversed(list(zip(marks, found, strict=True))):
            out = F.when(F.contains(head, F.lit(m)) & (f > size // 2), f).otherwise(out)
        return F.when(F.length(rest) <= size, F.length(rest)).otherwise(out)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<chunk:string,offset:int>>").alias("out"))

    def step(a, _):
        rest = F.substring(x, a["at"] + 1, F.lit(size + 1))
        n = cut(rest)
        more = F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(F.struct(F.substring(x, a["at"] + 1, n).alias("chunk"), a["at"].alias("offset")))).alias("out"))
        return F.when(F.length(rest) == 0, a).otherwise(more)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(2 * F.length(x) / size).cast("int") + 1), start, step, lambda a: a["out"])

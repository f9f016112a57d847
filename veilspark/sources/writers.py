"""Written documents as bytes: text, DOCX and PDF with plain layout, by the standard library alone.

Titles are told from lines as in normalize.document_lines(). A PDF names a standard Chinese font without embedding it.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from veilspark.sources.files import OUTPUTS, docx_replaced

# Font, sizes in points, line distance, and what makes a short line a title.
FONT, SIZE, TITLE_SIZE, SPACING = "仿宋", 12, 15, 1.5
TITLE = re.compile(r"第[一二三四五六七八九十百\d]+[章节条部分]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+[.、]\s*[一-龥]|.*(?:判决书|裁定书|决定书|合同|协议|报告|通知|公告)$")
SKIPPED = re.compile(r"={10,}|第\s*\d+\s*页")


def document_lines(text: str) -> list[tuple[str, bool]]:
    """(line, title) of a written document."""
    lines = (x.strip() for x in text.split("\n"))
    return [(x, len(x) <= 25 and TITLE.match(x) is not None) for x in lines if x and not SKIPPED.match(x)]


def docx_written(text: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def paragraph(line: str, title: bool) -> str:
        size = 2 * (TITLE_SIZE if title else SIZE)
        fonts = f'<w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:eastAsia="{FONT}"/>'
        look = f'<w:jc w:val="center"/>' if title else ""
        return f'<w:p><w:pPr><w:spacing w:line="{round(240 * SPACING)}" w:lineRule="auto"/>{look}</w:pPr><w:r><w:rPr>{fonts}{"<w:b/>" if title else ""}<w:sz w:val="{size}"/></w:rPr><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'

    body = "".join(paragraph(*x) for x in document_lines(text))
    page = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:bottom="1440" w:left="1800" w:right="1800"/></w:sectPr>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{w}"><w:body>{body}{page}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _wrapped(line: str, size: float, width: float) -> list[str]:
    """Pieces of a line that fit: Chinese characters are as wide as the size, others half."""
    out, used = [""], 0.0
    for c in line:
        step = size if ord(c) > 0x7F else size / 2
        if used + step > width and out[-1]:
            out.append("")
            used = 0.0
        out[-1] += c
        used += step
    return out


def pdf_written(text: str) -> bytes:
    """A4 pages with wrapped lines. Characters beyond the basic plane become a mark."""
    width, height, edge = 595.0, 842.0, 72.0
    pages: list[list[str]] = [[]]
    y = height - edge
    for line, title in document_lines(text):
        size = TITLE_SIZE if title else SIZE
        for piece in _wrapped(line, size, width - 2 * edge):
            y -= size * SPACING
            if y < edge:
                pages.append([])
                y = height - edge - size * SPACING
            code = "".join(c if ord(c) < 0x10000 else "□" for c in piece).encode("utf-16-be").hex()
            pages[-1].append(f"BT /F1 {size} Tf 1 0 0 1 {edge:g} {y:.1f} Tm <{code}> Tj ET")
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [4 0 R] >>", "<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /DW 1000 /FontDescriptor 5 0 R >>", "<< /Type /FontDescriptor /FontName /STSong-Light /Flags 4 /FontBBox [-25 -254 1000 880] /ItalicAngle 0 /Ascent 880 /Descent -120 /CapHeight 880 /StemV 93 >>"]
    kids = []
    for page in pages:
        stream = "\n".join(page)
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>"
    out, at = b"%PDF-1.4\n", []
    for k, x in enumerate(objects, 1):
        at.append(len(out))
        out += f"{k} 0 obj\n{x}\nendobj\n".encode("ascii")
    table = "".join(f"{a:010d} 00000 n \n" for a in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("ascii")


WRITERS = {".txt": str.encode, ".md": str.encode, ".docx": docx_written, ".pdf": pdf_written}


def rendered(kind: str, text: str, source: bytes | None = None, pairs: list[tuple[str, str]] = (), in_place=None) -> tuple[bytes, str]:
    """(bytes, suffix) of a masked document: a DOCX source keeps its layout, in_place (suffix -> function of bytes and pairs)
    does so for others; what fails falls back to a new document, then to text."""
    kind = kind.lower() if kind.lower() in OUTPUTS else ".txt"
    own = {".docx": docx_replaced} | dict(in_place or {})
    for make in ((lambda: own[kind](source, list(pairs))) if source and kind in own else None, lambda: WRITERS[kind](text)):
        try:
            if make is not None:
                return make(), kind
        except Exception:
            continue
    return text.encode(), ".txt"

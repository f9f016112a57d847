"""Files as documents: a row for each file with path, suffix, text, error.

Plain text tries encodings in order; DOCX is read with the standard library; PDF, DOC and image readers are functions
that the caller passes by suffix (none come with this package). A file that fails has an error, others go on.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Mapping
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.shipping import with_columns_from
from veilspark.functions import normalize

INPUTS = (".txt", ".md", ".pdf", ".docx", ".doc", ".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".gif", ".webp")
OUTPUTS = (".txt", ".md", ".pdf", ".docx")
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")
LARGEST = 50 << 20
#: What fields for links leave in a text.
FIELD_CODES = r"HYPERLINK\s+\S+|HYPERLINK"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plain_text(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _paragraph(p) -> str:
    out = "".join("\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}br", f"{_W}tab", f"{_W}instrText"))
    return re.sub(FIELD_CODES, "", out).strip()


def docx_text(data: bytes) -> str:
    """Headers and footers, body paragraphs, then tables with cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        lines = [t for n in parts for p in ElementTree.fromstring(z.read(n)).iter(f"{_W}p") if (t := _paragraph(p))]
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        lines += [t for p in body.findall(f"{_W}p") if (t := _paragraph(p))]
        for row in (r for t in body.findall(f"{_W}tbl") for r in t.iter(f"{_W}tr")):
            cells = [" ".join(t for p in c.iter(f"{_W}p") if (t := _paragraph(p))) for c in row.findall(f"{_W}tc")]
            if any(cells):
                lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def docx_replaced(data: bytes, replacements: list[tuple[str, str]]) -> bytes:
    """A DOCX file with texts replaced, longer ones first, also where a text is spread over several runs: the first run
    gets the new text, the others lose their part. The search goes on behind what was put in."""
    out = io.BytesIO()
    order = sorted(((a, b) for a, b in replacements if a), key=lambda x: -len(x[0]))
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for item in src.infolist():
            raw = src.read(item.filename)
            if re.fullmatch(r"word/(document|header\d*|footer\d*|comments|footnotes|endnotes)\.xml", item.filename):
                root = ElementTree.fromstring(raw)
                for p in root.iter(f"{_W}p"):
                    runs = [t for t in p.iter() if t.tag in (f"{_W}t", f"{_W}delText")]
                    for old, new in order:
                        at = 0
                        while (k := "".join(t.text or "" for t in runs).find(old, at)) >= 0:
                            place, put = 0, False
                            for t in runs:
                                s = t.text or ""
                                a, b = max(k, place) - place, min(k + len(old), place + len(s)) - place
                                if a < b:
                                    t.text = s[:a] + ("" if put else new) + s[b:]
                                    put = True
                                place += len(s)
                            at = k + len(new)
                raw = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            dst.writestr(item, raw)
    return out.getvalue()


def read_files(spark: SparkSession, path: str, readers: Mapping[str, Callable[[bytes], str]] | None = None, largest: int = LARGEST, content: bool = False) -> DataFrame:
    """path, suffix, length, text, error (and content, if asked for) of all files under path. Larger files and unknown kinds without readable text
    have an error."""

    own = dict(readers or {})

    def one(kind, data):
        try:
            if data is None:
                return None, "file too large"
            if kind in own:
                return own[kind](data), None
            if kind == ".docx":
                return docx_text(data), None
            if kind in (".pdf", ".doc", *INPUTS[5:]):
                return None, f"no reader for {kind}"
            return plain_text(data), None
        except Exception as e:  # one file's failure is that file's error
            return None, f"{type(e).__name__}: {e}"

    def extracted(kinds, contents):
        rows = [one(k, c) for k, c in zip(kinds.to_pylist(), contents.to_pylist(), strict=True)]
        return [[t for t, _ in rows], [e for _, e in rows]]

    # the size is tested before contents are read: only files of the right size are opened
    listed = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    small = listed.filter(F.col("length") <= largest).select("path", suffix.alias("suffix"), "length", "content")
    large = listed.filter(F.col("length") > largest).select("path", suffix.alias("suffix"), "length", F.lit(None).cast("binary").alias("content"))
    out = with_columns_from(small.unionByName(large), ["suffix", "content"], "raw string, error string", extracted)
    return out.select("path", "suffix", "length", normalize.joined_lines(F.col("raw")).alias("text"), "error", *(["content"] if content else []))


def converted(commands: list[list[str]], timeouts: tuple[float, ...] = (30, 30, 60)) -> Callable[[bytes], str]:
    """A reader for old DOC files by programs on the executors, the first that succeeds: each command has {file} where the
    input's name goes and writes text to its output. Raises OSError if none does."""

    def read(data: bytes) -> str:
        import subprocess
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".doc") as f:
            f.write(data)
            f.flush()
            for command, limit in zip(commands, timeouts, strict=False):
                try:
                    done = subprocess.run([x.replace("{file}", f.name) for x in command], capture_output=True, timeout=limit, check=True)
                    if done.stdout.strip():
                        return plain_text(done.stdout)
                except (OSError, subprocess.SubprocessError):
                    continue
        raise OSError("no converter gave a text")

    return read


# Scores above which an engine's lines stay, and whether all stay if none does.
ENGINE_LINES = {"rapid": (0.5, True), "paddle": (0.6, False)}


def recognised(engines: Mapping[str, Callable[[bytes], list[tuple[str, float]]]], wanted: str) -> Callable[[bytes], str]:
    """A reader for images by engines (name -> function from an image to lines with scores): the wanted one first, then the
    others in order; one that fails or finds nothing gives way to the next, and without any the text is empty."""
    order = [wanted, *(n for n in engines if n != wanted)]

    def read(data: bytes) -> str:
        for name in order:
            try:
                lines = engines[name](data)
            except Exception:
                continue
            least, fallback = ENGINE_LINES.get(name, (0.0, True))
            good = [t for t, score in lines if score > least] or [t for t, _ in lines if fallback]
            if any(t.strip() for t in good):
                return "\n".join(good)
        return ""

    return read


def paged(pages: Callable[[bytes], list[tuple[str, Callable[[], bytes]]]], ocr: Callable[[bytes], str] | None = None, use_ocr: bool = False) -> Callable[[bytes], str]:
    """A reader for PDF files: pages gives each page's native text and a function that renders it. A page goes to ocr if
    that is asked for and it has under 200 characters, or under 50 without asking."""

    def read(data: bytes) -> str:
        out = []
        for native, render in pages(data):
            n = len(native.strip())
            seen = ocr(render()) if ocr is not None and n < 200 and (use_ocr or n < 50) else ""
            out.append(seen if seen.strip() else native)
        return "\n\n".join(out)

    return read


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, length of supported files that aren't hidden, by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name, suffix = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("suffix", suffix).filter(~F.startswith(name, F.lit(".")) & suffix.isin(*INPUTS)).orderBy("path")


def accepted(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """files (path, length) with status accepted or rejected."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("status", F.when(suffix.isin(*INPUTS) & (F.col("length") <= largest), "accepted").otherwise("rejected"))


def peek(text, most: int = 3000):
    """The start of a text that tells its language."""
    return F.substring(text, 1, most)


def peek_parts(parts, first: int, most: int = 3000):
    """The same of a document in parts: the first 3 pages, or the first 80 paragraphs."""
    return F.substring(F.array_join(F.slice(parts, 1, first), "\n"), 1, most)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """type, name of a JSON list of entities."""
    return spark.read.schema("type string, name string, item_indices array<int>").option("multiLine", True).json(path)


def parse_dictionary(text: str | None) -> list[tuple[str, str]]:
    """(type, name) pairs of a JSON list; missing types are unknown, empty names go."""
    rows = json.loads(text) if text else []
    return list(dict.fromkeys((r.get("type", "unknown"), r["name"]) for r in rows if r.get("name")))


def corpus_list(spark: SparkSession, path: str, there: DataFrame | None = None) -> DataFrame:
    """path of a list of files without blank lines and comments; with there (path) only files that are in it."""
    return corpus_paths(spark.read.text(path), there)


def corpus_paths(lines: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """The same of a table of lines (value)."""
    listed = lines.select(F.trim("value").alias("path")).filter("path <> '' and not startswith(path, '#')")
    return listed if there is None else listed.join(there.select("path").distinct(), "path", "left_semi")


def scanned(pages: DataFrame, by: str = "doc_id", first: int = 3, threshold: int = 80) -> DataFrame:
    """by, is_scanned: fewer characters than threshold a page on average over the first pages."""
    early = pages.filter(F.col("page_num") <= first)
    return early.groupBy(by).agg((F.sum(F.length(F.trim("native_text"))) < threshold * F.count("*")).alias("is_scanned"))


def scanned_in_all(pages: DataFrame, by: str = "doc_id", most: int = 100) -> DataFrame:
    """by, is_scanned: no more than most characters over all pages."""
    return pages.groupBy(by).agg((F.sum(F.length(F.trim(F.coalesce("native_text", F.lit(""))))) <= most).alias("is_scanned"))


def rejoined_pages(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, text: a document's pages in order, with an empty line between."""
    rows = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_num", "native_text"))).alias("p"))
    return rows.select(by, F.array_join(F.transform("p", lambda x: x["native_text"]), "\n\n").alias("text"))

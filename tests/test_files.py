"""Files, sinks and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.functions import masks
from veilspark.operators.detect import detect
from veilspark.sources import files, sinks, writers
from veilspark.streaming import inbox

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("甲\n乙13812345678".encode("gbk"))
    (tmp_path / "b.docx").write_bytes(docx(["电话138", "12345678"], ["x"]))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.suffix: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got[".txt"].text == "甲乙13812345678" and got[".docx"].text == "电话13812345678\nx" and got[".pdf"].error


def test_docx_replacement_over_runs_ends():
    data = files.docx_replaced(docx(["电话138", "12345678，", "a"], ["aa"]), [("13812345678", "[PHONE_1]"), ("a", "aa")])
    assert files.docx_text(data) == "电话[PHONE_1]，aa\naaaa"


def test_sink_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("call 13812345678")
    out = inbox.masked_stream(inbox.text_stream(spark, str(tmp_path / "in")), entities=False, everything="placeholder", mapping=True)
    assert inbox.masked_stream(inbox.text_stream(spark, str(tmp_path / "in"))).columns == ["path", "masked_text"]
    with pytest.raises(ValueError):
        inbox.split_sink("/a/b", "/a/b/c")
    q = out.writeStream.foreachBatch(inbox.split_sink(str(tmp_path / "texts"), str(tmp_path / "maps"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "texts"))
    assert set(got.columns) == {"path", "masked_text", "batch"} and [r.masked_text for r in got.collect()] == ["call [PHONE_1]"]
    assert [r.original for r in spark.read.parquet(str(tmp_path / "maps")).collect()] == ["13812345678"]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("/in/x/a.txt", "13812345678", "done"), ("/in/y/a.txt", "13912345678", "done"), ("/in/../b.md", "1", "error")], "path string, text string, status string")
    df = masks.masked(detect(rows, entities=False))
    listed = sinks.write_texts(df, f"file://{tmp_path}/out", base="file:///in")
    assert (tmp_path / "out/x/a.txt").read_text() == "138******78" and (tmp_path / "out/y/a.txt").read_text() == "139******78" and listed.count() == 3
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix in (".txt", ".md")) == ["a.txt", "a.txt", "b.txt"]
    assert df.select(sinks.masked_name(F.lit("13812345678.txt"), F.col("mapping")).alias("n")).first().n == "138******78.txt"
    sinks.write_zip(df, f"file://{tmp_path}/all.zip", base="/in")
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert sorted(z.namelist()) == ["x/a.txt", "y/a.txt"] and z.read("x/a.txt") == b"138******78"


def test_written_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx(["电话138", "12345678"], ["x"]))
    (tmp_path / "in/b.txt").write_text("第一章\n电话13812345678", encoding="utf-8")
    rows = files.read_files(spark, str(tmp_path / "in"), content=True)
    df = masks.masked(detect(rows, entities=False), everything="placeholder")
    sinks.write_documents(df, f"file://{tmp_path}/out", base=str(tmp_path / "in"))
    assert files.docx_text((tmp_path / "out/a.docx").read_bytes()) == "电话[PHONE_1]\nx" and (tmp_path / "out/b.txt").read_text(encoding="utf-8").endswith("电话[PHONE_1]")
    listed = sinks.write_documents(df, f"file://{tmp_path}/pdf", suffix=".pdf", base=str(tmp_path / "in"))
    assert {r.kind for r in listed.collect()} == {".pdf"} and (tmp_path / "pdf/b.pdf").read_bytes().startswith(b"%PDF-1.4")
    made = writers.docx_written("第一章\n\n==========\n第 3 页\n正文 & 其他")
    assert files.docx_text(made) == "第一章\n正文 & 其他" and writers.document_lines("第一章\n正文")[0] == ("第一章", True)
    assert writers.rendered(".docx", "x", b"broken", []) == (writers.docx_written("x"), ".docx") or writers.rendered(".docx", "x", b"broken", [])[1] == ".docx"
    assert writers.rendered(".odt", "x") == (b"x", ".txt") and writers.pdf_written("字" * 5000).count(b"/Type /Page ") > 1


def test_readers_for_pages_images_and_old_files():
    def broken(data):
        raise RuntimeError

    ocr = files.recognised({"rapid": lambda b: [("好", 0.9), ("坏", 0.2)], "paddle": broken}, "paddle")
    assert ocr(b"") == "好" and files.recognised({"rapid": lambda b: [("低", 0.1)]}, "rapid")(b"") == "低" and files.recognised({"paddle": lambda b: [("低", 0.5)]}, "paddle")(b"") == ""
    pages = lambda data: [("x" * n, lambda: b"") for n in (10, 60, 300)]
    assert files.paged(pages, lambda b: "ocr")(b"") == "ocr\n\n" + "x" * 60 + "\n\n" + "x" * 300
    assert files.paged(pages, lambda b: "ocr", use_ocr=True)(b"").split("\n\n")[:2] == ["ocr", "ocr"] and files.paged(pages)(b"").startswith("x" * 10)
    assert files.converted([["false"], ["cat", "{file}"]])(b"text") == "text"
    with pytest.raises(OSError):
        files.converted([["false"]])(b"text")


def test_inputs_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 100)
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path), largest=50).collect()}
    assert got["a.txt"].error == "file too large" and got["b.exe"].text == "x"
    assert [r.path.rsplit("/", 1)[1] for r in files.inbox(spark, str(tmp_path)).collect()] == ["a.txt"]
    assert {r.status for r in files.accepted(files.inbox(spark, str(tmp_path)), largest=50).collect()} == {"rejected"}
    (tmp_path / "list").write_text("a.txt\n\n# no\nmissing.txt\n")
    there = spark.createDataFrame([("a.txt",)], "path string")
    assert files.corpus_list(spark, str(tmp_path / "list")).count() == 2 and files.corpus_list(spark, str(tmp_path / "list"), there).count() == 1
    pages = spark.createDataFrame([(1, 1, "x" * 60), (1, 2, "y" * 60), (2, 1, "z")], "doc_id long, page_num int, native_text string")
    assert {r.doc_id: r.is_scanned for r in files.scanned_in_all(pages).collect()} == {1: False, 2: True}
    assert {r.doc_id: r.text for r in files.rejoined_pages(pages).collect()}[2] == "z"
    assert pages.groupBy().agg(F.collect_list("native_text").alias("p")).select(files.peek_parts(F.col("p"), 3, 70).alias("t"), files.peek(F.lit("abc"), 2).alias("u")).first().u == "ab"
    (tmp_path / "d.json").write_text('[{"type": "person", "name": "周岩"}, {"name": "x"}]')
    assert files.read_dictionary(spark, str(tmp_path / "d.json")).count() == 2 and files.parse_dictionary('[{"name": "x"}]') == [("unknown", "x")]


def test_command_line(spark, tmp_path, capsys):
    from veilspark import cli

    (tmp_path / "a.txt").write_text("电话13812345678，周岩", encoding="utf-8")
    base = ["mask", str(tmp_path / "a.txt"), "--all-strategy", "placeholder", "-e", '[{"type": "person", "name": "周岩"}]']
    assert cli.main([*base, "-o", str(tmp_path / "out"), "--mapping", str(tmp_path / "map")]) == 0
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["doc_id", "masked_text"] and out.first().masked_text == "电话[PHONE_1]，[PERSON_1]"
    assert cli.main(["restore", str(tmp_path / "out") + "/*.parquet", "--mapping", str(tmp_path / "map")]) == 0
    assert "电话13812345678，周岩" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([*base, "-o", str(tmp_path / "out"), "--mapping", str(tmp_path / "out/m")])
    assert cli.main(["mask", str(tmp_path / "a.txt"), "--only", "phone", "--mask-strategy", "phone=placeholder"]) == 0
    assert "电话[PHONE_1]，周岩" in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "a.txt"), "--context"]) == 0 and "【13812345678】" in capsys.readouterr().out
    assert cli.main(["list-types"]) == 0 and capsys.readouterr().out.count("\n") == 35

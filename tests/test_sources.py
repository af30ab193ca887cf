import io
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import files


def test_strings_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,v\n6.10,\"a\nb\"\n007,\n".encode())
    got = [tuple(r) for r in files.read_strings(spark, str(tmp_path / "a.csv"), ["id", "v"]).collect()]
    assert got == [("6.10", "a\nb"), ("007", None)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2, "b": "x"}\n')
    got = files.read_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()
    assert [(r.a, r.b, r._corrupt is None) for r in got] == [(1, None, True), (None, None, False), (2, "x", True)]


def test_twins(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], True, None)], "k string, l array<string>, b boolean, n string")
    files.write_twins(df, str(tmp_path / "o"), ["k", "l", "b", "n"])
    assert files.read_strings(spark, str(tmp_path / "o/csv")).first()[:3] == ("a", "x,y", "true")
    assert spark.read.json(str(tmp_path / "o/json")).first().l == ["x", "y"]


def test_decode_and_sniff(spark):
    assert files.decode("北".encode("gb18030")) == "北" and files.decode("é".encode()) == "é" and files.decode(None) is None
    assert files.decode(b"<meta charset='latin-1'>" + "é".encode("latin-1")).endswith("é")
    df = spark.createDataFrame([(b"%PDF-1.4",), (b"PK\x03\x04 word/",), (b"PK\x03\x04",), (b"{\\rtf1",), (b"<!DOCTYPE html>",), (b"x",)], "c binary")
    assert [r[0] for r in df.select(files.sniffed(F.col("c"))).collect()] == ["pdf", "docx", "zip", "rtf", "html", "other"]


def test_pages(spark):
    html = "<html><body><nav>no</nav><div class='x main'><h1 id='t'>Title</h1><p>a <b>b</b></p><script>no</script><br>c</div><p>after</p></body></html>"
    text, spans = files.parse_page(html, "main")
    assert text == "Title\na b\nc" and [text[s:e] for _, s, e, _ in spans] == ["Title", "a b", "c"] and spans[0][3] == "t"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    got = files.with_page(df, "h", "p", "main").collect()
    assert got[0].p.text == text and not got[1].p.text and got[2].p.text == ""


def make(name, content):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in zip(name, content):
            z.writestr(n, c)
    return out.getvalue()


def test_office_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = make(["word/document.xml"], [f"<w:document {w}><w:body><w:p><w:r><w:t>第一条　x</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"])
    (tmp_path / "a.docx").write_bytes(doc)
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in files.read_documents(spark, str(tmp_path), "docx").collect()}
    assert got == {"a.docx": ("第一条　x\ncell", True), "b.docx": (None, False)}
    epub = make(["c.opf", "1.html", "2.html"], ['<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="1.html"/><item id="b" href="2.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "<p>one</p>", "<p>two</p>"])
    assert files.epub_text(epub) == "two\none"


def test_workbook_round_trip():
    raw = files.workbook({"A": (["x", "y"], [("1 < 2", None), ("6.10", 3)]), "B": (["z"], [])})
    assert files.read_workbook(raw) == {"A": [["x", "y"], ["1 < 2", ""], ["6.10", "3"]], "B": [["z"]]}

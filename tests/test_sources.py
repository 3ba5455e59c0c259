"""Files and streams on small inputs made here."""

import io
import struct
import zipfile

from folioforge.sources import files
from folioforge.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("One") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p("Two")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_load(spark, tmp_path):
    put = lambda name, b: (tmp_path / name).write_bytes(b)
    put("a.txt", "Quyết định\n2".encode())
    put("bom.md", b"\xef\xbb\xbfx")
    put("old.TXT", "café".encode("latin-1"))
    put("empty.txt", b"")
    put("w.docx", _docx())
    put("bad.docx", b"no zip")
    put("i.png", b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9))
    put("p.pdf", b"%PDF-1.4\n<< /Type /Pages >> << /Type /Page >> << /Type/Page >>")
    put("big.txt", b"x" * 3000)
    put("skip.exe", b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.load(spark, str(tmp_path), max_bytes=2000).collect()}
    assert "skip.exe" not in rows and "empty.txt" not in rows and len(rows) == 8
    assert rows["a.txt"].text == "Quyết định\n2" and rows["bom.md"].text == "x" and rows["old.TXT"].text == "café"
    assert rows["bad.docx"].error.startswith("BadZipFile") and rows["big.txt"].error == "over the size limit" and rows["big.txt"].sha256 is None
    assert (rows["i.png"].width, rows["i.png"].height) == (7, 9) and rows["p.pdf"].page_count == 2
    assert rows["w.docx"].document_type == "docx" and len(rows["a.txt"].document_id) == 20


def test_docx_text():
    assert files.docx_text(_docx()) == "One\na | b\nTwo"


def test_select_pages_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(d, n) for d in "ab" for n in range(1, 6)], "document_id string, page_number int")
    got = lambda **k: sorted(r.page_number for r in files.select_pages(pages, **k).where("document_id = 'a'").collect())
    assert got(first=2, last=9, most=2) == [2, 3] and got(last=3) == [1, 2, 3] and got(most=1) == [1]
    files.save_parquet(pages, str(tmp_path / "p"), "document_id")
    files.save_json(pages, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 10


def test_stream_goes_on(spark, tmp_path):
    source, target, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    texts = ["x" * 3000 + "\n" + "y" * 3000, None, ""]
    for k, text in enumerate(texts):
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.mode("append").parquet(source)
        ingest.ingest(spark, source, target, at).awaitTermination()
        assert spark.read.parquet(target).count() == 2 + k
    want = ingest.pages(spark.read.parquet(source), "batch")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want.collect()))


def test_event_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = ingest.event_counts(events)
    assert got.agg({"n": "sum"}).first()[0] == events.count()

"""Files of texts of the documents' table give these back; broken ones give a note."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from compare import SF

from marlstone.functions import office
from marlstone.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def paragraphs(text: str) -> str:
    return "".join(f'<w:p><w:pPr/><w:r><w:t xml:space="preserve">{escape(x[: len(x) // 2])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(x[len(x) // 2 :])}</w:t></w:r></w:p>' for x in text.split("\n"))


def rtf(text: str) -> bytes:
    units = lambda c: c.encode("utf-16-le")
    said = "".join(
        "\\par\n" if c == "\n" else "\\tab " if c == "\t" else "\\" + c if c in "\\{}" else c if " " <= c < "\x7f" else "".join(f"\\u{int.from_bytes(units(c)[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units(c)), 2)) for c in text
    )
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator no text;}{\\info{\\title none}}\\f0\\fs24 " + said + "}").encode()


def test_documents_come_back(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    clean = {r["doc_id"]: "".join(c for c in r["text"] if c >= " " or c in "\n\t") for r in rows}
    for k, text in clean.items():
        (tmp_path / f"{k}.docx").write_bytes(docx(paragraphs(text)))
        (tmp_path / f"{k}.rtf").write_bytes(rtf(text))
    got = files.documents(spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(rows) and all(r["note"] is None for r in got)
    for r in got:
        assert r["content"] == clean[int(r["name"].split(".")[0])], r["name"]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"{\\rtf1 a\\'e9b}", "aéb"), (b"{\\rtf1\\ansicpg1251 \\'ef}", "п"), (b"{\\rtf1{\\uc2\\u233 xx b}c}", "é bc"), (b"{\\rtf1\\uc0\\u8364 x}", "€x"),
        (b"{\\rtf1 a{\\*\\unknown x{y}}b{\\pict 0102}c}", "abc"), (b"{\\rtf1 a\\~b\\_c\\-d\\{\\}\\\\}", "a\xa0b-cd{}\\"), (b"{\\rtf1 a\\par b\\line c\\tab d\\emdash e}", "a\nb\nc\td—e"),
        (b"{\\rtf1 a\r\nb {\\b bold} c", "ab bold c"), (b"{\\rtf1 }}} x", " x"),
    ],
)
def test_rich_text(data, want):
    assert office.rtf_text(data) == want


def test_docx_marks():
    body = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:del><w:r><w:delText>x</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    assert office.docx_text(docx(body)) == "a\tb\n\nc\n"


def test_broken_files(spark, tmp_path):
    made = {"a.docx": b"no zip", "b.docx": docx("")[:40], "c.rtf": b"plain", "d.doc": b"\xd0\xcf\x11\xe0", "e.doc": b"{\\rtf1 in truth}", "f.txt": "é\n".encode() + b"\xff", "g.html": b"<nav>x</nav><p>y", "h.zip": b"x", "i.txt": b"", "j.md": b"# t"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["content"], r["note"] is None) for r in files.documents(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if not v[1]} == {n: ("", False) for n in ("a.docx", "b.docx", "c.rtf", "d.doc")}
    assert {k: v[0] for k, v in got.items() if v[1]} == {"e.doc": "in truth", "f.txt": "é\n�", "g.html": "y", "j.md": "# t"}  # no row for an empty file

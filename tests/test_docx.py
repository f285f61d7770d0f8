"""DOCX: reading, rewriting run by run, tracked changes, properties."""

import io
import zipfile

from inkveil.operators import redact as R
from inkveil.sources import docx as D

PARAGRAPHS = [("body", ["Ján No", "vák, nar. 850315", "/0018 žije."]), ("body", []), ("ins", ["vložené a@b.sk"]), ("del", ["zmazané c@d.sk"]), ("table_cell", ["IČO 12345679"]), ("table_cell", ["12345670"]), ("header", ["Novák"]), ("footer", ["www.x.sk"]), ("footnote", ["pozri Nováka"]), ("comment", ["koment 12345679"])]
FILE = D.build(PARAGRAPHS, {"creator": "Ján Novák", "title": "Zmluva", "Company": "Firma"})


def test_read(spark):
    bad = [("a.docx", FILE), ("b.docx", b"not a file"), ("c.pdf", b"%PDF"), ("d.docx", b"")]
    rows = {r.path: r for r in D.parsed(spark.createDataFrame(bad, "path string, content binary")).collect()}
    got = [(u.location, u.text) for u in rows["a.docx"].units]
    assert got == [("body", "Ján Novák, nar. 850315/0018 žije."), ("body", ""), ("body", "vložené a@b.sk"), ("body", ""), ("table_cell", "IČO 12345679"), ("table_cell", "12345670"), ("header", "Novák"), ("footer", "www.x.sk"), ("footnote", "pozri Nováka"), ("comment", "koment 12345679")]
    assert "zmazané" in rows["a.docx"].parts["document_xml"] and rows["a.docx"].parts["custom_xml"] == "" and "Ján" in rows["a.docx"].parts["core_xml"]
    assert all(rows[p].error and rows[p].units is None for p in ("b.docx", "c.pdf", "d.docx"))


def test_write(spark):
    files = spark.createDataFrame([("a.docx", FILE, ["Ján Novák"]), ("b.docx", b"x", [])], "path string, content binary, known array<string>")
    units = D.units_of(D.parsed(files).join(files.select("path", "known"), "path"), "known")
    labelled = R.label(R.decide(R.spans(units, "known")))
    out = {r.path: r for r in D.write_docx(files, labelled).collect()}
    assert out["b.docx"].content is None and out["b.docx"].error
    doc = D.Document(bytes(out["a.docx"].content))
    assert [t for _, _, t in doc.texts()] == ["[MENO_1] [MENO_1], nar. [RODNE_CISLO_1] žije.", "", "vložené [EMAIL_1]", "", "IČO [ICO_1]", "12345670", "[MENO_1]", "[URL_1]", "pozri [MENO_1]", "koment [ICO_1]"]
    with zipfile.ZipFile(io.BytesIO(out["a.docx"].content)) as z:
        every = "".join(z.read(n).decode() for n in z.namelist())
    assert not any(x in every for x in ("Novák", "Zmluva", "Firma", "zmazané", "a@b.sk", 'author="Ján')) and "<Pages>1</Pages>" in every
    first = doc.units[0][1]
    assert all(r.find(f"{D.W}rPr/{D.W}b") is not None for _, r in D._runs(first))  # formats stay
    assert D.Document(bytes(out["a.docx"].content)).content() == bytes(out["a.docx"].content)


def test_tabs_breaks_links_and_prefixes():
    w = D.W[1:-1]
    body = '<w:p><w:r><w:t>Ján</w:t><w:tab/><w:t>Novák</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>a@b.sk</w:t></w:r></w:hyperlink><w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>sdt</w:t></w:r></w:p></w:sdtContent></w:sdt>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:mc="m" xmlns:w14="x" mc:Ignorable="w14"><w:body>{body}</w:body></w:document>')
    doc = D.Document(out.getvalue())
    assert doc.texts() == [(0, "body", "Ján\tNovák\na@b.sk"), (1, "body", "sdt"), (2, "textbox", "box")]
    doc.label(0, [(4, 9, "[MENO_1]"), (10, 16, "[EMAIL_1]")])
    assert doc.texts()[0][2] == "Ján\t[MENO_1]\n[EMAIL_1]" and doc.texts()[2][2] == "box"
    assert 'xmlns:w14="x"' in doc.content().decode("latin-1") or b'xmlns:w14="x"' in zipfile.ZipFile(io.BytesIO(doc.content())).read("word/document.xml")
    assert D.Document(doc.content()).texts() == doc.texts()

"""DOCX files as tables: extracted parts, text units in reading order, and files written anew with labels in place of what they stand for.

One walk over a file's paragraphs gives the units on reading and the paragraphs to change on writing, so that a unit's
number means the same in both. Parsed with the standard library, a file a row; labels come from operators.redact.

Units: paragraphs of the body, of its tables, of headers and footers in the order of their sections, of text boxes, of
notes. A unit's text is its runs' text, with tabs and breaks as characters; runs inside links and the like count, too.
Tracked changes are accepted: what was deleted is gone, what was inserted is text.

Defined cases: a file that doesn't open has an error and no units; a missing part is empty; a cell that is merged over
others is one cell; an empty paragraph is a unit without text; a run that a label covers in part keeps its format.
"""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the format: names of parts, elements and attributes; document properties that name people.
W, R = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
PARTS = {"document_xml": r"word/document\.xml", "header": r"word/header\d*\.xml", "footer": r"word/footer\d*\.xml", "footnotes": r"word/footnotes\.xml", "endnotes": r"word/endnotes\.xml", "comments": r"word/comments\.xml", "core_xml": r"docProps/core\.xml", "app_xml": r"docProps/app\.xml", "custom_xml": r"docProps/custom\.xml"}
CORE = ("creator", "lastModifiedBy", "title", "subject", "keywords", "category", "description")
APP = ("Company", "Manager")
CHARACTERS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
TEXTS = r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"


def extract(content: bytes) -> dict[str, str]:
    """Text of each part: all text nodes joined; document properties as raw XML; a missing part is empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = {}
        for part, pattern in PARTS.items():
            raw = [z.read(n) for n in sorted(z.namelist()) if re.fullmatch(pattern, n)]
            out[part] = "".join(r.decode("utf-8", "replace") if pattern.startswith("docProps") else "".join(ET.fromstring(r).itertext()) for r in raw)
        return out


def accept_changes(root: ET.Element) -> None:
    """Deleted content goes, inserted content stays in its place."""
    for parent in list(root.iter()):
        for child in [c for c in parent if c.tag == f"{W}del"]:
            parent.remove(child)
    for parent in list(root.iter()):
        while any(c.tag == f"{W}ins" for c in parent):
            parent[:] = [x for c in parent for x in (list(c) if c.tag == f"{W}ins" else [c])]


def _blocks(parent: ET.Element, tag: str) -> Iterator[ET.Element]:
    """Children of a tag, also inside content controls."""
    for child in parent:
        if child.tag == tag:
            yield child
        elif child.tag == f"{W}sdt":
            for content in child.findall(f"{W}sdtContent"):
                yield from _blocks(content, tag)


def _runs(p: ET.Element) -> list[tuple[ET.Element, ET.Element]]:
    """Parent and run of each run of a paragraph, without those of text boxes in it."""
    out = []

    def walk(at: ET.Element) -> None:
        for child in at:
            if child.tag == f"{W}r":
                out.append((at, child))
            elif child.tag not in (f"{W}p", f"{W}pPr"):
                walk(child)

    walk(p)
    return out


def run_text(run: ET.Element) -> str:
    return "".join(c.text or "" if c.tag == f"{W}t" else CHARACTERS.get(c.tag, "") for c in run)


class Document:
    """A file's parts, and its paragraphs by unit."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.files = {n: z.read(n) for n in z.namelist()}
        self.roots: dict[str, ET.Element] = {}
        self.names: dict[str, list[tuple[str, str]]] = {}
        for n, raw in self.files.items():
            if re.fullmatch(TEXTS, n):
                self.names[n] = [x for _, x in ET.iterparse(io.BytesIO(raw), ["start-ns"])]
                self.roots[n] = ET.fromstring(raw)
                accept_changes(self.roots[n])
        self.units = list(self._walk())

    def _heads(self) -> list[tuple[str, str]]:
        """Headers and footers, section by section, then those that no section names."""
        rels = {}
        if "word/_rels/document.xml.rels" in self.files:
            rels = {r.get("Id"): f"word/{r.get('Target', '')}" for r in ET.fromstring(self.files["word/_rels/document.xml.rels"])}
        found = []
        for section in self.roots["word/document.xml"].iter(f"{W}sectPr"):
            for kind in ("header", "footer"):
                found += [(kind, rels.get(ref.get(f"{R}id"), "")) for ref in section.findall(f"{W}{kind}Reference")]
        found += [(kind, n) for kind in ("header", "footer") for n in sorted(self.roots) if re.fullmatch(PARTS[kind], n)]
        return [(k, n) for k, n in dict.fromkeys(found) if n in self.roots]

    def _walk(self) -> Iterator[tuple[str, ET.Element]]:
        def story(root: ET.Element, location: str, cell: str) -> Iterator[tuple[str, ET.Element]]:
            yield from ((location, p) for p in _blocks(root, f"{W}p"))
            for table in _blocks(root, f"{W}tbl"):
                for tc in table.iter(f"{W}tc"):
                    yield from ((cell, p) for p in _blocks(tc, f"{W}p"))

        body, heads = self.roots["word/document.xml"].find(f"{W}body"), self._heads()
        yield from story(body, "body", "table_cell")
        for kind, n in heads:
            yield from story(self.roots[n], kind, kind)
        for root in (body, *(self.roots[n] for _, n in heads)):
            for box in root.iter(f"{W}txbxContent"):
                yield from (("textbox", p) for p in box.findall(f"{W}p"))
        for part, location in (("footnotes", "footnote"), ("endnotes", "endnote"), ("comments", "comment")):
            if f"word/{part}.xml" in self.roots:
                yield from ((location, p) for p in self.roots[f"word/{part}.xml"].iter(f"{W}p"))

    def texts(self) -> list[tuple[int, str, str]]:
        """unit_seq, location, text."""
        return [(i, location, "".join(run_text(r) for _, r in _runs(p))) for i, (location, p) in enumerate(self.units)]

    def label(self, unit: int, marks: list[tuple[int, int, str]]) -> None:
        """Put labels in place of spans (start, end, label) of a unit, run by run."""
        runs = _runs(self.units[unit][1])
        text = "".join(run_text(r) for _, r in runs)
        covered, label_at = bytearray(len(text)), {}
        for start, end, name in sorted(marks):
            covered[start:end] = b"\1" * (min(end, len(text)) - start)
            label_at.setdefault(start, name)
        at = 0
        for parent, run in runs:
            size = len(run_text(run))
            if 1 in covered[at : at + size]:
                pieces = [""]
                for i in range(at, at + size):
                    if i in label_at:
                        pieces += [label_at[i], ""]
                    if not covered[i]:
                        pieces[-1] += text[i]
                _replace(parent, run, [p for p in pieces if p])
            at += size

    def scrub(self) -> None:
        """Blank who wrote, changed and commented on the file, and what it is called."""
        if "docProps/core.xml" in self.files:
            self.files["docProps/core.xml"] = _blanked(self.files["docProps/core.xml"], CORE)
        if "docProps/app.xml" in self.files:
            self.files["docProps/app.xml"] = _blanked(self.files["docProps/app.xml"], APP)
        for comment in self.roots["word/comments.xml"].iter(f"{W}comment") if "word/comments.xml" in self.roots else ():
            for name in ("author", "initials"):
                if comment.get(f"{W}{name}") is not None:
                    comment.set(f"{W}{name}", "")

    def content(self) -> bytes:
        """The file; equal documents give equal bytes."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, raw in self.files.items():
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), _xml(self.roots[n], self.names[n]) if n in self.roots else raw, zipfile.ZIP_DEFLATED)
        return out.getvalue()


def _replace(parent: ET.Element, run: ET.Element, pieces: list[str]) -> None:
    """A run for each piece, in the old run's format; what the old one holds beside text stays in one of its own."""
    at, new = list(parent).index(run), []
    form = run.find(f"{W}rPr")
    others = [c for c in run if c.tag not in (f"{W}t", f"{W}rPr", *CHARACTERS)]
    for piece in [None] * bool(others) + pieces:
        r = ET.Element(f"{W}r", run.attrib)
        if form is not None:
            r.append(copy.deepcopy(form))
        if piece is None:
            r.extend(others)
        for part in re.split(r"([\t\n])", piece or ""):
            if part in ("\t", "\n"):
                ET.SubElement(r, f"{W}tab" if part == "\t" else f"{W}br")
            elif part:
                t = ET.SubElement(r, f"{W}t", {SPACE: "preserve"})
                t.text = part
        new.append(r)
    parent[at : at + 1] = new


def _blanked(raw: bytes, names: tuple[str, ...]) -> bytes:
    """Elements of these names without their content; all else byte for byte."""
    pattern = rf"<((?:\w+:)?(?:{'|'.join(names)}))(\s[^>]*)?>(?!</).*?</\1>"
    return re.sub(pattern, r"<\1\2></\1>", raw.decode("utf-8"), flags=re.DOTALL).encode()


def _xml(root: ET.Element, names: list[tuple[str, str]]) -> bytes:
    """The tree with its own prefixes; those that only attribute values use are declared, too."""
    for prefix, uri in names:
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    out = ET.tostring(root, encoding="unicode")
    head = out[: out.index(">")]
    missing = "".join(f' xmlns:{p}="{u}"' for p, u in dict(names).items() if p and f"xmlns:{p}=" not in head)
    cut = re.match(r"<[^\s/>]+", out).end()
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + out[:cut] + missing + out[cut:]).encode()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, parts (map), units (array), error (null if the file was read) of the files of a folder; other endings than .docx are an error."""
    return parsed(spark.read.format("binaryFile").load(path).select("path", "content"))


_OPENING = (zipfile.BadZipFile, ET.ParseError, KeyError, AttributeError, UnicodeDecodeError, EOFError)


def parsed(files: DataFrame) -> DataFrame:
    """read_docx() of path, content."""
    schema = "path string, parts map<string,string>, units array<struct<unit_seq:int,location:string,text:string>>, error string"

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = rows = None
                if not p.lower().endswith(".docx"):
                    error = f"unsupported file type: {p}"
                else:
                    try:
                        parts, error = extract(content), None
                        rows = [{"unit_seq": s, "location": w, "text": t} for s, w, t in Document(content).texts()]
                    except _OPENING as e:
                        parts, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([None if parts is None else list(parts.items())], pa.map_(pa.string(), pa.string())), pa.array([rows], pa.list_(pa.struct([("unit_seq", pa.int32()), ("location", pa.string()), ("text", pa.string())]))), pa.array([error], pa.string())], ["path", "parts", "units", "error"])

    return files.select("path", "content").mapInArrow(run, schema)


def units_of(read: DataFrame, known: str | None = None) -> DataFrame:
    """doc_id (path), unit_seq, location, text, and known if it is given, of files that were read."""
    cols = ["path", F.explode("units").alias("u")] + ([known] if known else [])
    return read.select(*cols).select(F.col("path").alias("doc_id"), "u.unit_seq", "u.location", "u.text", *([known] if known else []))


def write_docx(files: DataFrame, labelled: DataFrame) -> DataFrame:
    """path, content (with labels, without tracked changes and without names in its properties), error of each of files (path, content); labelled: operators.redact.label() of their units."""
    marks = labelled.groupBy("doc_id").agg(F.collect_list(F.struct("unit_seq", "start", "end", "label")).alias("marks"))
    d = files.select("path", "content").join(marks, F.col("path") == F.col("doc_id"), "left").select("path", "content", "marks")

    def run(batches):
        for b in batches:
            for p, content, found in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    doc = Document(content)
                    by: dict[int, list] = {}
                    for m in found or ():
                        by.setdefault(m["unit_seq"], []).append((m["start"], m["end"], m["label"]))
                    for unit, some in by.items():
                        doc.label(unit, some)
                    doc.scrub()
                    out, error = doc.content(), None
                except _OPENING as e:
                    out, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([out], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    return d.mapInArrow(run, "path string, content binary, error string")


def build(paragraphs: list[tuple[str, list[str]]], properties: dict[str, str] | None = None) -> bytes:
    """A small file: runs of each paragraph, by location (body, table_cell, header, footer, footnote, comment, ins, del)."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def p(runs: list[str], wrap: str = "", tag: str = "t") -> str:
        inner = "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:{tag} xml:space="preserve">{esc(r)}</w:{tag}></w:r>' for r in runs)
        return f"<w:p>{f'<w:{wrap} w:id="1">{inner}</w:{wrap}>' if wrap else inner}</w:p>"

    of = lambda where: [runs for w, runs in paragraphs if w == where]
    body = "".join(p(runs, w if w in ("ins", "del") else "", "delText" if w == "del" else "t") for w, runs in paragraphs if w in ("body", "ins", "del"))
    if of("table_cell"):
        body += "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(r)}</w:tc>" for r in of("table_cell")) + "</w:tr></w:tbl>"
    space = f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"'
    section = "".join(f'<w:{k}Reference r:id="{k}"/>' for k in ("header", "footer") if of(k))
    files = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {space}><w:body>{body}<w:sectPr>{section}</w:sectPr></w:body></w:document>"}
    files["word/_rels/document.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{k}1.xml"/>' for k in ("header", "footer")) + "</Relationships>"
    for kind, tag in (("header", "hdr"), ("footer", "ftr")):
        if of(kind):
            files[f"word/{kind}1.xml"] = f"<w:{tag} {space}>{''.join(map(p, of(kind)))}</w:{tag}>"
    who = f' w:author="{esc((properties or {}).get("creator", ""))}" w:initials="X"'
    for kind in ("footnote", "endnote", "comment"):
        if of(kind):
            files[f"word/{kind}s.xml"] = f"<w:{kind}s {space}>" + "".join(f'<w:{kind} w:id="{i}"{who if kind == "comment" else ""}>{p(r)}</w:{kind}>' for i, r in enumerate(of(kind))) + f"</w:{kind}s>"
    core = "".join(f"<dc:{k}>{esc(v)}</dc:{k}>" for k, v in (properties or {}).items() if k in CORE)
    files["docProps/core.xml"] = f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d">{core}</cp:coreProperties>'
    files["docProps/app.xml"] = "<Properties>" + "".join(f"<{k}>{esc(v)}</{k}>" for k, v in (properties or {}).items() if k in APP) + "<Pages>1</Pages></Properties>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in files.items():
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), x, zipfile.ZIP_DEFLATED)
    return out.getvalue()

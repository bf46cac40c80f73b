"""Word files made from the given `documents`: the source of the file queries and of their tests.

Every document becomes a readable file: its lines in paragraphs of two runs,
the first one with a style, a number, drawings, a bookmark and a note, the last
one with a field, then a table of one cell and a section; styles, notes,
numbering, theme, header and footer stand beside. Measures, sizes and texts of
all parts come from the document's lines. Of some documents a damaged file
comes besides, under the id -1 - doc_id.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from functools import cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.docx import OLE, A, W

NS = f'xmlns:w="{W[1:-1]}" xmlns:a="{A[1:-1]}"'
STYLES = """<w:styles NS><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi" w:eastAsiaTheme="minorEastAsia"/><w:sz w:val="21"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="120"/></w:pPr></w:pPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="400" w:lineRule="exact"/><w:ind w:firstLine="420"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="0"/><w:jc w:val="center"/><w:ind w:firstLineChars="0"/></w:pPr><w:rPr><w:b/><w:sz w:val="H1SIZE"/></w:rPr></w:style></w:styles>"""
THEME = '<a:theme NS><a:themeElements><a:fontScheme><a:majorFont><a:latin typeface="Cambria"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:latin typeface="LATIN"/><a:ea typeface=""/><a:font script="Hans" typeface="宋体"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
NOTES = '<w:footnotes NS><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote><w:footnote w:id="3"><w:p/></w:footnote></w:footnotes>'
NUMBERING = '<w:numbering NS><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="odd"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="START"/></w:lvlOverride></w:num></w:numbering>'
HEADER = '<w:hdr NS><w:p><w:pPr><w:pBdr><w:bottom w:val="single"BORDER/></w:pBdr></w:pPr>HEAD<w:r><w:t>论文</w:t></w:r></w:p></w:hdr>'
FOOTER = '<w:ftr NS><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:ftr>'
SECTION = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="TOP" w:bottom="1440" w:left="85.05pt" w:right="2.5cm"/><w:pgNumType w:fmt="decimal" w:start="1"/></w:sectPr>'
#: Facts of each file, besides one paragraph and two runs a line.
FACTS = {"paragraph": 1, "run": 1, "field": 1, "bookmark": 1, "note_ref": 1, "section": 1, "theme": 1, "default": 1, "style": 2, "note_def": 2, "num_level": 1, "num_instance": 1, "num_override": 1, "hf_token": 3}  # and one for a text in the header
#: doc_id % 7 → code of the damaged file beside.
BROKEN = {1: "LEGACY_DOC", 2: "NOT_ZIP", 3: "NOT_DOCX", 4: "ENCRYPTED", 5: "CORRUPT"}


#: Characters that no XML text holds, and those that are left out with them.
_LEFT_OUT = re.compile("[\x00-\x1f\ufffe\uffff]")
_UNSAFE = re.compile("[\x00-\x1f\ufffe\uffff&<>]")
#: Most bytes of files that wait for their batch.
HELD = 1 << 22


def _run(text: str, more: str = "", props: str = "") -> str:
    return f'<w:r>{props}<w:t xml:space="preserve">{_escaped(text)}</w:t>{more}</w:r>'


def _escaped(text: str) -> str:
    return escape(_LEFT_OUT.sub("", text)) if _UNSAFE.search(text) else text


def _zip(parts: dict[str, str], before: tuple[bytes, bytes, int] = (b"", b"", 0)) -> tuple[bytes, bytes, int]:
    """Entries of a container, their list and number; before: those in front, so that parts of many files are packed once."""
    entries, listed, n = before
    for name, xml in parts.items():
        said, data = name.encode(), xml.replace("NS>", f"{NS}>", 1).encode()
        packed = zlib.compress(data, 1, -15)
        # Without the time of day: equal texts are equal files.
        head = struct.pack("<5H3I2H", 20, 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(data), len(packed), len(data), len(said), 0)
        listed += b"".join((b"PK\1\2", struct.pack("<H", 20), head, struct.pack("<3H2I", 0, 0, 0, 0, len(entries)), said))
        entries, n = b"".join((entries, b"PK\3\4", head, said, packed)), n + 1
    return entries, listed, n


def _closed(entries: bytes, listed: bytes, n: int) -> bytes:
    return b"".join((entries, listed, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, len(listed), len(entries), 0)))


@cache
def _of_length(n: int) -> tuple[str, str]:
    """Properties of a paragraph and of its last run, n: the line's length modulo 2100."""
    own = f'<w:pPr><w:ind w:left="{20 * (n % 50)}" w:hangingChars="{n % 3 * 50}"/><w:spacing w:before="{n % 7}pt" w:line="{240 + n % 5 * 60}"/></w:pPr>'
    return own, f'<w:rPr><w:rFonts w:hAnsiTheme="minorHAnsi"/><w:b w:val="{n % 2}"/><w:sz w:val="{20 + n % 4}"/></w:rPr>'


def _border(n: int) -> str:
    """Attributes of the header's border: sizes that are no number and colours and spaces that are not given among them."""
    size = "thick" if n % 4 == 3 else "" if n % 4 == 2 else str(4 + n % 6)
    return f' w:sz="{size}"' + (f' w:color="{n % 10}0FF00"' if n % 2 else "") + (f' w:space="{n % 3}.5"' if n % 3 else "")


@cache
def _beside(n: int) -> tuple[bytes, bytes, int]:
    """The parts that the number of lines alone decides, n: that number modulo 90."""
    beside = {
        "styles": STYLES.replace("H1SIZE", str(28 + n % 5)),
        "footnotes": NOTES,
        "numbering": NUMBERING.replace("START", str(1 + n % 9)),
        "footer1": FOOTER,
        "theme/theme1": THEME.replace("LATIN", "Arial" if n % 2 else "Calibri"),
    }
    return _zip({f"word/{name}.xml": x for name, x in beside.items()})


def word_file(text: str | None) -> bytes:
    text = text or ""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        own, props = _of_length(len(line) % 2100)
        more = tail = ""
        if i == 0:
            own = '<w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:bookmarkStart w:id="1" w:name="_Ref1"/>'
            more = f"<w:footnoteReference w:id=\"2\"/>{'<w:drawing/>' * (len(lines) % 3)}"
        if i == len(lines) - 1:
            tail = '<w:fldSimple w:instr="REF _Ref1"/>'
        out.append(f"<w:p>{own}{_run(line[:8])}{_run(line[8:], more, props)}{tail}</w:p>")
    body = "".join(out) + f"<w:tbl><w:tr><w:tc><w:p>{_run('cell')}</w:p></w:tc></w:tr></w:tbl>{SECTION.replace('TOP', str(1000 + len(text) % 500))}"
    n = len(lines)
    header = HEADER.replace("BORDER", _border(n)).replace("HEAD", _run(lines[0][:8], "<w:tab/>"))
    return _closed(*_zip({"word/document.xml": f"<w:document NS><w:body>{body}</w:body></w:document>", "word/header1.xml": header}, _beside(n % 90)))


@cache
def broken_file(code: str) -> bytes:
    if code == "NOT_ZIP":
        return b"no zip"
    name = {"NOT_DOCX": "word/other.xml", "ENCRYPTED": "EncryptedPackage"}.get(code, "word/document.xml")
    raw = _closed(*_zip({name: "<w:document" if code == "CORRUPT" else "<w:document NS><w:body/></w:document>"}))
    return OLE + raw if code == "LEGACY_DOC" else raw


def _made(batches):
    """Batches of (doc_id, text) → batches of (id, content)."""
    ids, out, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "content"])
    for b in batches:
        # One text at a time: a batch may hold thousands of them.
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(key)
            out.append(word_file(text.as_py()))
            size += len(out[-1])
            if (code := BROKEN.get(key % 7)) is not None:
                ids.append(-1 - key)
                out.append(broken_file(code))
            if len(ids) >= 500 or size >= HELD:
                yield batch()
                ids, out, size = [], [], 0
    if ids:
        yield batch()


def word_files(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → (id, content)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_made, "id long, content binary")


class MadeFiles:
    """word_files() for one reader: the files are made and read in one Python worker, batch by batch, so that no file goes through Spark's rows and each task has one worker, not two."""

    def __init__(self, docs: DataFrame):
        self._docs = docs.select(F.col("doc_id").cast("long"), "text")

    def select(self, *_) -> MadeFiles:
        """(id, content) are all columns."""
        return self

    def mapInArrow(self, run, schema: str) -> DataFrame:  # noqa: N802
        return self._docs.mapInArrow(lambda batches: run(_made(batches)), schema)


#: Folders that files are dealt to, so that none holds millions and tasks can go through them side by side.
FOLDERS = 512


def write_files(files: DataFrame, path: str) -> str:
    """files(id, content) as `<id>.docx` in FOLDERS folders below path, through the file system that Spark's workers see: a local or mounted folder."""
    from urllib.parse import unquote, urlparse

    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{path} is no folder that tasks can write files to")
    folder = unquote(at.path)

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = f"{folder}/{key % FOLDERS}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/{key}.docx.{os.getpid()}", "wb") as f:
                    f.write(raw.as_py())
                os.replace(f.name, f"{at}/{key}.docx")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    files.select("id", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return path

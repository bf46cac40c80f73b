"""Word files as fact rows: one narrow pass over binary files, everything after it is joins and windows.

Reading a container needs the zip and XML readers of the standard library;
this and going through local folders are the library's only Python functions on the executors. Each file is
read alone, and files that can't be read leave one row with a code. A part
that unpacks to more than MAX_PART bytes counts as damaged.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from functools import cache, lru_cache
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the file format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
OLE, ZIPS = bytes.fromhex("d0cf11e0a1b11ae1"), (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
NUMBER_FORMATS = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "chineseCounting", "chineseCountingThousand", "ideographDigital", "ideographTraditional", "bullet", "none")
MAX_PART = 256_000_000
SCHEMA = "id long, code string, fact string, seq int, payload string"
_RUN = "eastAsia string, ascii string, hAnsi string, sz string, b string, i string"
_PARA = "jc string, outline string, line string, line_rule string, before string, after string, first string, first_chars string, hanging string, hanging_chars string, left string, left_chars string"
#: fact → schema of its payload. Measures stay as written.
SCHEMAS = {
    "paragraph": f"text string, in_table boolean, style_id string, num_id string, ilvl string, para struct<{_PARA.replace(' string', ':string')}>, mark struct<{_RUN.replace(' string', ':string')}>, drawings int, maths int, objects int",
    "run": f"run int, text string, {_RUN}",
    "field": "field int, instruction string, display string, start int, end int",
    "bookmark": "id string, name string",
    "note_ref": "type string, id string, run int",
    "note_def": "type string, id string, content string",
    "section": "width string, height string, top string, bottom string, left string, right string, header string, footer string, gutter string, format string, start string",
    "default": f"{_RUN}, para struct<{_PARA.replace(' string', ':string')}>",
    "style": f"style_id string, type string, name string, based_on string, is_default boolean, {_RUN}, para struct<{_PARA.replace(' string', ':string')}>",
    "num_level": "abstract string, ilvl string, start string, fmt string, text string",
    "num_instance": "num string, abstract string",
    "num_override": "num string, ilvl string, start string",
    "theme": "major_latin string, major_east_asia string, minor_latin string, minor_east_asia string",
    "hf_token": f"kind string, part int, para int, tok int, tok_kind string, text string, instruction string, jc string, border string, bottom struct<style:string,size:string,color:string,space:string>, style_id string, run struct<{_RUN.replace(' string', ':string')}>, mark struct<{_RUN.replace(' string', ':string')}>",
}


class Unreadable(Exception):
    pass


#: Most bytes of files that wait for their batch.
HELD = 1 << 22


def _local(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder on a local or mounted file system, null for any other place."""
    at = urlparse(folder)
    scheme = at.scheme or urlparse(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    path = os.path.abspath(unquote(at.path) if at.scheme else folder)
    return path if scheme == "file" and os.path.isdir(path) else None


def _entries(folder: str):
    """(path, whether it is a folder) of what Spark's readers see in a folder."""
    with os.scandir(folder) as found:
        for e in found:
            # As in Spark, hidden files and folders and those that are being copied don't count.
            if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"):
                continue
            if e.is_dir() or e.name[-5:].lower() == ".docx":
                yield e.path, e.is_dir()


def _listed(folders, deep: bool):
    """Batches of (path, folder): the entries of those folders, or all files below them."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_()))], names=["path", "folder"])
    out, open_ = [], list(folders)
    while open_:
        for path, is_folder in _entries(open_.pop()):
            if deep and is_folder:
                open_.append(path)
            else:
                out.append((path, is_folder))
            if len(out) >= 1000:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def _below(batches):
    """Batches of (path, folder) → batches of files alone, those below the folders."""
    for b in batches:
        yield b.filter(pc.invert(b.column(1)))
        yield from _listed([x.as_py() for x, is_folder in zip(b.column(0), b.column(1), strict=True) if is_folder.as_py()], True)


def _read(batches):
    """Batches of (path, …) → batches of (path, length, content)."""
    paths, raw, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([f"file:{p}" for p in paths], pa.string()), pa.array([len(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["path", "length", "content"])
    for b in batches:
        for path in b.column(0).to_pylist():
            with open(path, "rb") as f:
                raw.append(f.read())
            paths.append(path)
            size += len(raw[-1])
            if len(raw) >= 500 or size >= HELD:
                yield batch()
                paths, raw, size = [], [], 0
    if raw:
        yield batch()


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the .docx files below a folder.

    Of a local or mounted folder the tasks list and read the files, so that
    the driver holds none of their names, however many there are. Other stores
    are Spark's own reader's, which lists them in the driver and leaves out
    empty files.
    """
    path = _local(spark, folder)
    if path is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = "path string, folder boolean"
    top = spark.range(0, 1, 1, 1).mapInArrow(lambda batches: (x for b in batches if b.num_rows for x in _listed([path], False)), names)
    # The folders of the first level are gone through side by side, then the files are dealt out anew.
    every = top.repartition(n).mapInArrow(_below, names).repartition(n)
    return every.mapInArrow(_read, "path string, length long, content binary")


#: Parts of at most so many bytes are kept: styles, themes and the like are the same in many files of a corpus.
SMALL = 1 << 14


class Parts(dict):
    """XML parts by name; small: names of those that are kept, so that what is made of them may be kept too."""

    small: frozenset[str] = frozenset()


#: The last small parts that could be read, by the bytes of their entries and what the container's list says of them: those are not unpacked and read again.
_KEPT: dict[tuple, ET.Element] = {}


def _small(z: zipfile.ZipFile, raw: bytes, info: zipfile.ZipInfo, end: int) -> ET.Element:
    """The part of that entry, whose bytes end before the next entry."""
    key = (raw[info.header_offset : end], info.orig_filename, info.flag_bits, info.compress_type, info.compress_size, info.file_size, info.CRC)
    if (part := _KEPT.get(key)) is None:
        part = ET.fromstring(z.read(info))
        if len(_KEPT) >= 256:
            _KEPT.clear()
        _KEPT[key] = part
    return part


def _checked(raw: bytes, child: str = "") -> bool:
    """Whether the root has that child; ET.ParseError where ET.fromstring raises it. Nothing is built."""
    if b"<!DOCTYPE" in raw or b"\0" in raw[:4] or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):  # entities and wide characters are for the whole parser
        return (root := ET.fromstring(raw)).find(child or "*") is not None
    parser, level, found = expat.ParserCreate(None, "}"), 0, []

    def start(name, _):
        nonlocal level
        level += 1
        if level == 2 and name == child[1:]:
            found.append(True)
            parser.StartElementHandler = parser.EndElementHandler = None

    def end(_):
        nonlocal level
        level -= 1

    if child:
        parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise ET.ParseError(str(e)) from None
    return bool(found)


#: Facts → what parts they come from, besides the theme, which names fonts.
_READS = (({"paragraph", "run", "field", "bookmark", "note_ref", "section"}, r"document"), ({"default", "style"}, r"styles"), ({"note_def"}, r"(foot|end)notes"), ({"num_level", "num_instance", "num_override"}, r"numbering"), ({"hf_token"}, r"(header|footer)\d+"), ({"theme", "paragraph", "run", "default", "style", "hf_token"}, r"theme/theme1"))


@cache
def _asked(facts: frozenset[str]) -> re.Pattern:
    return re.compile("|".join(f"({pattern})" for of, pattern in _READS if facts & of) or r"(?!)")


def open_parts(raw: bytes, only: set[str] | None = None) -> Parts:
    """XML parts by name, those that the facts asked for come from; all others are checked. Unreadable with one of the five codes."""
    if raw[:8] == OLE:
        raise Unreadable("LEGACY_DOC")
    asked = None if only is None else _asked(frozenset(only))
    parts, small = Parts(), []
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.NameToInfo
            if "EncryptedPackage" in names or "EncryptionInfo" in names:
                raise Unreadable("ENCRYPTED")
            if "word/document.xml" not in names:
                raise Unreadable("NOT_DOCX")
            # In the order of the container, which is that of headers and footers.
            want = [n for n in dict.fromkeys(z.namelist()) if n.startswith("word/") and n.endswith(".xml") and n.count("/") == 1 or n == "word/theme/theme1.xml"]
            if any(z.getinfo(n).file_size > MAX_PART for n in want):
                raise Unreadable("CORRUPT")
            starts = sorted({x.header_offset for x in z.infolist()} | {z.start_dir})
            ends = dict(zip(starts, starts[1:]))
            for n in want:
                name, info = n[5:-4], names[n]
                end = ends.get(info.header_offset, 0)
                if name != "document" and info.file_size <= SMALL and 0 < end - info.header_offset <= 2 * SMALL:
                    parts[name] = _small(z, raw, info, end)
                    small.append(name)
                    continue
                xml = z.read(info)
                if asked is None or asked.fullmatch(name):
                    parts[name] = ET.fromstring(xml)
                elif not _checked(xml, f"{W}body" if name == "document" else "") and name == "document":
                    parts[name] = None
    except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, OSError, RuntimeError):
        raise Unreadable("CORRUPT" if raw[:4] in ZIPS else "NOT_ZIP") from None
    except ET.ParseError:
        raise Unreadable("CORRUPT") from None
    if "document" in parts and (parts["document"] is None or parts["document"].find(f"{W}body") is None):
        raise Unreadable("NOT_DOCX")
    parts.small = frozenset(small)
    return parts


@cache
def _path(path: str) -> str:
    return "/".join(W + p for p in path.split("/"))


def _val(e, path: str, attr: str = "val"):
    if e is None or "/" in path and e.find(_path(path.split("/", 1)[0])) is None:
        return None
    x = e.find(_path(path))
    return None if x is None else x.get(W + attr, "1" if attr == "val" else None)


def theme_of(root) -> dict:
    """Latin and East Asian face of the theme's two groups; an empty East Asian face is that of the Hans script."""
    out = {}
    for group in ("major", "minor"):
        fonts = root.find(f"{A}themeElements/{A}fontScheme/{A}{group}Font") if root is not None else None
        face = lambda tag: None if fonts is None or fonts.find(A + tag) is None else fonts.find(A + tag).get("typeface") or None  # noqa: E731, B023
        hans = None if fonts is None else next((x.get("typeface") for x in fonts.findall(f"{A}font") if x.get("script") == "Hans"), None)
        out |= {f"{group}_latin": face("latin"), f"{group}_east_asia": face("ea") or hans}
    return out


#: Names with their name space, written once.
_FONTS = {name: (W + name, f"{W}{name}Theme") for name in ("eastAsia", "ascii", "hAnsi")}
_RFONTS, _SPACING, _IND, _VAL, _NO_RUN = f"{W}rFonts", f"{W}spacing", f"{W}ind", f"{W}val", {"eastAsia": None, "ascii": None, "hAnsi": None, "sz": None, "b": None, "i": None}
_SWITCHES = {f"{W}sz": "sz", f"{W}b": "b", f"{W}i": "i"}
_OF_PARA = {f"{W}jc": "jc", f"{W}outlineLvl": "outline"}
_MEASURES = {
    _SPACING: [("line", f"{W}line", None), ("line_rule", f"{W}lineRule", None), ("before", f"{W}before", None), ("after", f"{W}after", None)],
    _IND: [("first", f"{W}firstLine", None), ("first_chars", f"{W}firstLineChars", None), ("hanging", f"{W}hanging", None), ("hanging_chars", f"{W}hangingChars", None), ("left", f"{W}left", f"{W}start"), ("left_chars", f"{W}leftChars", f"{W}startChars")],
}
_NO_PARA = dict.fromkeys(["jc", "outline", *[m[0] for ms in _MEASURES.values() for m in ms]])


def _props(e, theme: dict) -> dict:
    """Run properties: fonts (a theme's face only where none is named), size in half-points, switches as written. Of equal elements the first counts."""
    out = _NO_RUN.copy()
    if e is None:
        return out
    seen = set()
    for x in e:
        tag = x.tag
        if tag in seen:
            continue
        if tag == _RFONTS:
            seen.add(tag)
            for name, (named, ref) in _FONTS.items():
                face = x.get(named)
                if face is None and (said := x.get(ref)):
                    group = "major" if said.lower().startswith("major") else "minor"
                    face = theme.get(f"{group}_{'east_asia' if 'eastasia' in said.lower() else 'latin'}")
                out[name] = face or None
        elif (key := _SWITCHES.get(tag)) is not None:
            seen.add(tag)
            out[key] = x.get(_VAL, "1")
    return out


def _para(e) -> dict:
    """Paragraph properties as written. Of equal elements the first counts."""
    out = _NO_PARA.copy()
    if e is None:
        return out
    seen = set()
    for x in e:
        tag = x.tag
        if tag in seen:
            continue
        if (measures := _MEASURES.get(tag)) is not None:
            seen.add(tag)
            for key, name, older in measures:
                v = x.get(name)
                out[key] = x.get(older) if v is None and older else v
        elif (key := _OF_PARA.get(tag)) is not None:
            seen.add(tag)
            out[key] = x.get(_VAL, "1")
    return out


_R, _T, _P, _TBL, _SECT, _SIMPLE, _PPR, _RPR = (W + n for n in ("r", "t", "p", "tbl", "sectPr", "fldSimple", "pPr", "rPr"))


def _runs(p) -> list:
    """Direct runs as one block where the first stands, runs of simple fields as blocks of their own."""
    out, placed = [], False
    for child in p:
        tag = child.tag
        if tag == _R:
            if not placed:
                out += p.findall(_R)
                placed = True
        elif tag == _SIMPLE:
            out += child.findall(_R)
    return out


def _text(r) -> str:
    found = r.findall(_T)
    return found[0].text or "" if len(found) == 1 else "".join([t.text or "" for t in found])


def _fields(p, runs: list) -> list[dict]:
    """Complex fields by their marks (nested ones share the text after `separate`) and simple fields."""
    done, open_ = [], []
    for i, r in enumerate(runs):
        for e in r:
            tag = e.tag
            if tag == _T:
                for f in open_:
                    if f["shown"]:
                        f["display"] += e.text or ""
            elif tag == f"{W}fldChar":
                kind = e.get(f"{W}fldCharType")
                if kind == "begin":
                    open_.append({"instruction": "", "display": "", "shown": False, "start": i})
                elif kind == "separate" and open_:
                    open_[-1]["shown"] = True
                elif kind == "end" and open_:
                    done.append(open_.pop() | {"end": i})
            elif tag == f"{W}instrText" and open_:
                open_[-1]["instruction"] += e.text or ""
    for s in p.findall(_SIMPLE):
        own = s.findall(_R)
        at = runs.index(own[0]) if own else 0
        done.append({"instruction": s.get(f"{W}instr") or "", "display": "".join(map(_text, own)), "start": at, "end": at + max(0, len(own) - 1)})
    return sorted(done, key=lambda f: (f["start"], f["end"]))


def _border(pr) -> dict | None:
    """The bottom border of a paragraph, as written."""
    x = pr.find(f"{W}pBdr/{W}bottom") if pr is not None else None
    return None if x is None else {"style": x.get(f"{W}val"), "size": x.get(f"{W}sz"), "color": x.get(f"{W}color"), "space": x.get(f"{W}space")}


def _is_page(instruction: str) -> bool:
    return re.search(r"\bPAGE\b", instruction, re.IGNORECASE) is not None


def _hf_tokens(p, theme: dict):
    """(kind of token, text, instruction, run properties) of a header or footer paragraph: texts, tabs and page numbers."""
    field = None  # of the open field: instruction, whether it is a page number's, shown, seen, properties
    for r in p.findall(f"{W}r"):
        own, char = _props(r.find(f"{W}rPr"), theme), r.find(f"{W}fldChar")
        mark = None if char is None else char.get(f"{W}fldCharType")
        if mark == "begin":
            field = {"instruction": "", "page": False, "shown": False, "seen": False, "props": None}
        if field is not None:
            field["instruction"] += "".join(x.text or "" for x in r.findall(f"{W}instrText"))
            if mark == "separate":
                field |= {"shown": True, "page": _is_page(field["instruction"]), "props": own}
        for s in r.findall(f"{W}fldSimple"):
            said = s.get(f"{W}instr") or ""
            yield "pageNumber" if _is_page(said) else "text", "".join(t.text or "" for t in s.iter(f"{W}t")), said.strip(), own
        if text := _text(r):
            if field is not None and field["shown"] and field["page"]:
                field["seen"] = True
                yield "pageNumber", text, field["instruction"].strip(), own
            else:
                yield "text", text, "", own
        if r.find(f"{W}tab") is not None:
            yield "tab", "", "", own
        if mark == "end":
            if field is not None and field["page"] and not field["seen"]:
                yield "pageNumber", "", field["instruction"].strip(), field["props"]
            field = None


def _headers_and_footers(parts: dict, theme: dict):
    for kind in ("header", "footer"):
        names = [n for n in parts if re.fullmatch(rf"{kind}\d+", n)]
        for no, name in enumerate(names):
            for i, p in enumerate(parts[name].iter(f"{W}p")):
                pr = p.find(f"{W}pPr")
                both = {"kind": kind, "part": no, "para": i, "jc": _val(pr, "jc"), "border": _val(pr, "pBdr/bottom"), "bottom": _border(pr), "style_id": _val(pr, "pStyle"), "mark": _props(pr.find(f"{W}rPr") if pr is not None else None, theme)}
                for k, (tok_kind, text, instruction, own) in enumerate(_hf_tokens(p, theme)):
                    yield {"tok": k, "tok_kind": tok_kind, "text": text, "instruction": instruction, "run": own} | both


_COUNTED = {f"{W}drawing": "drawings", f"{M}oMath": "maths", f"{M}oMathPara": "maths", f"{W}object": "objects"}
_NOTES = {f"{W}footnoteReference": "footnote", f"{W}endnoteReference": "endnote"}
_BOOKMARK, _OF_RUNS = f"{W}bookmarkStart", {"paragraph", "run", "note_ref", "field"}


def _of_paragraph(e, pr, seq: int, in_table: bool, theme: dict, asked: set[str]):
    """The facts of one paragraph that are asked for."""
    runs = _runs(e) if asked & _OF_RUNS else []
    texts = [_text(r) for r in runs] if asked & {"paragraph", "run"} else []
    if "paragraph" in asked:
        out = {"text": "".join(texts), "in_table": in_table, "style_id": None, "num_id": None, "ilvl": None, "para": _para(pr), "mark": _props(None if pr is None else pr.find(_RPR), theme), "drawings": 0, "maths": 0, "objects": 0}
        if pr is not None:
            out |= {"style_id": _val(pr, "pStyle") or None, "num_id": _val(pr, "numPr/numId"), "ilvl": _val(pr, "numPr/ilvl")}
        for x in e.iter():
            if (name := _COUNTED.get(x.tag)) is not None:
                out[name] += 1
        yield "paragraph", seq, out
    if "run" in asked and "note_ref" not in asked:
        for i, r in enumerate(runs):
            yield "run", seq, {"run": i, "text": texts[i]} | _props(r.find(_RPR), theme)
    elif "note_ref" in asked:
        for i, r in enumerate(runs):
            if "run" in asked:
                yield "run", seq, {"run": i, "text": texts[i]} | _props(r.find(_RPR), theme)
            for tag, kind in _NOTES.items():
                for n in r.findall(tag):
                    yield "note_ref", seq, {"type": kind, "id": n.get(f"{W}id"), "run": i}
    if "field" in asked:
        for i, f in enumerate(_fields(e, runs)):
            yield "field", seq, {"field": i, "instruction": f["instruction"], "display": f["display"], "start": f["start"], "end": f["end"]}
    if "bookmark" in asked:
        for b in e.iter(_BOOKMARK):
            if b.get(f"{W}name"):
                yield "bookmark", seq, {"id": b.get(f"{W}id"), "name": b.get(f"{W}name")}


#: Facts that paragraphs hold.
OF_TEXT = {"paragraph", "run", "field", "bookmark", "note_ref"}


def _style_facts(styles, theme_root):
    theme = theme_of(theme_root)
    if any(theme.values()):
        yield "theme", 0, theme
    if styles is not None:
        d = styles.find(f"{W}docDefaults")
        part = lambda e, path: None if e is None else e.find("/".join(W + x for x in path.split("/")))
        yield "default", 0, _props(part(d, "rPrDefault/rPr"), theme) | {"para": _para(part(d, "pPrDefault/pPr"))}
        for i, s in enumerate(styles.findall(f"{W}style")):
            if s.get(f"{W}styleId"):
                yield "style", i, {"style_id": s.get(f"{W}styleId"), "type": s.get(f"{W}type"), "name": _val(s, "name"), "based_on": _val(s, "basedOn"), "is_default": s.get(f"{W}default") == "1"} | _props(s.find(_RPR), theme) | {"para": _para(s.find(_PPR))}


def _note_facts(*roots):
    for kind, notes in zip(("footnote", "endnote"), roots, strict=True):
        for i, n in enumerate(notes.findall(f"{W}{kind}") if notes is not None else []):
            if not n.get(f"{W}type"):
                lines = ["".join(t.text or "" for t in p.iter(_T)).strip() for p in n.findall(_P)]
                yield "note_def", i, {"type": kind, "id": n.get(f"{W}id"), "content": "\n".join(x for x in lines if x)}


def _number_facts(numbering):
    for i, a in enumerate(numbering.findall(f"{W}abstractNum")):
        for lv in a.findall(f"{W}lvl"):
            if lv.get(f"{W}ilvl") is not None:
                fmt = _val(lv, "numFmt")
                yield "num_level", i, {"abstract": a.get(f"{W}abstractNumId"), "ilvl": lv.get(f"{W}ilvl"), "start": _val(lv, "start") or "1", "fmt": fmt if fmt in NUMBER_FORMATS else "decimal", "text": "%1" if (said := _val(lv, "lvlText")) is None else said}
    for i, n in enumerate(numbering.findall(f"{W}num")):
        if n.get(f"{W}numId") and _val(n, "abstractNumId"):
            yield "num_instance", i, {"num": n.get(f"{W}numId"), "abstract": _val(n, "abstractNumId")}
            for o in n.findall(f"{W}lvlOverride"):
                if o.get(f"{W}ilvl") is not None and _val(o, "startOverride"):
                    yield "num_override", i, {"num": n.get(f"{W}numId"), "ilvl": o.get(f"{W}ilvl"), "start": _val(o, "startOverride")}


def _all_facts(of, *roots):
    return of(*roots)


@lru_cache(64)
def _kept_facts(of, *roots) -> tuple:
    """Facts of small parts; they are not to be changed."""
    return tuple(of(*roots))


#: What the theme's fonts are asked for.
_THEMED = {"paragraph", "run", "hf_token"}


def facts_of(parts: dict[str, ET.Element], only: set[str] | None = None):
    """(fact, seq, payload) of one document, in document order; only: those that are asked for."""
    asked = set(SCHEMAS) if only is None else only
    theme = theme_of(parts.get("theme/theme1")) if asked & _THEMED else {}
    seq, stack = 0, []
    if asked & (OF_TEXT | {"section"}):
        stack = [(x, False) for x in reversed(parts["document"].find(f"{W}body"))]
    sections, texts = [], asked & OF_TEXT
    while stack:
        e, in_table = stack.pop()
        tag = e.tag
        if tag == _TBL:
            cells = [x for row in e.findall(f"{W}tr") for cell in row.findall(f"{W}tc") for x in cell]
            stack += [(x, True) for x in reversed(cells)]
        elif tag == _SECT:
            sections.append(e)
        elif tag == _P:
            pr = e.find(_PPR)
            if texts:
                yield from _of_paragraph(e, pr, seq, in_table, theme, asked)
            if not in_table and pr is not None and (own := pr.find(_SECT)) is not None:
                sections.append(own)
            seq += 1
    for i, s in enumerate(sections if "section" in asked else []):
        yield "section", i, {"width": _val(s, "pgSz", "w"), "height": _val(s, "pgSz", "h"), **{k: _val(s, "pgMar", k) for k in ("top", "bottom", "left", "right", "header", "footer", "gutter")}, "format": _val(s, "pgNumType", "fmt"), "start": _val(s, "pgNumType", "start")}
    for names, of in ((("styles", "theme/theme1"), _style_facts), (("footnotes", "endnotes"), _note_facts), (("numbering",), _number_facts)):
        roots = [parts.get(n) for n in names]
        if any(r is not None for r in roots):
            # Of parts that many files share, the facts are found once, too.
            small = all(n in parts.small for n, r in zip(names, roots, strict=True) if r is not None)
            for fact, i, payload in (_kept_facts if small else _all_facts)(of, *roots):
                if fact in asked:
                    yield fact, i, payload
    for i, token in enumerate(_headers_and_footers(parts, theme) if "hf_token" in asked else []):
        yield "hf_token", i, token


def extract_facts(files: DataFrame, only: set[str] | None = None, held: int = 1 << 22, payloads: bool = True) -> DataFrame:
    """files(id, content) → id, code (`ok` or the reason), fact, seq, payload (JSON).

    only: facts that are asked for; every part is read all the same, and an
    unreadable file has its row. Rows go on as soon as their payloads hold
    `held` characters, whatever the number of files and their sizes. payloads:
    False leaves them null, for counts and places of facts; Spark can't tell a
    Python function which of its columns are read.
    """
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches):
        encode = json.JSONEncoder(ensure_ascii=False).encode
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "code", "fact", "seq", "payload"])
        size = 0
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    for f, s, p in facts_of(open_parts(raw.as_py() or b"", only), only):
                        said = encode(p) if payloads else None
                        out.append((key, "ok", f, s, said))
                        size += len(said) if payloads else 0
                        if size >= held or len(out) >= 20_000:
                            yield batch()
                            out, size = [], 0
                except Unreadable as e:
                    out.append((key, str(e), "file", 0, None))
        if out:
            yield batch()

    return files.select("id", "content").mapInArrow(run, SCHEMA)


#: Facts that stand within their paragraph, and the names of their arrays there.
WITHIN = {"run": "runs", "field": "fields", "bookmark": "bookmarks", "note_ref": "note_refs"}


def document_schema() -> str:
    """One row a file: an array of typed structs a fact; paragraphs hold what stands in them."""
    nested = lambda fields: re.sub(r"(\w+) (?=\w)", r"\1:", fields).replace(", ", ",")
    inner = ",".join(f"{name}:array<struct<{nested(SCHEMAS[fact])}>>" for fact, name in WITHIN.items())
    own = {fact: nested(s) + ("," + inner if fact == "paragraph" else "") for fact, s in SCHEMAS.items() if fact not in WITHIN}
    return "id long, code string, " + ", ".join(f"{fact} array<struct<seq:int,{fields}>>" for fact, fields in own.items())


def _arrow(kind) -> pa.DataType:
    """The Arrow type of a Spark type of document_schema()."""
    name = kind.typeName()
    if name == "array":
        return pa.list_(_arrow(kind.elementType))
    if name == "struct":
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}[name]


def extract_documents(files: DataFrame, only: set[str] | None = None, held: int = 1 << 13) -> DataFrame:
    """files(id, content) → one row a file, document_schema(). Store it: Parquet then reads for each table only that table's columns.

    only: facts that are asked for; the arrays of others are empty. Rows go on
    as soon as they hold `held` facts together. An unreadable file has a code
    and nulls.
    """
    schema = document_schema()
    from pyspark.sql.types import StructType

    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    row = {"id": key, "code": "ok"} | {f: [] for f in SCHEMAS if f not in WITHIN}
                    for fact, seq, payload in facts_of(open_parts(raw.as_py() or b"", only), only):
                        size += 1
                        if fact in WITHIN:
                            row["paragraph"][-1][WITHIN[fact]].append(payload)
                        else:
                            row[fact].append(payload | {"seq": seq} | ({n: [] for n in WITHIN.values()} if fact == "paragraph" else {}))
                    rows.append(row)
                except Unreadable as e:
                    rows.append({"id": key, "code": str(e)})
                if size >= held or len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("id", "content").mapInArrow(run, schema)


def file_codes(files: DataFrame) -> DataFrame:
    """files(id, content) → (id, code): `ok` or the reason why a file can't be read."""

    def run(batches):
        for b in batches:
            codes = []
            for raw in b.column(1):
                try:
                    open_parts(raw.as_py() or b"", set())
                    codes.append("ok")
                except Unreadable as e:
                    codes.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.string())], names=["id", "code"])

    return files.select(F.col("id").cast("long"), "content").mapInArrow(run, "id long, code string")


def triage_files(facts: DataFrame) -> DataFrame:
    """(id, code): one row a file, from its facts or its code."""
    return facts.groupBy("id").agg(F.max("code").alias("code"))


def fact_table(facts: DataFrame, fact: str, schema: str | None = None) -> DataFrame:
    """Rows of one fact as typed columns: id, seq and those of SCHEMAS (or of a part of them)."""
    return facts.where(F.col("fact") == fact).select(F.col("id").alias("_id"), F.col("seq").alias("_seq"), F.from_json("payload", schema or SCHEMAS[fact]).alias("p")).select("_id", "_seq", "p.*").withColumnsRenamed({"id": "note_id" if fact.startswith("note") else "mark_id", "_id": "id", "_seq": "seq"})

"""The library's own operators: hand-built cases, random state-machine simulations and the comparison SQL."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest

PARA = "doc_id long, para_index int, text string, in_table boolean, style_id string, style_name string, outline_level int, alignment string, num_id string, ilvl int, drawing_count int, math_count int, object_count int"


def para(doc, i, text, **over):
    base = {"in_table": False, "style_id": None, "style_name": None, "outline_level": None, "alignment": None, "num_id": None, "ilvl": None, "drawing_count": 0, "math_count": 0, "object_count": 0} | over
    return (doc, i, text, *[base[k] for k in ("in_table", "style_id", "style_name", "outline_level", "alignment", "num_id", "ilvl", "drawing_count", "math_count", "object_count")])


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T
    from quire.functions import units as U

    cases = [
        ("第一章 绪论", 1), ("第十一章", None), ("第 3 章", 3), ("1.2 方法", 2), ("1.2.3", 2), ("1.1", 1), ("2、目的", 2), ("3 结论", 3), ("(4) x", 4), ("（5）y", 5), ("no", None), ("12", None), ("　 7. z", 7),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.extract_number(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, n in cases]
    one = spark.range(1).select(
        T.compact_text(F.lit("a　b c﻿ d")).alias("a"), T.inline_text(F.lit("  a \n b　")).alias("b"), T.keyword_items(F.lit("关键词：甲；乙、丙。"), T.KEYWORD_PREFIX["cn"]).alias("c"),
        T.keyword_items(F.lit("Key words: a; b,c "), T.KEYWORD_PREFIX["en"]).alias("d"), U.js_round(F.lit(1.005), 2).alias("e"), U.js_round(F.lit(-2.5), 0).alias("f"), U.measure_to_twips(F.lit("2.54cm")).alias("g"),
        U.measure_to_twips(F.lit("12 pt")).alias("h"), T.slugify(F.lit(" My 规则 v2! ")).alias("i"), T.bump_version(F.lit("1.9")).alias("j"), T.bump_version(F.lit("x")).alias("k"), T.caption_number_field(F.lit("（1－2）")).alias("l"),
        T.locate_fragment(F.lit("a b.c a b.c"), F.lit("ab.c")).alias("m"), T.percent_text(F.lit(1 / 3)).alias("n"), T.utf16_length(F.lit("a\U0001F600")).alias("o"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g, one.h) == ("abcd", "a b", 3, 3, 1.0, -2.0, 1440.0, None)
    assert (one.i, one.j, one.k, one.l, one.n, one.o) == ("my-规则-v2", "1.10", "x-1", [1, 2], "33.33%", 3)
    assert [(x.start, x.end) for x in one.m] == [(0, 5), (6, 11)]


TEXTS = ["某某大学", "摘 要", "Abstract", "目录", "绪论 1", "参考文献", "致谢", "附录A", "正文一段", "关键词：甲；乙", "图1-1 名称", "表2 名称", "a=b (1-1)", "附件一：x", "姓名：张三", "", "2020年1月2日", "资料来源：某"]
HEADS = {"摘要": "cn_abstract", "abstract": "en_abstract", "目录": "toc", "参考文献": "references", "致谢": "acknowledgement", "附录a": "appendix"}


def simulate(paras):
    """Sections by a plain walk, for comparison with the windows."""
    section, out = "cover", []
    for p in paras:
        t = re.sub(r"\s", "", p[2])
        level, toc = p[6], (p[4] or "").lower() in ("toc1", "toc2", "toc3")
        if p[3] or not t:
            out.append(section)
            continue
        if t.lower() in HEADS:
            section = HEADS[t.lower()]
        elif section == "cover" or toc or t.startswith("关键词") or (section == "appendix" and level is not None):
            pass
        elif section == "appendix" and (p[8] is not None or t.startswith("附件") or t.startswith("姓名：") or t.startswith("2020年")):
            pass
        elif level is not None:
            section = "body"
        out.append(section)
    return out


def test_roles_against_simulation(spark):
    from quire.operators.roles import classify_roles

    r, rows, want = random.Random(9), [], {}
    for doc in range(60):
        ps = [para(doc, i, r.choice(TEXTS), in_table=r.random() < 0.1, outline_level=r.choice([None, None, None, 0, 1]), style_id=r.choice([None, None, "TOC1"]), num_id=(n := r.choice([None, None, None, "1"])), ilvl=0 if n else None, drawing_count=int(r.random() < 0.2), alignment=r.choice([None, "center"])) for i in range(30)]
        rows += ps
        want |= {(doc, i): s for i, s in enumerate(simulate(ps))}
    got = {(x.doc_id, x.para_index): x for x in classify_roles(spark.createDataFrame(rows, PARA)).collect()}
    bad = [k for k, x in got.items() if x.section != want[k] and not (rows[k[0] * 30 + k[1]][3] or not rows[k[0] * 30 + k[1]][2])]
    assert not bad and len(got) == 1800
    cell = next(k for k in got if rows[k[0] * 30 + k[1]][3])
    assert got[cell].role == "table_cell"


def test_heading_sequence_against_simulation(spark):
    from quire.operators.numbering import check_heading_sequence

    r, rows, want = random.Random(2), [], set()
    for doc in range(50):
        last = {}
        for i in range(20):
            lv, n = r.randrange(3), r.choice([1, 2, 3, None])
            rows.append((doc, i, f"heading{lv + 1}", lv, f"{n} 标题" if n else "绪论"))
            last = {k: v for k, v in last.items() if k <= lv}
            if n:
                if n != last.get(lv, 0) + 1:
                    want.add((doc, i, str(last.get(lv, 0) + 1), str(n)))
                last[lv] = n
    got = check_heading_sequence(spark.createDataFrame(rows, "doc_id long, para_index int, role string, outline_level int, text string")).collect()
    assert {(x.doc_id, x.para_index, x.expected, x.actual) for x in got} == want


def test_caption_sequence_against_simulation(spark):
    from quire.operators.numbering import check_caption_sequence

    r, rows, want = random.Random(6), [], []
    for doc in range(60):
        chapter, last, minor_ = None, 0, 0
        for i in range(16):
            if r.random() < 0.25:
                n = r.choice([1, 2, None])
                rows.append((doc, i, "heading1", 0, f"{n} 章" if n else "绪论"))
                chapter, last, minor_ = n, 0, 0
                continue
            a, b = r.randint(1, 3), r.choice([1, 2, None])
            rows.append((doc, i, "figure_caption", None, f"图{a}" + (f"-{b}" if b else "") + " x"))
            if b is None:
                want += [(doc, i, "error")] * (a != last + 1)
                last = a
                continue
            want += [(doc, i, "warn")] * (chapter is not None and a != chapter)
            want += [(doc, i, "error")] * (b != minor_ + 1 if a == last else b != 1)
            last, minor_ = a, b
    got = check_caption_sequence(spark.createDataFrame(rows, "doc_id long, para_index int, role string, outline_level int, text string"), None, "figure").collect()
    assert sorted((x.doc_id, x.para_index, x.severity) for x in got) == sorted(want)


def test_style_chain_cycles_and_depth(spark):
    from quire.operators.resolve import style_chain

    rows = [(1, f"s{i}", f"s{i - 1}" if i else None, "root" if i == 0 else None, float(i) if i % 5 == 0 else None) for i in range(16)] + [(1, "a", "b", "A", None), (1, "b", "a", None, 2.0), (1, "lost", "none", None, 3.0)]
    got = {x.style_id: (x.f, x.z) for x in style_chain(spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, f string, z double"), ["f", "z"]).collect()}
    assert got["s13"] == ("root", 10.0) and got["s4"] == ("root", 0.0) and got["a"] == ("A", 2.0) and got["b"] == ("A", 2.0) and got["lost"] == (None, 3.0)


def docx(body: str, **parts: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}>{body}</w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml.replace("NS", ns))
    return buf.getvalue()


BODY = """<w:body><w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:bookmarkStart w:id="1" w:name="_Ref1"/><w:r><w:t>一</w:t></w:r><w:r><w:t>二</w:t><w:footnoteReference w:id="2"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>SEQ Figure</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:fldSimple w:instr="REF _Ref1"><w:r><w:t>x</w:t></w:r></w:fldSimple></w:p>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body>"""


def test_docx_facts_and_triage(spark):
    from quire.sources.docx import OLE, extract_facts, fact_table, triage_files

    notes = '<w:footnotes NS><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    files = [(1, docx(BODY, footnotes=notes)), (2, OLE + b"x"), (3, b"plain"), (4, b"PK\x03\x04broken"), (5, docx("")), (6, docx("<w:body>")), (7, None)]
    facts = extract_facts(spark.createDataFrame(files, "id long, content binary")).cache()
    assert {r.id: r.code for r in triage_files(facts).collect()} == {1: "ok", 2: "LEGACY_DOC", 3: "NOT_ZIP", 4: "CORRUPT", 5: "NOT_DOCX", 6: "CORRUPT", 7: "NOT_ZIP"}
    p = fact_table(facts, "paragraph", "text string, in_table boolean, style_id string, num_id string").orderBy("seq").collect()
    assert [(r.text, r.in_table) for r in p] == [("一二", False), ("cell", True), ("inner", True), ("1x", False)] and (p[0].style_id, p[0].num_id) == ("H1", "3")
    f = fact_table(facts, "field", "field int, instruction string, display string").orderBy("field").collect()
    assert [(r.instruction, r.display) for r in f] == [("SEQ Figure", "1"), ("REF _Ref1", "x")]
    assert [r.content for r in fact_table(facts, "note_def", "type string, id string, content string").collect()] == ["note"]
    assert fact_table(facts, "section", "width string").first().width == "11906" and fact_table(facts, "bookmark", "name string").count() == 1


def test_watch_folder(spark, tmp_path):
    from quire.sources.docx import triage_files
    from quire.streaming.checks import watch_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx(BODY))
    (tmp_path / "in" / "b.docx").write_bytes(b"no")
    seen = []
    q = watch_folder(spark, str(tmp_path / "in"), lambda facts, n: seen.extend(r.code for r in triage_files(facts).collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == ["NOT_ZIP", "ok"]


COMPARED = ["check_heading_sequence", "check_caption_sequence", "caption_graph", "check_notes", "hf_rollup", "check_page_setup", "role_proposals", "check_run_fields", "resolve_paragraph", "triage_files"]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    import duckdb

    from quire.plans.registry import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got, want = queries()[name](spark, d).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def norm(df):
        return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))

    assert norm(got) == norm(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "n_errors"]
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


STYLES = """<w:styles NS><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:eastAsiaTheme="minorEastAsia" w:asciiTheme="minorHAnsi"/><w:sz w:val="21"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="120"/></w:pPr></w:pPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="400" w:lineRule="exact"/><w:ind w:firstLine="420"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="Body"/><w:basedOn w:val="N"/><w:rPr><w:sz w:val="24"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:b/></w:rPr></w:style></w:styles>"""
THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:fontScheme><a:majorFont><a:latin typeface="Cambria"/></a:majorFont><a:minorFont><a:latin typeface="Calibri"/><a:ea typeface=""/><a:font script="Hans" typeface="宋体"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
HEADER = '<w:hdr NS><w:p><w:pPr><w:pBdr><w:bottom w:val="single"/></w:pBdr></w:pPr><w:r><w:t>某某大学</w:t><w:tab/></w:r><w:r><w:rPr><w:sz w:val="18"/></w:rPr><w:t>论文</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p></w:hdr>'
FOOTER = '<w:ftr NS><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:rPr><w:sz w:val="18"/></w:rPr><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:ftr>'
NUMBERING = '<w:numbering NS><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="odd"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
PAPER = """<w:body><w:p><w:r><w:t>摘要</w:t></w:r></w:p><w:p><w:r><w:t>一些文字</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>2 绪论</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="B"/><w:rPr><w:sz w:val="20"/><w:i/></w:rPr></w:pPr><w:r><w:t>正文</w:t></w:r><w:r><w:rPr><w:sz w:val="18"/><w:rFonts w:eastAsia="黑体"/></w:rPr><w:t>一段</w:t><w:footnoteReference w:id="9"/></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="B"/><w:ind w:firstLineChars="200" w:left="480"/><w:spacing w:line="360"/></w:pPr><w:r><w:rPr><w:sz w:val="24"/></w:rPr><w:t>正文二</w:t></w:r></w:p>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:left="85.05pt" w:right="2.5cm"/></w:sectPr></w:body>"""


def word_of(spark, files):
    from quire.sources.docx import extract_documents
    from quire.sources.word import tables_of

    return tables_of(extract_documents(spark.createDataFrame(files, "id long, content binary")).cache())


def test_word_file_to_effective_formatting(spark):
    from quire.operators.numbering import resolve_numbering_level
    from quire.operators.page import hf_align, hf_rollup

    w = word_of(spark, [(1, docx(PAPER, styles=STYLES, header1=HEADER, footer1=FOOTER, numbering=NUMBERING, **{"theme/theme1": THEME})), (2, b"no")])
    assert [r.doc_id for r in w.documents.collect()] == [1]
    p = {r.para_index: r for r in w.paragraphs.collect()}
    # Defaults and theme, the default style, its indent in characters of the effective size.
    assert (p[0].font_east_asia, p[0].font_ascii, p[0].size_pt, p[0].line_pt, p[0].space_after_pt, p[0].first_line_chars) == ("宋体", "Calibri", 10.5, 20.0, 6.0, 2.0)
    assert (p[2].style_name, p[2].outline_level, p[2].bold, p[2].size_pt, p[2].num_id, p[2].ilvl) == ("heading 1", 0, True, 12.0, "3", 0)
    # The mark's size stands behind the first run's, here for a run without one; the indent follows it.
    assert (p[3].size_pt, p[3].italic, p[3].first_line_chars) == (10.0, True, 2.1)
    # Own paragraph properties: characters before twips, a multiple replaces the fixed height.
    assert (p[4].first_line_chars, p[4].left_chars, p[4].line_pt, p[4].line_multiple) == (2.0, 2.0, None, 1.5)
    runs = {(r.para_index, r.run_index): r for r in w.runs.collect()}
    assert (runs[3, 0].size_pt, runs[3, 1].size_pt, runs[3, 1].font_east_asia, runs[3, 0].font_east_asia) == (10.0, 9.0, "黑体", "宋体")
    level = resolve_numbering_level(w.instances, w.levels, w.overrides).first()
    assert (level.num_id, level.start, level.num_fmt, level.lvl_text) == ("3", 5, "decimal", "%1")
    parts = {r.kind: r for r in hf_rollup(hf_align(w.tokens)).collect()}
    assert (parts["header"].left_text, parts["header"].right_text, parts["footer"].has_page_number) == ("某某大学", "论文", True)
    s = w.sections.first()
    assert (s.page_width, s.margin_left, s.margin_right, s.margin_bottom) == (11906.0, 1701.0, 1417.0, None)


def test_word_file_to_issues(spark):
    from quire.operators.style_checks import RULE_SCHEMA
    from quire.plans.validate import validate_corpus

    w = word_of(spark, [(1, docx(PAPER, styles=STYLES, header1=HEADER, footer1=FOOTER, **{"theme/theme1": THEME}))])
    rules = spark.createDataFrame([("body_text", "fontSizePt", True, "error", "exact", None, 12.0, None, None, None, None), ("body_text", "lineHeightPt", True, "warn", "exact", None, 20.0, None, None, None, None), ("heading1", "bold", True, "warn", "exact", None, None, False, None, None, None)], RULE_SCHEMA)
    headers = {"left_text": "某某大学", "font_latin": "Arial", "size_pt": 9.0, "bottom_border": True, "number_alignment": "center", "number_size_pt": 9.0}
    got = validate_corpus(w, rules, {"margin_top_cm": 3, "paper_size": "A4"}, {"body_format": "Arabic"}, headers, {"ranges": {"keywords_cn": (3, 5)}, "min_references": 1}).orderBy("check_seq", "para_index", "field", "start_run").collect()
    assert [(r.check_seq, r.para_index, r.role, r.field, r.severity, r.start_run) for r in got] == [
        (1, -1, "document", "margin_top_cm", "error", None),
        (2, -1, "document", "page_number_body", "error", None),
        (3, -1, "document", "header_font_latin", "error", None),
        (3, -1, "document", "header_size_pt", "error", None),
        (4, 2, "heading1", "heading_sequence", "error", None),
        (8, 3, "body_text", "note_reference", "error", None),
        (9, -1, "document", "keywords_cn_count", "warn", None),
        (9, -1, "document", "references_count", "error", None),
        (10, 2, "heading1", "bold", "warn", None),
        (10, 3, "body_text", "size_pt", "error", 0),
        (10, 3, "body_text", "size_pt", "error", 1),
        (10, 4, "body_text", "line_spacing_pt", "warn", None),
    ]
    by = {(r.field, r.para_index, r.start_run): r for r in got}
    assert by["size_pt", 3, 1].message == "第 2 个文本片段「一段」字号应为 12pt，实际 9pt" and by["size_pt", 3, 1].suggestion == "请将该文本片段字号调整为 12pt" and by["size_pt", 3, 1].fixability == "auto"
    assert by["line_spacing_pt", 4, None].suggestion == "当前行距为 1.5 倍，请人工核对排版后将其设为固定值 20pt" and by["bold", 2, None].suggestion == "请将该段落设为 「不加粗」"
    assert by["header_size_pt", -1, None].actual == "10.5 / 9" and by["header_font_latin", -1, None].suggestion == "请将页眉西文字体设为 Arial"
    assert by["heading_sequence", 2, None].role_confidence == "high" and by["heading_sequence", 2, None].text_preview == "2 绪论"


def test_classified_paragraphs_are_kept_once_and_counts_need_no_hints(spark):
    from collections import Counter
    from dataclasses import replace

    from quire.operators.roles import classify_roles
    from quire.operators.style_checks import RULE_SCHEMA
    from quire.plans.validate import found_issues, validate_corpus
    from quire.sources.tables import stored

    w = word_of(spark, [(1, docx(PAPER, styles=STYLES, header1=HEADER, footer1=FOOTER, **{"theme/theme1": THEME}))])
    rules = spark.createDataFrame([("body_text", "fontSizePt", True, "error", "exact", None, 12.0, None, None, None, None), ("heading1", "bold", True, "warn", "exact", None, None, False, None, None, None)], RULE_SCHEMA)
    given = (rules, {"margin_top_cm": 3}, {"body_format": "Arabic"}, {"size_pt": 9.0}, {"min_references": 1})

    def never(df):
        raise AssertionError("classified again")

    done = replace(w, paragraphs=stored(classify_roles(w.paragraphs), "roles"))
    want = validate_corpus(w, *given).collect()
    got = validate_corpus(done, *given, keep=never)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 9
    assert {r.role_confidence for r in want if r.para_index < 0} == {None} and None not in {r.role_confidence for r in want if r.para_index >= 0}
    found = found_issues(done, *given, keep=never).select("check_seq", "field", "severity")
    assert Counter(map(tuple, found.collect())) == Counter((r.check_seq, r.field, r.severity) for r in want)
    assert "confidence" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scan_corpus_of_real_files(spark, tmp_path):
    from quire.sources.docx import extract_facts, scan_corpus, triage_files

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.DOCX").write_bytes(docx(BODY))
    (tmp_path / "deep" / "b.docx").write_bytes(b"no")
    (tmp_path / "c.txt").write_text("x")
    from pyspark.sql import functions as F

    files = scan_corpus(spark, str(tmp_path)).select(F.xxhash64("path").alias("id"), "content")
    assert sorted(r.code for r in triage_files(extract_facts(files)).collect()) == ["NOT_ZIP", "ok"]


def test_scan_corpus_lists_files_in_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.plans.files import word_files, write_files
    from quire.sources.docx import scan_corpus

    docs = spark.range(0, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    folder = tmp_path / "a b%20\u6587"
    write_files(word_files(docs), folder.as_uri())
    for name in ("_hidden/x.docx", ".hidden/x.docx", "k=1/_y=2/in.docx", "_no.docx", ".no.docx", "deep/er/UP.DOCX", "deep/other.doc", "empty.docx"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"" if name == "empty.docx" else name.encode())
    (folder / "none").mkdir()
    spark_own = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(str(folder)).select("path", "length", "content")
    # Spark's reader leaves out empty files; here they have a row, and so a code.
    want = sorted([*spark_own.collect(), (f"file:{folder}/empty.docx", 0, b"")])
    for at in (folder.as_uri(), str(folder)):
        files = scan_corpus(spark, at)
        assert not files.inputFiles() and files.schema.simpleString() == spark_own.schema.simpleString()
        assert sorted(files.collect()) == want and len(want) > 60
    # A single file and a place that isn't there are left to Spark's reader.
    assert [r.length for r in scan_corpus(spark, str(folder / "deep/er/UP.DOCX")).collect()] == [15]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_corpus(spark, str(tmp_path / "nowhere")).collect()


def test_style_chain_of_any_length(spark):
    from quire.operators.resolve import style_chain

    rows = [(1, f"s{i}", f"s{i - 1}" if i else None, "root" if i == 0 else None) for i in range(75)]
    got = {x.style_id: x.f for x in style_chain(spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, f string"), ["f"]).collect()}
    assert len(got) == 75 and set(got.values()) == {"root"}

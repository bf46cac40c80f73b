"""Word files as the tables that the checks take.

A file's parts stand in one row (docx.extract_documents), styles and defaults
beside the paragraphs that inherit from them. So every table is a narrow pass
over stored Parquet that reads its own columns: no join, no exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.units import half_points_to_pt, line_spacing, measure_to_twips, on_off
from quire.functions.text import once, trim_ws
from quire.operators.resolve import PARA, RUN, effective, fold_styles


@dataclass
class Word:
    """Tables of a corpus of Word files, all keyed by doc_id."""

    documents: DataFrame  # doc_id of every readable file
    paragraphs: DataFrame  # text, place, style, numbering, structure and effective properties
    runs: DataFrame  # run_index, text and effective properties
    fields: DataFrame  # field_index, instruction, display_text, start_run, end_run
    bookmarks: DataFrame  # para_index, id, name
    note_refs: DataFrame  # para_index, type, note_id, run_index
    note_defs: DataFrame  # type, note_id, content, seq
    sections: DataFrame  # section_index, measures in twips, page numbers
    tokens: DataFrame  # of headers and footers, with effective properties and the paragraph's bottom border
    instances: DataFrame  # num_id, abstract_num_id
    levels: DataFrame  # abstract_num_id, ilvl, start, num_fmt, lvl_text
    overrides: DataFrame  # num_id, ilvl, start


def run_columns(of: str | Column = "") -> dict[str, Column]:
    """RUN from run properties as written; of: the struct that holds them."""
    c = lambda n: of[n] if isinstance(of, Column) else F.col(f"{of}.{n}" if of else n)
    return {
        "font_east_asia": c("eastAsia"),
        "font_ascii": c("ascii"),
        "font_hansi": c("hAnsi"),
        "size_pt": half_points_to_pt(c("sz").try_cast("double")),
        "bold": on_off(c("b")),
        "italic": on_off(c("i")),
    }


def para_columns(of: str | Column) -> dict[str, Column]:
    """PARA from paragraph properties as written."""
    c = lambda n: of[n] if isinstance(of, Column) else F.col(f"{of}.{n}")
    chars = lambda n: c(n).try_cast("double") / 100
    return {
        "alignment": F.nullif(c("jc"), F.lit("")),
        "line": F.when(c("line").isNotNull(), once(line_spacing(c("line"), c("line_rule")), lambda x: F.when(x.isNotNull(), F.struct(x["pt"].alias("pt"), x["multiple"].alias("multiple"))))),
        "space_before_pt": measure_to_twips(c("before")) / 20,
        "space_after_pt": measure_to_twips(c("after")) / 20,
        "outline_level": c("outline").try_cast("int"),
        "first_twips": measure_to_twips(c("first")),
        "first_chars": chars("first_chars"),
        "hanging_twips": measure_to_twips(c("hanging")),
        "hanging_chars": chars("hanging_chars"),
        "left_twips": measure_to_twips(c("left")),
        "left_chars": chars("left_chars"),
    }


def _named(cols: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for n, c in cols.items()]


def js_number(t: Column) -> Column:
    """A decimal number as written; a blank text is 0, anything else null."""
    plain = trim_ws(t)
    return F.when(plain == "", F.lit(0.0)).when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), plain.try_cast("double"))


def with_styles(documents: DataFrame) -> DataFrame:
    """documents with _ids and _styles (last definitions, inherited values) of all styles, _default (id of the first default paragraph style) and _def (the document's defaults)."""
    own = lambda x: F.struct(x["style_id"].alias("style_id"), x["seq"].alias("seq"), x["based_on"].alias("based_on"), x["name"].alias("name"), *_named(run_columns(x)), *_named(para_columns(x["para"])))
    d = documents.withColumn("_raw", F.array_sort(F.transform("style", own)))
    # Sorted by id and place: the last of an id is followed by another id.
    d = d.withColumn("_last", F.filter("_raw", lambda x, i: ~F.get("_raw", i + 1)["style_id"].eqNullSafe(x["style_id"])))
    first = F.get(F.filter("style", lambda x: (x["type"] == "paragraph") & x["is_default"]), F.lit(0))["style_id"]
    base = F.get("default", F.lit(0))
    d = d.withColumn("_styles", fold_styles(F.col("_last"), RUN + PARA, ["name"])).withColumn("_default", first)
    d = d.withColumn("_def", F.when(base.isNotNull(), F.struct(*_named(run_columns(base)), *_named(para_columns(base["para"])))))
    return d.withColumn("_ids", F.transform("_styles", lambda x: x["style_id"])).drop("_raw", "_last")


BOOK = ["_ids", "_styles", "_default", "_def"]


def style_at(style_id: Column) -> Column:
    """The style of that id, or the document's default one where the id is null."""
    return F.get("_styles", F.array_position("_ids", F.coalesce(style_id, F.col("_default"))).cast("int") - 1)


def tables_of(files: DataFrame) -> Word:
    """extract_documents() → Word. Files are read once for each table: store them first."""
    d = files.where("code = 'ok'").withColumnRenamed("id", "doc_id")
    book = with_styles(d)
    rows = lambda fact: d.select("doc_id", F.explode(fact).alias("x")).select("doc_id", "x.*")
    inner = lambda name: d.select("doc_id", F.explode("paragraph").alias("p")).select("doc_id", F.col("p.seq").alias("para_index"), F.explode(f"p.{name}").alias("x")).select("doc_id", "para_index", "x.*")

    p = book.select("doc_id", *BOOK, F.explode("paragraph").alias("p"))
    shown = F.get(F.filter("p.runs", lambda x: trim_ws(x["text"]) != ""), F.lit(0))
    marks = _named(run_columns("p.mark"), "m_")
    own = p.select(
        "doc_id", F.col("p.seq").alias("para_index"), "p.text", "p.in_table", "p.style_id", F.get("_styles", F.array_position("_ids", F.col("p.style_id")).cast("int") - 1)["name"].alias("style_name"),
        F.when(F.col("p.ilvl").isNotNull(), F.col("p.num_id")).alias("num_id"), F.when(F.col("p.num_id").isNotNull(), F.col("p.ilvl").try_cast("int")).alias("ilvl"),
        F.col("p.drawings").alias("drawing_count"), F.col("p.maths").alias("math_count"), F.col("p.objects").alias("object_count"),
        style_at(F.col("p.style_id")).alias("_chain"), "_def", once(shown, lambda x: F.when(x.isNotNull(), F.struct(*_named(run_columns(x))))).alias("_run"), *marks, *_named(para_columns("p.para"), "p_"),
    )
    paragraphs = effective(own, RUN, PARA, True)
    paragraphs = paragraphs.select("*", F.col("line.pt").alias("line_pt"), F.col("line.multiple").alias("line_multiple")).drop("line")

    r = p.select("doc_id", F.col("p.seq").alias("para_index"), style_at(F.col("p.style_id")).alias("_chain"), "_def", *marks, F.explode("p.runs").alias("r"))
    runs = effective(r.select("doc_id", "para_index", F.col("r.run").alias("run_index"), "r.text", F.struct(*_named(run_columns("r"))).alias("_run"), "_chain", "_def", *[f"m_{n}" for n in RUN]), RUN, marks=True)

    t = book.select("doc_id", *BOOK, F.explode("hf_token").alias("t"))
    t = t.select(
        "doc_id", "t.kind", "t.part", "t.para", "t.tok", "t.tok_kind", "t.text", "t.instruction", F.col("t.jc").alias("para_alignment"), F.col("t.border").alias("border_style"),
        F.when(F.col("t.bottom").isNotNull(), F.struct(F.col("t.bottom.style").alias("style"), js_number(F.col("t.bottom.size")).alias("size"), F.col("t.bottom.color").alias("color"), js_number(F.col("t.bottom.space")).alias("space"))).alias("border"),
        style_at(F.col("t.style_id")).alias("_chain"), "_def", F.struct(*_named(run_columns("t.run"))).alias("_run"), *_named(run_columns("t.mark"), "m_"),
    )
    tokens = effective(t, RUN, marks=True)

    twips = lambda n: measure_to_twips(F.col(n))
    sections = rows("section").select(
        "doc_id", F.col("seq").alias("section_index"), twips("width").alias("page_width"), twips("height").alias("page_height"),
        *[twips(n).alias(f"margin_{n}") for n in ("top", "bottom", "left", "right")], *[twips(n).alias(n) for n in ("header", "footer", "gutter")],
        F.nullif("format", F.lit("")).alias("number_format"), F.col("start").try_cast("int").alias("number_start"),
    )
    level = lambda *more: [F.col("abstract").alias("abstract_num_id"), *more]
    start = [F.col("ilvl").try_cast("int").alias("ilvl"), F.col("start").try_cast("int").alias("start")]
    return Word(
        d.select("doc_id"),
        paragraphs,
        runs,
        inner("fields").select("doc_id", "para_index", F.col("field").alias("field_index"), "instruction", F.col("display").alias("display_text"), F.col("start").alias("start_run"), F.col("end").alias("end_run")),
        inner("bookmarks").select("doc_id", "para_index", "id", "name"),
        inner("note_refs").select("doc_id", "para_index", "type", F.col("id").alias("note_id"), F.col("run").alias("run_index")),
        rows("note_def").select("doc_id", "type", F.col("id").alias("note_id"), "content", "seq"),
        sections,
        tokens,
        rows("num_instance").select("doc_id", F.col("num").alias("num_id"), *level()),
        rows("num_level").select("doc_id", *level(*start), F.col("fmt").alias("num_fmt"), F.col("text").alias("lvl_text")),
        rows("num_override").select("doc_id", F.col("num").alias("num_id"), *start),
    )

"""Page setup, page numbers, headers and footers: aggregates a document against broadcast scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import WS, WS_BODY, compact_text, inline_text, number_text, trim_ws
from quire.functions.units import js_round, twips_to_cm

# Rule key → (section column, label).
DIMENSIONS = {
    "margin_top_cm": ("margin_top", "上边距"),
    "margin_bottom_cm": ("margin_bottom", "下边距"),
    "margin_left_cm": ("margin_left", "左边距"),
    "margin_right_cm": ("margin_right", "右边距"),
    "header_distance_cm": ("header", "页眉距"),
    "footer_distance_cm": ("footer", "页脚距"),
    "gutter_cm": ("gutter", "装订线"),
}
NUMBER_FORMATS = {"RomanUpper": "upperRoman", "RomanLower": "lowerRoman", "Arabic": "decimal"}


def check_page_setup(sections: DataFrame, rules: dict) -> DataFrame:
    """The last section of each document against the rule's dimensions: doc_id, field, expected, actual, message."""
    cols = [c for c, _ in DIMENSIONS.values()] + ["page_width", "page_height"]
    last = sections.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "section_index").alias("s")).select("doc_id", "s.*")
    cm = lambda c: js_round(twips_to_cm(F.col(c)), 2)
    items = []
    for key, (c, label) in DIMENSIONS.items():
        if rules.get(key) is not None:
            want, have = F.lit(float(rules[key])), cm(c)
            say = F.concat(F.lit(f"{label}应为 "), number_text(want), F.lit("cm，实际 "), number_text(have), F.lit("cm"))
            items.append(F.when(F.abs(have - want) > 0.05, F.struct(F.lit(key).alias("field"), number_text(want).alias("expected"), number_text(have).alias("actual"), say.alias("message"))))
    if rules.get("paper_size") == "A4":
        size = F.concat(number_text(cm("page_width")), F.lit("×"), number_text(cm("page_height")), F.lit("cm"))
        off = (F.col("page_width") != 0) & (F.col("page_height") != 0) & ((F.abs(cm("page_width") - 21) > 0.1) | (F.abs(cm("page_height") - 29.7) > 0.1))
        items.append(F.when(off, F.struct(F.lit("paper_size").alias("field"), F.lit("A4 (21×29.7cm)").alias("expected"), size.alias("actual"), F.concat(F.lit("纸张应为 A4 (21×29.7cm)，实际 "), size).alias("message"))))
    return last.select("doc_id", F.inline(F.array_compact(F.array(*items))))


def check_page_numbers(documents: DataFrame, sections: DataFrame, rules: dict) -> DataFrame:
    """Documents without a section of the front or body format; documents(doc_id) may have no section at all."""
    fmt = F.coalesce("number_format", F.lit("decimal"))
    front, body = rules.get("front_matter_format"), rules.get("body_format")
    restart = rules.get("body_restart_at", 1)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", fmt.alias("f")))), lambda x: x["f"]), ",")
    per = sections.groupBy("doc_id").agg(
        ordered.alias("formats"),
        F.bool_or(fmt == NUMBER_FORMATS.get(front, front)).alias("front"),
        F.bool_or((fmt == NUMBER_FORMATS.get(body, body)) & F.coalesce(F.col("number_start") == restart, F.lit(False))).alias("body"),
    )
    d = documents.select("doc_id").hint("merge").join(per, "doc_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    items = []
    if front:
        items.append(F.when(no("front"), F.struct(F.lit("page_number_front").alias("field"), F.lit(front).alias("expected"), F.lit(f"前置部分页码应使用 {front}（{NUMBER_FORMATS.get(front, front)}），未找到对应分节").alias("message"))))
    if body:
        items.append(F.when(no("body"), F.struct(F.lit("page_number_body").alias("field"), F.lit(f"{body} start={restart}").alias("expected"), F.lit(f"正文页码应为 {body}（{NUMBER_FORMATS.get(body, body)}）并从 {restart} 重新编号").alias("message"))))
    return d.select("doc_id", F.coalesce("formats", F.lit("")).alias("actual"), F.inline(F.array_compact(F.array(*items))))


KEYS = ["doc_id", "kind", "part", "para"]
FONTS = ["font_east_asia", "font_ascii", "font_hansi", "size_pt"]


def hf_align(tokens: DataFrame) -> DataFrame:
    """Header and footer tokens → segments with an alignment.

    Tabs part left, centre and right; without tabs a left paragraph parts at
    its first gap of four or more spaces.
    """
    own = Window.partitionBy(*KEYS)
    w = own.orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    is_tab = (F.col("tok_kind") == "tab").cast("int")
    t = tokens.withColumn("_z", F.sum(is_tab).over(w)).withColumn("_tabs", F.sum(is_tab).over(own)).where("tok_kind <> 'tab'")
    base = F.when(F.col("para_alignment") == "end", "right").when(F.col("para_alignment").isin("left", "center", "right"), F.col("para_alignment")).otherwise("left")
    t = t.withColumn("_base", base)
    splits = (F.col("_tabs") == 0) & (F.col("_base") == "left") & (F.col("tok_kind") == "text")
    pieces = F.when(splits, F.regexp_extract_all("text", F.lit(rf"{WS}{{4,}}|(?:[^{WS_BODY}]|{WS}{{1,3}}(?!{WS}))+"), F.lit(0))).otherwise(F.array("text"))
    t = t.select("*", F.posexplode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array("text"))).alias("seg", "_piece"))
    gap = (splits & F.col("_piece").rlike(rf"^{WS}{{4,}}\z")).cast("int")
    before = own.orderBy("tok", "seg").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_after", F.coalesce(F.max(gap).over(before), F.lit(0)))
    side = (
        F.when((F.col("_tabs") >= 2) & (F.col("_z") == 1), "center")
        .when((F.col("_tabs") > 0) & (F.col("_z") > 0), "right")
        .when(F.col("_tabs") > 0, "left")
        .when((F.col("_base") == "left") & (F.col("_after") > 0), "right")
        .otherwise(F.col("_base"))
    )
    return t.select(*KEYS, "tok", "seg", F.col("tok_kind").alias("seg_kind"), F.col("_piece").alias("text"), "instruction", side.alias("alignment"), *FONTS, "border_style")


def hf_paragraphs(segments: DataFrame) -> DataFrame:
    """One row a header or footer paragraph that is kept, with its segments in order (x) and whether it has a page number; blank paragraphs and repeats of an earlier one of the part go."""
    ordered = F.array_sort(F.collect_list(F.struct("tok", "seg", "seg_kind", "alignment", "text", "instruction")))
    p = segments.groupBy(*KEYS).agg(ordered.alias("x"), F.max("border_style").alias("border_style"))
    key = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["seg_kind"], s["alignment"], s["text"], F.coalesce(s["instruction"], F.lit("")))), "|")
    has = F.exists("x", lambda s: s["seg_kind"] == "pageNumber")
    p = p.withColumn("_key", key).withColumn("has_page_number", has).where(F.col("has_page_number") | F.exists("x", lambda s: trim_ws(s["text"]) != ""))
    first = F.min(F.struct("para", "x", "has_page_number", "border_style")).alias("m")
    return p.groupBy("doc_id", "kind", "part", "_key").agg(first).select("doc_id", "kind", "part", "m.*")


def hf_kept(segments: DataFrame) -> DataFrame:
    """The segments of hf_paragraphs."""
    return segments.hint("merge").join(hf_paragraphs(segments).select(*KEYS), KEYS, "left_semi")


def hf_rollup(segments: DataFrame) -> DataFrame:
    """Left, centre and right text of each part."""
    side = lambda a: inline_text(F.array_join(F.transform(F.filter("x", lambda s: (s["alignment"] == a) & (s["seg_kind"] == "text")), lambda s: s["text"]), ""))
    p = hf_paragraphs(segments).select("doc_id", "kind", "part", "para", "has_page_number", *[side(a).alias(a) for a in ("left", "center", "right")])
    rows = F.array_sort(F.collect_list(F.struct("para", "left", "center", "right")))
    g = p.groupBy("doc_id", "kind", "part").agg(rows.alias("r"), F.bool_or("has_page_number").alias("has_page_number"))
    text = lambda a: inline_text(F.array_join(F.filter(F.transform("r", lambda x: x[a]), lambda v: v != ""), " "))
    return g.select("doc_id", "kind", "part", *[text(a).alias(f"{a}_text") for a in ("left", "center", "right")], "has_page_number")


def hf_borders(tokens: DataFrame) -> DataFrame:
    """The bottom border of each header and footer paragraph that has one: style, size, colour, space and whether it shows."""
    b = tokens.where("border is not null").groupBy("doc_id", "kind", "part", "para").agg(F.min_by("border", "tok").alias("b"))
    return b.select("doc_id", "kind", "part", "para", "b.style", "b.size", "b.color", "b.space", border_visible(F.col("b.style")).alias("visible"))


def border_visible(style: Column) -> Column:
    """A bottom border that shows."""
    return F.coalesce(~style.isin("none", "nil") & (style != ""), F.lit(False))


# Field → (severity, message about the expected value) of the header and footer checks.
HF_CHECKS = {
    "header_text": ("warn", "页眉应包含「{}」"),
    "header_font_east_asia": ("error", "页眉中文字体应为「{}」"),
    "header_font_latin": ("error", "页眉西文字体应为「{}」"),
    "header_size_pt": ("error", "页眉字号应为 {}pt"),
    "header_bottom_border": ("warn", "页眉下方应设置边框线"),
    "page_number_alignment": ("warn", "页码位置应为「{}」"),
    "page_number_font_latin": ("error", "页码西文字体应为「{}」"),
    "page_number_size_pt": ("error", "页码字号应为 {}pt"),
}
NO_BORDER = "页眉下方不应设置边框线"


def _hf_columns(field: str, expected: Column, actual: Column, message: str | None = None) -> list[Column]:
    severity, say = HF_CHECKS[field]
    before, _, after = (message or say).partition("{}")
    said = F.concat(F.lit(before), expected, F.lit(after)) if "{}" in (message or say) else F.lit(before)
    return [F.lit(field).alias("field"), expected.alias("expected"), actual.alias("actual"), F.lit(severity).alias("severity"), said.alias("message")]


def _hf_issue(bad: DataFrame, field: str, expected: Column, actual: Column, message: str | None = None) -> DataFrame:
    return bad.select("doc_id", *_hf_columns(field, expected, actual, message))


def describe_values(values: Column) -> Column:
    """Distinct values in order of appearance, joined; ordered array of structs whose last field is v."""
    v = F.array_distinct(F.filter(F.transform(values, lambda x: x["v"]), lambda x: x.isNotNull()))
    return F.when(F.size(v) > 0, F.array_join(v, " / ")).otherwise("(未设置)")


def check_header_text(documents: DataFrame, parts: DataFrame, text: str) -> DataFrame:
    want = compact_text(F.lit(text))
    p = parts.where("kind = 'header'")
    left = F.when(F.col("left_text") == "", "(左侧无文字)").otherwise(F.col("left_text"))
    g = p.groupBy("doc_id").agg(F.bool_or(F.contains(compact_text(F.col("left_text")), want)).alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", left.alias("v")))), lambda x: x["v"]), " / ").alias("actual"))
    d = documents.select("doc_id").hint("merge").join(g, "doc_id", "left").where(~F.coalesce("ok", F.lit(False)))
    return _hf_issue(d, "header_text", F.lit(text), F.coalesce(F.nullif("actual", F.lit("")), F.lit("(无页眉文字)")))


def check_segments(documents: DataFrame, segments: DataFrame, field: str, value: Column, expected, header: bool) -> DataFrame:
    """All text segments of kept header paragraphs (or page numbers of footers, then headers) must have the expected value; none at all fails too."""
    s = segments.where((F.col("kind") == "header") & (F.col("seg_kind") == "text") & (trim_ws(F.col("text")) != "")) if header else segments.where("seg_kind = 'pageNumber'")
    number = isinstance(expected, float)
    ok = F.coalesce(F.abs(value - expected) <= 0.1 if number else value == expected, F.lit(False))
    shown = number_text(value) if number else value
    order = F.struct((F.col("kind") == "header").alias("h"), "part", "para", "tok", "seg", shown.alias("v"))
    g = s.groupBy("doc_id").agg(F.bool_and(ok).alias("ok"), describe_values(F.array_sort(F.collect_list(order))).alias("actual"))
    d = documents.select("doc_id").hint("merge").join(g, "doc_id", "left").where(~F.coalesce("ok", F.lit(False)))
    return _hf_issue(d, field, number_text(F.lit(expected)) if number else F.lit(expected), F.coalesce("actual", F.lit("(未设置)")))


def _latin() -> Column:
    return F.coalesce("font_ascii", "font_hansi")


# Rule key → (check, value of a segment, whether header texts are meant).
SEGMENT_RULES = {
    "font_east_asia": ("header_font_east_asia", lambda: F.col("font_east_asia"), True),
    "font_latin": ("header_font_latin", _latin, True),
    "size_pt": ("header_size_pt", lambda: F.col("size_pt"), True),
    "number_alignment": ("page_number_alignment", lambda: F.col("alignment"), False),
    "number_font_latin": ("page_number_font_latin", _latin, False),
    "number_size_pt": ("page_number_size_pt", lambda: F.col("size_pt"), False),
}


def hf_documents(tokens: DataFrame) -> DataFrame:
    """(doc_id, paragraphs): the kept header and footer paragraphs of a document in order (is_header, part, para, border_style, left, segments), in one exchange by doc_id."""
    segments = hf_align(tokens.repartition("doc_id"))
    fields = ["tok", "seg", "seg_kind", "alignment", "text", "instruction", *FONTS]
    p = segments.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x"), F.max("border_style").alias("border_style"))
    key = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["seg_kind"], s["alignment"], s["text"], F.coalesce(s["instruction"], F.lit("")))), "|")
    shows = F.exists("x", lambda s: (s["seg_kind"] == "pageNumber") | (trim_ws(s["text"]) != ""))
    first = F.min_by(F.struct("para", "border_style", "x"), "para").alias("m")
    kept = p.withColumn("_key", key).where(shows).groupBy("doc_id", "kind", "part", "_key").agg(first)
    left = inline_text(F.array_join(F.transform(F.filter("m.x", lambda s: (s["alignment"] == "left") & (s["seg_kind"] == "text")), lambda s: s["text"]), ""))
    row = F.struct((F.col("kind") == "header").alias("is_header"), "part", F.col("m.para").alias("para"), F.col("m.border_style").alias("border_style"), left.alias("left"), F.col("m.x").alias("x"))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("paragraphs"))


def check_header_footer(documents: DataFrame, tokens: DataFrame, rules: dict) -> DataFrame:
    """Issues of all rules that are set (left_text, the keys of SEGMENT_RULES, bottom_border), from one row a document."""
    d = documents.select("doc_id").hint("merge").join(hf_documents(tokens), "doc_id", "left")
    none = F.array().cast("array<struct<is_header:boolean,part:int,para:int,border_style:string,left:string,x:array<struct<tok:int,seg:int,seg_kind:string,alignment:string,text:string,instruction:string,font_east_asia:string,font_ascii:string,font_hansi:string,size_pt:double>>>>")
    d = d.select("doc_id", F.coalesce("paragraphs", none).alias("p"))
    d = d.withColumn("headers", F.filter("p", lambda x: x["is_header"]))
    texts = F.filter(F.flatten(F.transform("headers", lambda x: x["x"])), lambda s: (s["seg_kind"] == "text") & (trim_ws(s["text"]) != ""))
    d = d.select("*", texts.alias("texts"), F.filter(F.flatten(F.transform("p", lambda x: x["x"])), lambda s: s["seg_kind"] == "pageNumber").alias("numbers"))
    out = []

    def put(bad: Column, field: str, expected: Column, actual: Column, message: str | None = None):
        out.append(F.when(bad, F.struct(*_hf_columns(field, expected, actual, message))))

    def values(key: str):
        field, _, header = SEGMENT_RULES[key]
        want, held = rules[key], F.col("texts" if header else "numbers")
        value = {"font_east_asia": lambda s: s["font_east_asia"], "size_pt": lambda s: s["size_pt"], "number_alignment": lambda s: s["alignment"], "number_size_pt": lambda s: s["size_pt"]}.get(key, lambda s: F.coalesce(s["font_ascii"], s["font_hansi"]))
        size = key.endswith("size_pt")
        want = float(want) if size else want
        ok = F.forall(held, lambda s: F.coalesce(F.abs(value(s) - want) <= 0.1 if size else value(s) == want, F.lit(False)))
        shown = describe_values(F.transform(held, lambda s: F.struct((number_text(value(s)) if size else value(s)).alias("v"))))
        put(~(ok & (F.size(held) > 0)), field, number_text(F.lit(want)) if size else F.lit(want), shown)

    if rules.get("left_text"):
        # The left text of a part: its paragraphs' texts, the empty ones left out.
        parts = F.array_sort(F.array_distinct(F.transform("headers", lambda x: x["part"])))
        left = lambda k: inline_text(F.array_join(F.filter(F.transform(F.filter("headers", lambda x: x["part"] == k), lambda x: x["left"]), lambda v: v != ""), " "))
        d = d.withColumn("lefts", F.transform(parts, left))
        ok = F.exists("lefts", lambda v: F.contains(compact_text(v), compact_text(F.lit(rules["left_text"]))))
        said = F.array_join(F.transform("lefts", lambda v: F.when(v == "", "(左侧无文字)").otherwise(v)), " / ")
        put(~ok, "header_text", F.lit(rules["left_text"]), F.coalesce(F.nullif(said, F.lit("")), F.lit("(无页眉文字)")))
    for key in ("font_east_asia", "font_latin", "size_pt"):
        if rules.get(key) is not None:
            values(key)
    if rules.get("bottom_border") is not None:
        n, m = F.size(F.filter("headers", lambda x: border_visible(x["border_style"]))), F.size("headers")
        ok = (m > 0) & (n == m) if rules["bottom_border"] else n == 0
        put(~ok, "header_bottom_border", F.lit(str(rules["bottom_border"]).lower()), F.concat(n.cast("string"), F.lit("/"), m.cast("string")), None if rules["bottom_border"] else NO_BORDER)
    for key in ("number_alignment", "number_font_latin", "number_size_pt"):
        if rules.get(key) is not None:
            values(key)
    if not out:
        return d.limit(0).select("doc_id", *[F.lit("").alias(c) for c in ("field", "expected", "actual", "severity", "message")])
    return d.select("doc_id", F.inline(F.array_compact(F.array(*out))))


def check_header_border(documents: DataFrame, segments: DataFrame, expected: bool) -> DataFrame:
    """Kept header paragraphs with a visible bottom border of all: every one of them, or none, must have it."""
    p = hf_paragraphs(segments).where("kind = 'header'")
    g = p.groupBy("doc_id").agg(F.count("*").alias("m"), F.count_if(border_visible(F.col("border_style"))).alias("n"))
    d = documents.select("doc_id").hint("merge").join(g, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    ok = (F.col("m") > 0) & (F.col("n") == F.col("m")) if expected else F.col("n") == 0
    actual = F.concat(F.col("n").cast("string"), F.lit("/"), F.col("m").cast("string"))
    return _hf_issue(d.where(~ok), "header_bottom_border", F.lit(str(expected).lower()), actual, None if expected else NO_BORDER)

"""Text predicates and scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that the rules know (Unicode spaces, no-break space and byte-order mark included).
WS_BODY = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_BODY}]"
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"[\x{4E00}-\x{9FFF}]"


def trim_ws(t: Column) -> Column:
    return F.trim(t, F.lit(WS_CHARS))


def compact_text(t: Column) -> Column:
    return F.translate(t, WS_CHARS, "")


def inline_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(t, WS_CHARS, " " * len(WS_CHARS)), "  +", " "))


def preview24(t: Column) -> Column:
    return F.substring(inline_text(t), 1, 24)


def has_cjk(t: Column) -> Column:
    return t.rlike(CJK)


def has_latin(t: Column) -> Column:
    return t.rlike("[A-Za-z]")


def cjk_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[\x{3400}-\x{9FFF}]"))


def en_word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[A-Za-z]+(?:[-'][A-Za-z]+)*"))


def keyword_items(t: Column, prefix: str) -> Column:
    """Items after the prefix, the trailing stops dropped, split at the list marks."""
    body = F.regexp_replace(F.regexp_replace(t, prefix, ""), rf"[。.;；{WS_BODY}]+\z", "")
    return F.size(F.filter(F.split(trim_ws(body), "[；;、，,]+"), lambda x: trim_ws(x) != ""))


KEYWORD_PREFIX = {"cn": rf"^关键词{WS}*[:：]?{WS}*", "en": rf"(?i)^key{WS}*words?{WS}*[:：]?{WS}*"}


def is_foreign_reference(t: Column) -> Column:
    return (cjk_count(t) == 0) & (en_word_count(t) >= 3)


def once(value: Column, body) -> Column:
    """body(value), with value worked out once and body outside generated code: for long expressions over one value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extract_number(t: Column) -> Column:
    """Number of a heading by the first form that matches; numerals above ten in Chinese give null."""
    cn, ar = r"^第?([一二三四五六七八九十]+)[章节条款]", rf"^第?{WS}*(\d+){WS}*[章节条款]"
    multi, single = r"^(\d+(?:\.\d+)+)[^\d]", rf"^(\d+)(?:[.、]|{WS}+[^{WS_BODY}])"
    paren = r"^(?:\((\d+)\)|（(\d+)）)"
    digits = F.create_map(*[x for i, c in enumerate("一二三四五六七八九十", 1) for x in (F.lit(c), F.lit(i))])
    return once(
        trim_ws(t),
        lambda s: F.when(s.rlike(cn), F.try_element_at(digits, F.regexp_extract(s, cn, 1)))
        .when(s.rlike(ar), F.regexp_extract(s, ar, 1).try_cast("int"))
        .when(s.rlike(multi), F.element_at(F.split(F.regexp_extract(s, multi, 1), r"\."), -1).try_cast("int"))
        .when(s.rlike(single), F.regexp_extract(s, single, 1).try_cast("int"))
        .when(s.rlike(paren), F.concat(F.regexp_extract(s, paren, 1), F.regexp_extract(s, paren, 2)).try_cast("int")),
    )


def caption_number_text(t: Column) -> Column:
    s, form = trim_ws(t), rf"^[图表]{WS}*(\d+)(?:[-.](\d+))?"
    major, minor = F.regexp_extract(s, form, 1).try_cast("int"), F.regexp_extract(s, form, 2).try_cast("int")
    return F.when(s.rlike(form), F.when(minor.isNull(), F.array(major)).otherwise(F.array(major, minor)))


def caption_number_field(t: Column) -> Column:
    """Numbers of a caption field's display text, null unless all parts are numbers."""
    s = F.regexp_replace(F.regexp_replace(trim_ws(t), rf"^[（(]{WS}*|{WS}*[)）]\z", ""), "[－—．]", "-")
    parts = F.filter(F.split(s, "[-.]"), lambda x: x != "")
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^\d+\z")), F.transform(parts, lambda x: x.try_cast("int")))


def sequence_kind(t: Column) -> Column:
    s = F.lower(trim_ws(t))
    return F.when(s.isin("figure", "fig"), "figure").when(s.isin("table", "tbl"), "table").when(s.isin("equation", "eq"), "equation")


def heading_level(outline: Column, style_name: Column) -> Column:
    s = F.lower(F.coalesce(style_name, F.lit("")))
    out = F
    for i in range(3):
        out = out.when((outline == i) | s.rlike(rf"heading{WS}*{i + 1}|标题{WS}*{i + 1}"), i)
    return out


def outline_comparable(outline: Column) -> Column:
    return F.coalesce(outline + 1, F.lit(10))


# Alignment names of the file format and those of the rules.
ALIGN = {"both": "justify", "distribute": "justify", "start": "left", "end": "right"}


def norm_align(a: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ALIGN.items() for x in kv])
    return F.coalesce(F.try_element_at(m, a), a)


def number_text(x: Column) -> Column:
    """A double as people write it: 12, not 12.0."""
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x))).otherwise(x.cast("string"))


def range_text(low: Column, high: Column, unit: str) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(number_text(low), F.lit("-"), number_text(high), F.lit(f" {unit}")))
        .when(low.isNotNull(), F.concat(F.lit("不少于 "), number_text(low), F.lit(f" {unit}")))
        .when(high.isNotNull(), F.concat(F.lit("不超过 "), number_text(high), F.lit(f" {unit}")))
        .otherwise(F.lit(f"规范{unit}数"))
    )


def percent_text(x: Column) -> Column:
    return F.concat(F.regexp_replace(F.format_string("%.2f", x * 100), r"\.?0+\z", ""), F.lit("%"))


def utf16_length(t: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


# The text forms of roles.
PATTERNS = {
    "cover": r"^(学生姓名|姓名|指导教师|导师|专业学位类别|专业名称|专业[:：]|研究方向|答辩委员会|主席|委员|授位时间|学号|分类号|密级|学校代码|论文提交日期|论文答辩日期|独创性声明|学位论文使用授权)|大学(博士|硕士)?(专业)?学位论文\z",
    "acknowledgement": r"(?i)^(致谢|鸣谢|acknowledg?ments?)\z",
    "appendix": r"(?i)^(附录[A-Z0-9一二三四五六七八九十]*|appendix[A-Z0-9-]*)\z",
    "achievement": r"^(攻读.*学位期间.*成果|攻读学位期间发表的学术成果|在学期间取得的研究成果)\z",
    "figure": rf"(?i)^(图|figure)\d+(?:[-－—.．]\d+)*[A-Za-z]*(?:{WS}|[:：（(]|\z)",
    "figure_relaxed": r"(?i)^(续?图|figure)",
    "table": rf"(?i)^(表|table)\d+(?:[-－—.．]\d+)*[A-Za-z]*(?:{WS}|[:：（(]|\z)",
    "source": r"(?i)^(资料来源|数据来源|图源|表源|source[:：]|注[:：](资料|数据|图表?)来源)",
    "equation": r"(?:\(|（)\d+(?:[-－—.．]\d+)*(?:\)|）)\z",
    "operator": r"[=+\-*/×÷≤≥≠≈∑∫√]",
    "list_marker": rf"^(?:[（(]?[0-9一二三四五六七八九十]+[）).、．.]|[①②③④⑤⑥⑦⑧⑨⑩]|[-•·●▪◆◇■□]){WS}*[^{WS_BODY}]+",
    "material": rf"^(?:材料|附件|附表|附图){WS}*[一二三四五六七八九十0-9]+(?:[:：{WS_BODY}]|\z)",
    "signature": rf"^(?:姓名|署名|作者|申请人|填表人|签名|日期|时间|地点|单位)[:：][^{WS_BODY}]{{1,40}}\z",
    "date": rf"^(?:[一-鿿]{{2,8}}{WS}*)?(?:20|19)\d{{2}}年\d{{1,2}}月\d{{1,2}}日\z",
}


def text_pattern(t: Column, name: str, cap: int | None = None) -> Column:
    hit = t.rlike(PATTERNS[name])
    # The length first: patterns without a start would walk through long texts.
    return F.when(utf16_length(t) <= cap, hit).otherwise(F.when(t.isNotNull(), False)) if cap else hit


def slugify(t: Column) -> Column:
    s = F.regexp_replace(F.lower(trim_ws(t)), r"[^a-z0-9一-鿿]+", "-")
    return F.regexp_replace(s, r"^-+|-+\z", "")


def bump_version(v: Column) -> Column:
    """The last part of the version plus one; `-1` after a last part that is no number."""
    parts = F.split(v, r"\.")
    last = F.element_at(parts, -1)
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    up = F.when(last.rlike(r"^\d+\z"), (last.try_cast("long") + 1).cast("string"))
    return F.when(up.isNull(), F.concat(v, F.lit("-1"))).when(F.size(parts) == 1, up).otherwise(F.concat(head, F.lit("."), up))


def field_descriptor(instruction: Column) -> Column:
    """Instruction → struct(type, bookmark, sequence): tokens honour quotes."""
    tokens = F.regexp_extract_all(inline_text(instruction), F.lit(rf"\"[^\"]*\"|'[^']*'|[^{WS_BODY}]+"), F.lit(0))

    def said(t: Column) -> Column:
        kind = F.upper(F.coalesce(F.get(t, F.lit(0)), F.lit("UNKNOWN")))
        arg = F.regexp_replace(F.get(t, F.lit(1)), r"^[\"']|[\"']\z", "")
        return F.struct(kind.alias("type"), F.when(kind.isin("REF", "PAGEREF"), arg).alias("bookmark"), F.when(kind == "SEQ", arg).alias("sequence"))

    return once(tokens, said)


def issue_key(*parts: Column) -> Column:
    """The parts, URI-encoded, joined by bars."""
    def enc(c):
        s = F.url_encode(F.coalesce(c.cast("string"), F.lit("")))
        for a, b in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            s = F.regexp_replace(s, a, b)
        return s

    return F.concat_ws("|", *[enc(p) for p in parts])


def locate_fragment(text: Column, fragment: Column) -> Column:
    """array<struct<start,end>>: non-overlapping occurrences of the fragment, white space ignored; offsets in the text from 0."""
    chars = F.filter(F.split(compact_text(fragment), ""), lambda c: c != "")
    pattern = F.array_join(F.transform(chars, lambda c: F.regexp_replace(c, r"([\\\^$.|?*+()\[\]{}])", r"\\$1")), f"{WS}*")
    found = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc, piece):
        a = F.instr(F.substring(text, acc["at"] + 1, F.length(text)), piece) - 1 + acc["at"]
        e = a + F.length(piece)
        return F.struct(F.concat(acc["out"], F.array(F.struct(a.alias("start"), e.alias("end")))).alias("out"), e.alias("at"))

    return F.when(F.size(chars) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.aggregate(found, start, step, lambda a: a["out"]))


def theme_font(ref: Column, major_latin: Column, major_east_asia: Column, minor_latin: Column, minor_east_asia: Column) -> Column:
    """Face that a theme reference means: major… or minor, East Asian or Latin; null without a reference."""
    low = F.lower(ref)
    major, east = low.startswith("major"), F.contains(low, F.lit("eastasia"))
    return F.when(ref.isNotNull() & (ref != ""), F.when(east, F.when(major, major_east_asia).otherwise(minor_east_asia)).otherwise(F.when(major, major_latin).otherwise(minor_latin)))


def best_fragment(text: Column, fragment: Column) -> Column:
    """struct(start, end) of the fragment if it occurs exactly once, else null."""
    found = locate_fragment(text, fragment)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))

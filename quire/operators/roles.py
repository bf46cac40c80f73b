"""Semantic roles of paragraphs: the section state machine as windows.

A document's paragraphs change the section at keyword headings; an outline
heading turns it into the body. Both are running maxima over one ordering of
each document, so the whole machine needs one exchange on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import CJK, compact_text, heading_level, inline_text, text_pattern, utf16_length

# Rule number → (role, confidence, reason), in the order in which the rules are tried.
RULES = [
    ("table_cell", "high", "表格单元格结构标记"),
    (None, "high", "空段落"),
    ("abstract_title_cn", "high", "明确章节标题关键词命中"),
    ("abstract_title_en", "high", "明确章节标题关键词命中"),
    ("toc_title", "high", "明确章节标题关键词命中"),
    ("reference_heading", "high", "明确章节标题关键词命中"),
    ("acknowledgement_heading", "high", "明确章节标题关键词命中"),
    ("appendix_heading", "high", "明确章节标题关键词命中"),
    ("achievement_heading", "high", "明确章节标题关键词命中"),
    (None, "high", "摘要前封面区跳过"),
    ("toc1", "high", "目录样式明确命中"),
    ("toc2", "high", "目录样式明确命中"),
    ("toc3", "high", "目录样式明确命中"),
    ("keywords_cn", "medium", "关键词文本模式命中"),
    ("keywords_en", "medium", "关键词文本模式命中"),
    ("appendix_subheading", "high", "附录上下文内由大纲级别或标题样式判断"),
    ("appendix_list_item", "high", "附录上下文内由自动编号判断"),
    ("appendix_list_item", "medium", "附录上下文内由清单文本模式判断"),
    ("appendix_signature", "medium", "附录上下文内由短落款或日期模式判断"),
    ("heading1", "high", "大纲级别或标题样式明确命中"),
    ("heading2", "high", "大纲级别或标题样式明确命中"),
    ("heading3", "high", "大纲级别或标题样式明确命中"),
    ("figure_caption", "high", "drawing 邻接结构信号支持图题注判断"),
    ("figure_caption", "low", "仅按文本题注模式判断"),
    ("table_caption", "low", "仅按文本题注模式判断"),
    ("source_note", "low", "仅按资料来源文本模式判断"),
    ("formula_line", "high", "OMML 或嵌入对象结构信号支持公式行判断"),
    ("formula_line", "low", "仅按文本公式编号模式判断"),
    ("abstract_body_cn", "high", "由明确章节上下文判断"),
    ("abstract_body_en", "high", "由明确章节上下文判断"),
    (None, "high", "由明确章节上下文判断"),
    ("reference_body", "high", "由明确章节上下文判断"),
    ("acknowledgement_body", "high", "由明确章节上下文判断"),
    ("appendix_body", "high", "由明确章节上下文判断"),
    ("achievement_body", "high", "由明确章节上下文判断"),
    (None, "medium", "疑似封面字段，跳过正文规则"),
    ("body_text", "high", "由正文标题上下文判断"),
]
# Sections, numbered as their headings are from rule 2 on; 7 is the body.
SECTIONS = ["cn_abstract", "en_abstract", "toc", "references", "acknowledgement", "appendix", "achievement", "body", "cover"]
BODY, COVER, APPENDIX = 7, 8, 5
_HEAD, _TOC, _KEY, _APP, _OUTLINE, _SPECIAL, _PLAIN = 2, 10, 13, 15, 19, 22, 28


def special_rule(near: Column) -> Column:
    """Rule number of a caption, note or formula in the body, null if none; near: a drawing is next to it.

    Reads _inline (text with single spaces) and _inline_len.
    """
    t, align, n = F.col("_inline"), F.col("alignment"), F.col("_inline_len")
    no = F.lit(False)
    short = lambda name, cap: F.when(n <= cap, text_pattern(t, name)).otherwise(no)
    structure = (F.coalesce("math_count", F.lit(0)) > 0) | (F.coalesce("object_count", F.lit(0)) > 0)
    apart = F.coalesce(align.isin("center", "right"), no) | (n <= 80)
    formula = F.when(apart, text_pattern(t, "equation") & (structure | text_pattern(t, "operator")) & (F.regexp_count(t, F.lit(CJK)) <= 4)).otherwise(no)
    return (
        F.when(near & short("figure_relaxed", 80) & align.isin("center", "left", "right"), _SPECIAL)
        .when(short("figure", 80), F.when(near, _SPECIAL).otherwise(_SPECIAL + 1))
        .when(short("table", 80), _SPECIAL + 2)
        .when(short("source", 120), _SPECIAL + 3)
        .when(formula, F.when(structure, _SPECIAL + 4).otherwise(_SPECIAL + 5))
    )


def appendix_rule(t: Column, level: Column) -> Column:
    """Rule number within an appendix, null if none; t: compact text, its length in _len."""
    numbered = F.col("num_id").isNotNull() & F.col("ilvl").isNotNull()
    return (
        F.when(level.isNotNull() & (F.col("_len") <= 80), _APP)
        .when(numbered, _APP + 1)
        .when(text_pattern(t, "list_marker") | text_pattern(t, "material"), _APP + 2)
        .when(F.when(F.col("_len") <= 50, text_pattern(t, "signature") | text_pattern(t, "date")).otherwise(F.lit(False)), _APP + 3)
    )


def heading_section(t: Column) -> Column:
    """Number of the section that a keyword heading (compact text) opens, else null."""
    return (
        F.when(t == "摘要", 0)
        .when(t.rlike(r"(?i)^abstract\z"), 1)
        .when(t == "目录", 2)
        .when(t == "参考文献", 3)
        .when(text_pattern(t, "acknowledgement"), 4)
        .when(text_pattern(t, "appendix"), 5)
        .when(text_pattern(t, "achievement"), 6)
    )


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), at)


def classify_roles(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_index, text, in_table, style_id, style_name, outline_level, alignment, num_id, ilvl and the three counts
    → the same rows with role, confidence, reason, section."""
    w = Window.partitionBy("doc_id").orderBy("para_index")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    p = paragraphs.withColumn("_t", compact_text(F.col("text"))).withColumn("_act", ~F.col("in_table") & (F.col("_t") != ""))
    # Worked out once: many patterns look at these. A caption or note is short, a formula may be long if it stands apart.
    p = p.withColumn("_len", utf16_length(F.col("_t")))
    p = p.withColumn("_inline", F.when((F.col("_len") <= 120) | F.col("alignment").isin("center", "right"), inline_text(F.col("text"))))
    p = p.withColumn("_inline_len", utf16_length(F.col("_inline")))
    p = p.withColumn("_level", heading_level(F.col("outline_level"), F.col("style_name")))
    toc = F.lower(F.coalesce("style_id", F.lit("")))
    p = p.withColumns(
        {
            "_head": F.when(F.col("_act"), heading_section(F.col("_t"))),
            "_toc": F.when(toc == "toc1", 0).when(toc == "toc2", 1).when(toc == "toc3", 2),
            "_key": F.when(F.col("_t").rlike("^关键词"), 0).when(F.col("_t").rlike("(?i)^keywords"), 1),
            "_prev": F.lag("drawing_count").over(w),
            "_next": F.lead("drawing_count").over(w),
        }
    )
    p = p.withColumns(
        {
            "_sec": F.coalesce(F.last("_head", ignorenulls=True).over(upto), F.lit(COVER)),
            "_at": F.max(F.when(F.col("_head").isNotNull(), F.col("para_index"))).over(upto),
            "_near": (F.coalesce("_prev", F.lit(0)) > 0) | (F.coalesce("_next", F.lit(0)) > 0),
        }
    )
    plain = F.col("_act") & F.col("_head").isNull() & (F.col("_sec") != COVER) & F.col("_toc").isNull() & F.col("_key").isNull() & F.col("_level").isNotNull()
    p = p.withColumn("_app", F.when(F.col("_sec") == APPENDIX, appendix_rule(F.col("_t"), F.col("_level"))))
    # In an appendix its own roles come before the outline. Once an outline heading has led into the
    # body, further ones before the next keyword heading change nothing.
    p = p.withColumn("_esc", plain & ~((F.col("_sec") == APPENDIX) & F.col("_app").isNotNull()))
    p = p.withColumn("_out", F.max(F.when(F.col("_esc"), F.col("para_index"))).over(before))
    p = p.withColumn("_now", F.when(F.col("_head").isNull() & (F.col("_out") > F.col("_at")), BODY).otherwise(F.col("_sec")))
    now = F.col("_now")
    p = p.withColumn("_special", F.when(now == BODY, special_rule(F.col("_near"))))
    rule = (
        F.when(F.col("in_table"), 0)
        .when(F.col("_t") == "", 1)
        .when(F.col("_head").isNotNull(), F.col("_head") + _HEAD)
        .when(now == COVER, 9)
        .when(F.col("_toc").isNotNull(), F.col("_toc") + _TOC)
        .when(F.col("_key").isNotNull(), F.col("_key") + _KEY)
        .when((now == APPENDIX) & F.col("_app").isNotNull(), F.col("_app"))
        .when(F.col("_level").isNotNull(), F.col("_level") + _OUTLINE)
        .when(F.col("_special").isNotNull(), F.col("_special"))
        .when(now != BODY, now + _PLAIN)
        .when(F.when(F.col("_len") < 25, text_pattern(F.col("_t"), "cover")).otherwise(F.lit(False)), 35)
        .otherwise(36)
    )
    p = p.withColumn("_rule", rule)
    # A heading that leads into the body is itself in the body.
    section = _pick(SECTIONS, F.when(F.col("_esc"), BODY).otherwise(now))
    out = {n: _pick([r[i] for r in RULES], F.col("_rule")) for i, n in enumerate(("role", "confidence", "reason"))}
    return p.withColumns(out | {"section": section}).select(*paragraphs.columns, "role", "confidence", "reason", "section")

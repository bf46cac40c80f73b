"""Reports over issue tables: filters, orders, groups, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import inline_text, issue_key
from quire.operators.references import neighbours, numbered
from quire.operators.style_checks import small

# Severities by rank.
SEVERITIES = ["error", "warn", "info"]


# Role → label, in report order.
ROLE_LABELS = {
    "heading": "标题（通用）",
    "unknown": "未识别",
    "abstract_title_cn": "中文摘要标题",
    "abstract_body_cn": "中文摘要正文",
    "keywords_cn": "中文关键词",
    "abstract_title_en": "英文摘要标题",
    "abstract_body_en": "英文摘要正文",
    "keywords_en": "英文关键词",
    "toc_title": "目录标题",
    "toc1": "一级目录项",
    "toc2": "二级目录项",
    "toc3": "三级目录项",
    "heading1": "一级标题",
    "heading2": "二级标题",
    "heading3": "三级标题",
    "body_text": "正文",
    "figure_caption": "图题注",
    "table_caption": "表题注",
    "source_note": "资料来源",
    "formula_line": "公式行",
    "reference_heading": "参考文献标题",
    "reference_body": "参考文献正文",
    "acknowledgement_heading": "致谢标题",
    "acknowledgement_body": "致谢正文",
    "appendix_heading": "附录标题",
    "appendix_subheading": "附录小标题",
    "appendix_list_item": "附录清单",
    "appendix_signature": "附录落款",
    "appendix_body": "附录正文",
    "achievement_heading": "成果标题",
    "achievement_body": "成果正文",
    "back_matter_heading": "后置部分标题（旧规则兼容）",
    "back_matter_body": "后置部分正文（旧规则兼容）",
    "table_cell": "表格单元格",
}


# Labels of reports, in the order in which their groups come.
SEVERITY_LABELS = {"error": "错误", "warn": "警告", "info": "提示"}
SECTION_LABELS = {
    "cn_abstract": "中文摘要", "en_abstract": "英文摘要", "toc": "目录", "body": "正文", "references": "参考文献",
    "acknowledgement": "致谢", "appendix": "附录", "achievement": "成果", "back_matter": "后置部分", "document": "文档级",
}
ROLE_ORDER = [
    "unknown", "heading", "abstract_title_cn", "abstract_body_cn", "keywords_cn", "abstract_title_en", "abstract_body_en", "keywords_en", "toc_title", "toc1", "toc2", "toc3", "heading1", "heading2", "heading3", "body_text",
    "figure_caption", "table_caption", "source_note", "formula_line", "table_cell", "reference_heading", "reference_body", "acknowledgement_heading", "acknowledgement_body", "appendix_heading", "appendix_subheading",
    "appendix_list_item", "appendix_signature", "appendix_body", "achievement_heading", "achievement_body", "back_matter_heading", "back_matter_body", "document",
]
#: Roles whose label differs in reports.
REPORT_LABELS = {"document": "文档设置", "toc1": "目录一级条目", "toc2": "目录二级条目", "toc3": "目录三级条目", "formula_line": "公式编号行", "back_matter_heading": "后置章节标题", "back_matter_body": "后置章节正文", "table_cell": "表格段落"}
FIELD_LABELS = {
    "font_east_asia": "中文字体", "font_latin": "西文字体", "size_pt": "字号", "bold": "加粗", "alignment": "对齐", "line_spacing_pt": "行距", "spacing_before_pt": "段前距", "spacing_after_pt": "段后距",
    "first_line_indent_chars": "首行缩进", "hanging_indent_chars": "悬挂缩进", "left_indent_chars": "左缩进", "outline_level": "大纲级别", "paper_size": "纸张", "margin_top_cm": "上边距", "margin_bottom_cm": "下边距",
    "margin_left_cm": "左边距", "margin_right_cm": "右边距", "header_distance_cm": "页眉距", "footer_distance_cm": "页脚距", "gutter_cm": "装订线", "page_number_front": "前置部分页码", "page_number_body": "正文页码",
    "page_number_alignment": "页码位置", "page_number_font_latin": "页码西文字体", "page_number_size_pt": "页码字号", "header_text": "页眉内容", "header_font_east_asia": "页眉中文字体", "header_font_latin": "页眉西文字体",
    "header_size_pt": "页眉字号", "header_bottom_border": "页眉线", "caption_reference": "交叉引用", "keywords_cn_count": "中文关键词数量", "keywords_en_count": "英文关键词数量", "abstract_cn_chars": "中文摘要字数",
    "abstract_en_words": "英文摘要词数", "references_count": "参考文献条数", "references_foreign_fraction": "外文参考文献占比",
}
#: Longest text of a source that a checklist quotes.
SOURCE_CHARS = 48
NO_NAME = "当前文档"


def label_of(labels: dict[str, str], key):
    """Label of a key; unknown ones print as themselves."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key), key)


def report_role_label(role):
    return label_of(ROLE_LABELS | REPORT_LABELS, role)


def section_of(role):
    """The report section of a role: the name's beginning tells it, all else is the body."""
    starts = lambda *xs: F.coalesce(role.rlike("^(" + "|".join(xs) + ")"), F.lit(False))
    cn, en = (F.coalesce(role.rlike(f"^(abstract_|keywords_).*{x}$"), F.lit(False)) for x in ("cn", "en"))
    out = F.when(cn, "cn_abstract").when(en, "en_abstract").when(starts("toc"), "toc").when(starts("reference_"), "references")
    for name in ("acknowledgement", "appendix", "achievement", "back_matter"):
        out = out.when(starts(f"{name}_"), name)
    return out.when(role == "document", "document").otherwise("body")


def group_of(by: str):
    """(key, label, rank) of issues by section, role, severity or field; fields have no fixed order."""
    key = {"section": section_of(F.col("role")), "role": F.col("role"), "severity": F.col("severity"), "field": F.col("field")}[by]
    labels = {"section": SECTION_LABELS, "role": ROLE_LABELS | REPORT_LABELS, "severity": SEVERITY_LABELS, "field": FIELD_LABELS}[by]
    order = {"section": list(SECTION_LABELS), "role": ROLE_ORDER, "severity": SEVERITIES, "field": []}[by]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), key) if order else F.lit(0).cast("long")
    return key, label_of(labels, key), rank


def role_label(role):
    """Label of a role; unknown roles print as themselves."""
    m = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, role), role)


def severity_rank():
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)


def para_rank():
    """Document issues (index -1) come last."""
    return F.when(F.col("para_index") < 0, 2147483647).otherwise(F.col("para_index"))


def report_order(by: str = "paragraph") -> list:
    first = [para_rank(), severity_rank()] if by == "paragraph" else [severity_rank(), para_rank()]
    return [*first, F.col("role"), F.col("field"), F.col("message")]


def filter_severity(issues: DataFrame, keep: list[str]) -> DataFrame:
    return issues.where(F.col("severity").isin(keep))


def navigable(issues: DataFrame) -> DataFrame:
    return issues.where("para_index >= 0")


def sort_issues(issues: DataFrame, by: str = "paragraph") -> DataFrame:
    """issues with their report position within the document."""
    w = Window.partitionBy("doc_id").orderBy(*report_order(by))
    return issues.withColumn("position", F.row_number().over(w))


def first_issue(issues: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Of each document the issue that keys(doc_id, issue_key) names, else the first navigable one, else the first; with keys, issues have an issue_key."""
    own = issues
    if keys is not None:
        asked = keys.select("doc_id", "issue_key").distinct().withColumn("_asked", F.lit(0))
        own = issues.hint("merge").join(asked, ["doc_id", "issue_key"], "left")
    asked = F.coalesce("_asked", F.lit(1)) if keys is not None else F.lit(1)
    order = F.struct(asked.alias("k"), (F.col("para_index") < 0).alias("a"), para_rank().alias("p"), severity_rank().alias("s"), "role", "field", "message")
    rest = [c for c in issues.columns if c != "doc_id"]
    return own.groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("x")).select("doc_id", "x.*")


def paragraph_issue_pick(issues: DataFrame) -> DataFrame:
    """One issue a paragraph: the most severe, then report order."""
    order = F.struct(severity_rank().alias("s"), "role", "field", "message")
    rest = [c for c in issues.columns if c not in ("doc_id", "para_index")]
    return navigable(issues).groupBy("doc_id", "para_index").agg(F.min_by(F.struct(*rest), order).alias("x")).select("doc_id", "para_index", "x.*")


def report_groups(issues: DataFrame, by: str) -> DataFrame:
    """Issues of each document by section, role, severity or field: key, label and rank of the group, number and messages in report order."""
    key, label, rank = group_of(by)
    items = F.array_sort(F.collect_list(F.struct(para_rank().alias("p"), severity_rank().alias("s"), "role", "field", "message")))
    return issues.groupBy("doc_id", key.alias("key"), label.alias("label"), rank.alias("rank")).agg(F.count("*").alias("n"), F.transform(items, lambda x: x["message"]).alias("messages"))


#: Collation of labels of groups that have no fixed order: by sound, as Chinese readers sort them.
LABEL_ORDER = "zh_Hans_CHN"


def ordered_groups(issues: DataFrame, by: str, sort_by: str = "paragraph") -> DataFrame:
    """report_groups with the group's position in the document's report; issues of a group by paragraph, then severity, or the other way round.

    Sections, roles and severities have a fixed order, fields go by their
    labels in Chinese collation; keys without a place come last, by name.
    """
    if sort_by not in ("paragraph", "severity"):
        raise ValueError(f"issues are sorted by paragraph or severity, not by {sort_by}")
    key, label, rank = group_of(by)
    first = [para_rank().alias("a"), severity_rank().alias("b")]
    items = F.array_sort(F.collect_list(F.struct(*(first if sort_by == "paragraph" else first[::-1]), "role", "field", "message")))
    g = issues.groupBy("doc_id", key.alias("key"), label.alias("label"), F.when(rank > 0, rank).when(F.lit(by == "field"), 0).otherwise(1 << 31).alias("_rank"))
    g = g.agg(F.count("*").alias("n"), F.transform(items, lambda x: x["message"]).alias("messages"))
    w = Window.partitionBy("doc_id").orderBy("_rank", F.collate("label", LABEL_ORDER), "key")
    return g.select("doc_id", F.row_number().over(w).alias("position"), "key", "label", "n", "messages")


def summary_sets(issues: DataFrame) -> DataFrame:
    """Counts of issues by document and severity, by document and field, by severity, by field, and of all: one aggregate; columns that a row sums over are null.

    level: `document_severity`, `document_field`, `severity`, `field`, `all`; a
    null severity or field counts as ``unknown``.
    """
    i = issues.select("doc_id", F.coalesce("severity", F.lit("unknown")).alias("severity"), F.coalesce("field", F.lit("unknown")).alias("field"))
    g = i.groupingSets([["doc_id", "severity"], ["doc_id", "field"], ["severity"], ["field"], []], "doc_id", "severity", "field").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    names = {1: "document_severity", 2: "document_field", 5: "severity", 6: "field", 7: "all"}
    level = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("_g").cast("int"))
    return g.where("_g <> 7 or n > 0").select(level.alias("level"), "doc_id", "severity", "field", "n")


def observed(issues: DataFrame):
    """(issues, observation): once the returned issues are written, the observation has their number, and that of each severity and of other severities, counted in the same job."""
    from pyspark.sql import Observation

    seen = Observation()
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    other = F.count_if(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).alias("other")
    return issues.observe(seen, F.count(F.lit(1)).alias("n"), *counts, other), seen


def issue_targets(issues: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Of each paragraph with issues and a text: the keys of its issues in report order, its text, the nearest texts before and after it, and how many equal ones come before."""
    k = issue_key(F.col("para_index"), F.col("role"), F.col("field"), F.col("severity"), F.col("message"))
    items = F.array_sort(F.collect_list(F.struct(severity_rank().alias("s"), "role", "field", k.alias("k"))))
    own = navigable(issues).groupBy("doc_id", "para_index").agg(F.transform(items, lambda x: x["k"]).alias("keys"))
    at = ["doc_id", "para_index"]
    text = numbered(neighbours(paragraphs.select(*at, "text"))).where("text <> ''")
    return own.hint("merge").join(text, at)


def report_top_n(issues: DataFrame, k: int) -> DataFrame:
    return sort_issues(issues).where(F.col("position") <= k)


def summarize_issues(issues: DataFrame) -> DataFrame:
    by = issues.groupBy("doc_id", "role").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    pairs = F.array_sort(F.collect_list(F.concat(F.col("role"), F.lit("="), F.col("n").cast("string"))))
    return by.groupBy("doc_id").agg(*[F.sum(s).alias(s) for s in SEVERITIES], F.array_join(pairs, ",").alias("by_role"))


def report_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("doc_id").agg(F.count("*").alias("paragraph_count"), F.count("role").alias("classified_count"))


def sink_checklist(issues: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A plain-text list a document: severity, place, role and field, then problem, fragment, hint and source of every issue; names(doc_id, file_name)."""
    has = lambda c: F.col(c) if c in issues.columns else F.lit(None).cast("string")
    line = lambda c: inline_text(c)
    s = sort_issues(issues)
    place = F.when(F.col("para_index") < 0, "文档级问题").otherwise(F.concat(F.lit("第 "), (F.col("para_index") + 1).cast("string"), F.lit(" 段")))
    head = F.concat(F.col("position").cast("string"), F.lit(". ["), label_of(SEVERITY_LABELS, F.col("severity")), F.lit("] "), place, F.lit(" · "), report_role_label(F.col("role")), F.lit(" · "), label_of(FIELD_LABELS, F.col("field")))
    piece = F.coalesce(line(has("affected_text")), line(has("text_preview")))
    source = line(has("provenance"))
    quoted = F.when(F.length(source) > SOURCE_CHARS, F.concat(F.substring(source, 1, SOURCE_CHARS), F.lit("..."))).otherwise(source)
    said = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    text = F.concat_ws("\n", head, F.concat(F.lit("问题："), line(F.col("message"))), said("片段：", F.when(F.coalesce(piece, F.lit("")) != "", F.concat(F.lit("“"), piece, F.lit("”")))), said("建议：", line(has("suggestion"))), said("依据：", quoted))
    items = F.array_sort(F.collect_list(F.struct("position", text.alias("t"))))
    g = s.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n").alias("_list"))
    if names is not None:
        g = g.hint("merge").join(names.select("doc_id", "file_name"), "doc_id", "left")
    name = F.coalesce(F.nullif(line(F.col("file_name")), F.lit("")), F.lit(NO_NAME)) if names is not None else F.lit(NO_NAME)
    return g.select("doc_id", F.concat(F.lit("《"), name, F.lit("》修改清单\n\n"), "_list").alias("checklist"))


def latest_run_wins(results: DataFrame) -> DataFrame:
    """results(doc_id, library_id, run_id, …) → the newest of each document and library."""
    rest = [c for c in results.columns if c not in ("doc_id", "library_id")]
    return results.groupBy("doc_id", "library_id").agg(F.max_by(F.struct(*rest), "run_id").alias("x")).select("doc_id", "library_id", "x.*")


def align_blocks(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_index, text, occurrence) to blocks (doc_id, block_index, text, occurrence) of another rendering: equal text, then the nearest occurrence."""
    # Both sides in one order of occurrences: the nearest block before and after each paragraph, without all pairs of equal texts.
    b = blocks.groupBy("doc_id", "text", "occurrence").agg(F.min("block_index").alias("block_index"))
    both = paragraphs.select("doc_id", "text", "occurrence", "para_index", F.lit(None).cast("struct<o:long,b:long>").alias("here")).unionByName(
        b.select("doc_id", "text", "occurrence", F.lit(None).cast("int").alias("para_index"), F.struct(F.col("occurrence").cast("long").alias("o"), F.col("block_index").cast("long").alias("b")).alias("here"))
    )
    w = Window.partitionBy("doc_id", "text").orderBy("occurrence")
    near = lambda pick, frame: pick("here", ignorenulls=True).over(frame)
    both = both.withColumn("_low", near(F.last, w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_high", near(F.first, w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    to = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.o") - F.col("occurrence")).alias("d"), F.col(f"{c}.b").alias("b")))
    out = both.where("para_index is not null and (_low is not null or _high is not null)")
    return out.select("doc_id", "para_index", F.least(to("_low"), to("_high"))["b"].alias("block_index"))


def attach_confidence(issues: DataFrame, roles: DataFrame, more: list[str] = []) -> DataFrame:
    """issues with the confidence and reason of their paragraph's role, and more of its columns."""
    r = roles.select("doc_id", "para_index", *more, F.col("confidence").alias("role_confidence"), F.col("reason").alias("role_confidence_reason"))
    return issues.hint("merge").join(r, ["doc_id", "para_index"], "left")


def provenance_lookup(issues: DataFrame, role_keys: DataFrame, field_keys: DataFrame, provenance: DataFrame) -> DataFrame:
    """issues with the source text of their role, else of their field; provenance(key, text): blank texts don't count."""
    p = provenance.where(F.trim("text") != "").select("key", F.trim("text").alias("_t"))
    r = role_keys.join(small(p), "key").select("role", F.col("_t").alias("_r"))
    f = field_keys.join(small(p), "key").select("field", F.col("_t").alias("_f"))
    return issues.join(small(r), "role", "left").join(small(f), "field", "left").withColumn("provenance", F.coalesce("_r", "_f")).drop("_r", "_f")

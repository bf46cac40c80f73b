"""All checks of a corpus as one issue table, in a fixed order of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import preview24
from quire.operators import numbering as N
from quire.operators import page as P
from quire.operators import references as X
from quire.operators import report as RP
from quire.operators import roles as R
from quire.operators import statistics as S
from quire.operators import style_checks as C
from quire.sources.tables import clustered
from quire.sources.word import Word

ISSUE = ["doc_id", "check_seq", "para_index", "role", "field", "actual", "severity", "message"]
MORE = {"expected": "string", "target": "string", "start_run": "int", "end_run": "int", "affected_text": "string"}

# Field → (whether a tool can mend it, hint); {target}: what the rule asks for, {part}: paragraph or run, {expected}, {actual}.
HINTS = {
    "font_east_asia": ("auto", "请将{part}中文字体设为 {target}"),
    "font_latin": ("auto", "请将{part}西文字体设为 {target}"),
    "size_pt": ("auto", "请将{part}字号调整为 {target}"),
    "bold": ("auto", "请将该段落设为 {target}"),
    "alignment": ("auto", "请将该段落对齐方式改为 {target}"),
    "spacing_before_pt": ("auto", "请将该段落段前间距设为 {target}"),
    "spacing_after_pt": ("auto", "请将该段落段后间距设为 {target}"),
    "first_line_indent_chars": ("auto", "请将该段落首行缩进设为 {target}"),
    "hanging_indent_chars": ("auto", "请将该段落悬挂缩进设为 {target}"),
    "left_indent_chars": ("auto", "请将该段落左缩进设为 {target}"),
    "outline_level": ("auto", "请调整该段落的大纲级别，使其符合规范层级"),
    "paper_size": ("manual", "请在页面设置中将纸张大小设为 {target}"),
    "page_number_front": ("manual", "请将前置部分页码格式设为 {target}（通常需在分节符处单独设置）"),
    "page_number_body": ("manual", "请将正文页码设为 {target}，并在正文起始分节处重新编号"),
    "page_number_alignment": ("manual", "请将页码位置设为 {target}"),
    "page_number_font_latin": ("manual", "请将页码西文字体设为 {target}"),
    "page_number_size_pt": ("manual", "请将页码字号设为 {target}"),
    "header_text": ("manual", "请在页眉中加入文字「{expected}」"),
    "header_font_east_asia": ("manual", "请将页眉中文字体设为 {target}"),
    "header_font_latin": ("manual", "请将页眉西文字体设为 {target}"),
    "header_size_pt": ("manual", "请将页眉字号设为 {target}"),
    "header_bottom_border": ("manual", "请在页眉段落下方设置符合规范的下边框线"),
    "keywords_cn_count": ("manual", "请将中文关键词调整为 {target}，并使用规范分隔符分隔"),
    "keywords_en_count": ("manual", "请将英文关键词调整为 {target}，并使用规范分隔符分隔"),
    "abstract_cn_chars": ("manual", "请扩充或压缩中文摘要，使字数达到 {target}"),
    "abstract_en_words": ("manual", "请扩充或压缩英文摘要，使词数达到 {target}"),
    "references_count": ("manual", "请补充参考文献，使条数达到 {target}"),
    "references_foreign_fraction": ("manual", "请补充外文参考文献，使占比达到 {target}"),
    "note_reference": ("manual", "请在 Word 中检查该脚注/尾注引用，补回对应定义或删除失效引用后再更新注释编号"),
    "note_definition": ("manual", "请核对这些脚注/尾注定义是否仍需保留；若正文已无引用，请删除孤立注释或重新插入引用"),
    "margin_top_cm": ("manual", "请在页面设置中将上边距设为 {target}"),
    "margin_bottom_cm": ("manual", "请在页面设置中将下边距设为 {target}"),
    "margin_left_cm": ("manual", "请在页面设置中将左边距设为 {target}"),
    "margin_right_cm": ("manual", "请在页面设置中将右边距设为 {target}"),
    "header_distance_cm": ("manual", "请在页面设置中将页眉距边界设为 {target}"),
    "footer_distance_cm": ("manual", "请在页面设置中将页脚距边界设为 {target}"),
    "gutter_cm": ("manual", "请在页面设置中将装订线设为 {target}"),
}
LINE_HINTS = {True: ("auto", "请将该段落行距改为固定值 {target}"), False: ("manual", "当前行距为 {actual}，请人工核对排版后将其设为固定值 {target}")}
REFERENCE_HINTS = {
    True: ("manual", "请在 Word 中更新该交叉引用，改为指向现有图/表/公式题注，或补回对应书签后再更新域"),
    False: ("manual", "请核对该交叉引用的目标，确保它指向图/表/公式题注而不是普通书签"),
}
OTHER_HINT = ("manual", "请根据规范要求将该项调整为 {target}")


def issue_row(df: DataFrame, seq: int, severity: str | None = None, more: bool = False) -> DataFrame:
    """One uniform issue row: checks of whole documents have index -1 and the role `document`. more: with the columns of MORE too."""
    has = df.columns
    c = {
        "check_seq": F.lit(seq),
        "para_index": F.col("para_index") if "para_index" in has else F.lit(-1),
        "role": F.coalesce("role", F.lit("unknown")) if "role" in has else F.lit("document"),
        "actual": F.col("actual") if "actual" in has else F.lit(None).cast("string"),
        "severity": F.col("severity") if "severity" in has else F.lit(severity),
        "message": F.col("message") if "message" in has else F.concat(F.col("field"), F.lit(": "), F.coalesce("expected", F.lit(""))),
    }
    rest = [(F.col(n) if n in has else F.lit(None)).cast(t).alias(n) for n, t in MORE.items()] if more else []
    return df.select("doc_id", *[c[k].alias(k) if k in c else F.col(k) for k in ISSUE[1:]], *rest)


def target_of(field: Column, expected: Column) -> Column:
    """An expected value that is no rule, as hints say it."""
    return F.concat(expected, F.when(field.endswith("_cm"), "cm").when(field.endswith("_pt"), "pt").when(field.endswith("_indent_chars"), " 字符").otherwise(""))


def fix_hint(issues: DataFrame) -> DataFrame:
    """issues(field, expected, target, actual, start_run) with suggestion and fixability: a table by field, no join."""
    field, actual = F.col("field"), F.coalesce("actual", F.lit(""))
    hint = lambda h: F.struct(F.lit(h[0]).alias("fixability"), F.lit(h[1]).alias("text"))
    table = F.create_map(*[x for k, h in HINTS.items() for x in (F.lit(k), hint(h))])
    pick = (
        F.when(field == "line_spacing_pt", F.when(actual.endswith("pt"), hint(LINE_HINTS[True])).otherwise(hint(LINE_HINTS[False])))
        .when(field == "caption_reference", F.when(F.contains(actual, F.lit("不存在")), hint(REFERENCE_HINTS[True])).otherwise(hint(REFERENCE_HINTS[False])))
        .otherwise(F.coalesce(F.try_element_at(table, field), hint(OTHER_HINT)))
    )
    part = F.when(F.col("start_run").isNull(), "该段落").otherwise("该文本片段")
    said = F.col("_hint.text")
    for name, value in (("{target}", F.coalesce("target", target_of(field, F.col("expected")), F.lit("规范值"))), ("{part}", part), ("{expected}", F.coalesce("expected", F.lit(""))), ("{actual}", actual)):
        said = F.replace(said, F.lit(name), value)
    return issues.withColumn("_hint", pick).withColumn("fixability", F.col("_hint.fixability")).withColumn("suggestion", said).drop("_hint")


def _found(word: Word, rules: DataFrame, page_rules: dict, number_rules: dict, header_rules: dict, stats: dict, keep) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The classified paragraphs, the issues of documents, and those of paragraphs."""
    # Paragraphs with a role are classified and kept already.
    roles = word.paragraphs if "role" in word.paragraphs.columns else keep(R.classify_roles(word.paragraphs))
    named = roles.select("doc_id", "para_index", "role", "text")
    described = X.described(word.fields)
    numbers = X.captions(named, described)
    counted = S.check_statistics(S.document_counts(named), stats)
    issue = lambda df, seq, severity=None: issue_row(df, seq, severity, more=True)
    whole = [
        issue(P.check_page_setup(word.sections, page_rules), 1, "error"),
        issue(P.check_page_numbers(word.documents, word.sections, number_rules), 2, "error"),
        issue(P.check_header_footer(word.documents, word.tokens, header_rules), 3),
        *([] if counted is None else [issue(counted, 9)]),
    ]
    placed = [
        issue(C.check_fields(roles, word.runs, rules).withColumnRenamed("shown", "actual"), 10),
        issue(N.check_heading_sequence(roles), 4),
        issue(N.check_caption_sequence(roles, numbers, "figure"), 5),
        issue(N.check_caption_sequence(roles, numbers, "table"), 6),
        issue(X.check_references(X.caption_graph(named, described, word.bookmarks)), 7),
        issue(X.check_notes(word.note_refs, word.note_defs, named), 8),
    ]
    return roles, whole, placed


def found_issues(word: Word, rules: DataFrame, page_rules: dict, number_rules: dict, header_rules: dict, stats: dict, keep=lambda df: clustered(df, "roles")) -> DataFrame:
    """The issues of validate_corpus() without the confidence of roles, previews and hints: enough for counts, and no issue is moved for them."""
    _, whole, placed = _found(word, rules, page_rules, number_rules, header_rules, stats, keep)
    return reduce(DataFrame.unionByName, whole + placed)


def validate_corpus(word: Word, rules: DataFrame, page_rules: dict, number_rules: dict, header_rules: dict, stats: dict, keep=lambda df: clustered(df, "roles"), sources: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Issues of all documents; `check_seq` keeps the order of the checks.

    keep(roles) writes the classified paragraphs and reads them back, since
    many checks read them; in buckets of doc_id, so that the windows over
    headings and captions and the counts need no exchange. Paragraphs that have
    a role already are taken as they are. Issues of paragraphs have the
    confidence of their role, all have a hint. sources(role_keys, field_keys,
    provenance) give each issue the text that its rule comes from.
    """
    roles, whole, placed = _found(word, rules, page_rules, number_rules, header_rules, stats, keep)
    about = roles.select("doc_id", "para_index", "confidence", "reason", preview24(F.col("text")).alias("text_preview"))
    # Issues of fields are most of all and stand where their paragraphs do: they meet them on their own, not after a union, which deals out all rows anew.
    first, *rest = placed
    all_ = [RP.attach_confidence(first, about, ["text_preview"]), RP.attach_confidence(reduce(DataFrame.unionByName, rest), about, ["text_preview"])]
    bare = {c: F.lit(None).cast("string") for c in ("text_preview", "role_confidence", "role_confidence_reason")}
    hinted = fix_hint(reduce(DataFrame.unionByName, [*all_, *[x.withColumns(bare) for x in whole]]))
    return hinted if sources is None else RP.provenance_lookup(hinted, *sources)

"""Rule proposals from samples: value frequencies by (scope, role, field)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import has_cjk, has_latin, norm_align, number_text, outline_comparable, preview24
from quire.functions.units import js_round, twips_to_cm
from quire.operators.report import role_label
from quire.operators.style_checks import small

# What a proposal's confidence means.
HINTS = ["样本过少，仅供人工参考", "主值集中，可直接进入草稿复核", "存在少量冲突，建议接受后结合原文抽查", "覆盖不足或冲突偏多，建议先检查样本质量与角色识别"]


#: JSON text of a value, so that texts, numbers and truths sort as one kind of key.
def json_text(s, n, b):
    return F.coalesce(F.concat(F.lit('"'), s, F.lit('"')), number_text(n), F.when(b, "true").when(~b, "false"))


def summarize_samples(samples: DataFrame, scope: list[str], order: list[str] | None = None) -> DataFrame:
    """samples(scope…, role, field_key, value_key, total, at) → one proposal a (scope, role, field).

    value_key: JSON text of the value; total: how many could have had one; at:
    place of the sample. The most frequent value wins, ties by key order. With
    order, samples(…, preview) also give _top, the first five samples of the
    value in that order: with_evidence then needs the samples no more.
    """
    keys = [*scope, "role", "field_key"]
    top = []
    if order is not None:
        samples = samples.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "value_key").orderBy(*order)))
        top = [F.array_sort(F.collect_list(F.when(F.col("_place") <= 5, F.struct(F.col("_place").alias("rank"), "at", "preview")))).alias("_top")]
    per = samples.groupBy(*keys, "value_key").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.min("at").alias("first_at"), *top)
    w = Window.partitionBy(*keys)
    ranked = per.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.collate("value_key", "UNICODE"))))
    g = ranked.groupBy(*keys).agg(
        F.max_by("value_key", F.when(F.col("rank") == 1, 1)).alias("value"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("sample_count"),
        F.sum("n").alias("observed_count"),
        F.max("total").alias("total_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "value_key", "n")))), lambda x: F.concat(x["value_key"], F.lit("×"), x["n"].cast("string"))).alias("conflicts"),
        *([] if order is None else [F.max_by("_top", F.when(F.col("rank") == 1, 1)).alias("_top")]),
    )
    n, seen, total = F.col("sample_count"), F.col("observed_count"), F.col("total_count")
    g = g.withColumn("coverage", F.when(total > 0, js_round(n / total, 2)).otherwise(0.0))
    # The rounded coverage enters the confidence.
    g = g.withColumn("confidence", js_round((n / seen * 0.7 + F.col("coverage") * 0.3) * (F.least(F.lit(1.0), seen / 5) * 0.4 + 0.6), 2))
    hint = (
        F.when(total < 2, HINTS[0])
        .when((F.col("confidence") >= 0.85) & (F.size("conflicts") == 0), HINTS[1])
        .when(F.col("coverage") >= 0.6, HINTS[2])
        .otherwise(HINTS[3])
    )
    return g.withColumn("level", F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")).withColumn("hint", hint)


def with_evidence(proposals: DataFrame, samples: DataFrame | None, scope: list[str], order: list[str]) -> DataFrame:
    """proposals with `samples`, the first five samples (at, preview) of the value in `order`, and `evidence`: what was counted and the first three.

    samples(…, preview), or none where summarize_samples has had the order.
    Roles name paragraphs, the role `document` sections.
    """
    j = proposals
    if samples is not None:
        keys = [*scope, "role", "field_key", "value_key"]
        w = Window.partitionBy(*keys).orderBy(*order)
        top = samples.select(*keys, "preview", F.col("at").alias("_at"), F.row_number().over(w).alias("rank")).where("rank <= 5")  # a limit a group: cut before the shuffle, too
        top = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_at").alias("at"), "preview"))).alias("_top")).withColumnRenamed("value_key", "value")
        j = proposals.hint("merge").join(top, [*scope, "role", "field_key", "value"], "left")
    n = [F.col(c).cast("string") for c in ("total_count", "observed_count", "sample_count")]
    document = F.col("role") == "document"
    head = F.when(document, F.concat(F.lit("页面设置共 "), n[0], F.lit(" 个分节，其中 "), n[1], F.lit(" 个分节检测到该字段，"), n[2], F.lit(" 个分节命中主值"))).otherwise(
        F.concat(F.lit("角色「"), role_label(F.col("role")), F.lit("」共 "), n[0], F.lit(" 段，其中 "), n[1], F.lit(" 段检测到该字段，"), n[2], F.lit(" 段命中主值"))
    )
    lines = F.transform(F.slice("_top", 1, 3), lambda x: F.concat(F.when(document, "样本 ").otherwise("段落 "), x["at"].cast("string"), F.lit(": "), x["preview"]))
    return j.withColumn("evidence", F.concat(F.array(head), F.coalesce(lines, F.array().cast("array<string>")))).withColumn("samples", F.transform("_top", lambda x: F.struct(x["at"].alias("at"), x["preview"].alias("preview")))).drop("_top")


def role_samples(roles: DataFrame) -> DataFrame:
    """One sample a classified paragraph and readable field: role, field_key, value_key, total (paragraphs of the role in the document)."""
    none_s, none_n, none_b = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    v = lambda k, s=none_s, n=none_n, b=none_b: F.struct(F.lit(k).alias("field_key"), json_text(s, n, b).alias("value_key"))
    t, one = F.col("text"), lambda c: js_round(F.col(c), 1)
    every = F.array(
        v("fontFamilyCn", s=F.when(has_cjk(t), F.nullif("font_east_asia", F.lit("")))),
        v("fontFamilyLatin", s=F.when(has_latin(t), F.nullif("font_ascii", F.lit("")))),
        v("fontSizePt", n=js_round(F.col("size_pt"), 2)),
        v("bold", b=F.coalesce("bold", F.lit(False))),
        v("align", s=norm_align(F.col("alignment"))),
        v("lineHeightPt", n=one("line_pt")),
        v("spaceBeforePt", n=one("space_before_pt")),
        v("spaceAfterPt", n=one("space_after_pt")),
        v("firstLineIndentChars", n=one("first_line_chars")),
        v("hangingIndentChars", n=one("hanging_chars")),
        v("leftIndentChars", n=one("left_chars")),
        v("outlineLevel", n=outline_comparable(F.col("outline_level")).cast("double")),
    )
    # Each field's value is worked out before the rows multiply; of the text its beginning goes on. Where the roles lie by doc_id, nothing moves.
    r = roles.where("role is not null").select("doc_id", "role", F.col("para_index").alias("at"), preview24(t).alias("preview"), every.alias("_every"))
    r = r.withColumn("total", F.count("*").over(Window.partitionBy("doc_id", "role")))
    return r.select("doc_id", "role", "at", "preview", F.inline(F.filter("_every", lambda x: x["value_key"].isNotNull())), "total")


def document_samples(sections: DataFrame) -> DataFrame:
    """One sample a section and page field."""
    cm = lambda c: number_text(js_round(twips_to_cm(F.col(c)), 2))
    a4 = F.when((F.abs(js_round(twips_to_cm(F.col("page_width")), 2) - 21) <= 0.1) & (F.abs(js_round(twips_to_cm(F.col("page_height")), 2) - 29.7) <= 0.1), '"A4"')
    cols = {"margin_top_cm": "margin_top", "margin_bottom_cm": "margin_bottom", "margin_left_cm": "margin_left", "margin_right_cm": "margin_right", "header_distance_cm": "header", "footer_distance_cm": "footer", "gutter_cm": "gutter"}
    every = F.array(F.struct(F.lit("paper_size").alias("field_key"), a4.alias("value_key")), *[F.struct(F.lit(k).alias("field_key"), cm(c).alias("value_key")) for k, c in cols.items()])
    total = sections.groupBy("doc_id").agg(F.count("*").alias("total"))
    no = F.col("section_index") + 1
    s = sections.select("doc_id", F.lit("document").alias("role"), no.alias("at"), F.concat(F.lit("分节 "), no.cast("string")).alias("preview"), F.inline(F.filter(every, lambda x: x["value_key"].isNotNull())))
    return s.hint("merge").join(total, "doc_id")


def proposal_notices(roles: DataFrame, sections: DataFrame, proposals: DataFrame) -> DataFrame:
    """(doc_id, notices): what to mind about a document's proposals."""
    g = roles.groupBy("doc_id").agg(F.count_if(F.col("role").isNull()).cast("string").alias("a"), F.count_if(F.col("confidence") == "low").cast("string").alias("b"))
    s = sections.groupBy("doc_id").agg(F.count("*").alias("n"))
    c = proposals.where("role = 'document' and size(conflicts) > 0").groupBy("doc_id").agg(F.count("*").alias("c"))
    j = g.hint("merge").join(s, "doc_id", "left").hint("merge").join(c, "doc_id", "left")
    none = F.lit(None).cast("string")
    say = F.array_compact(
        F.array(
            F.when(F.col("a") != "0", F.concat(F.lit("有 "), "a", F.lit(" 段未被角色识别，候选结果只基于已识别段落"))).otherwise(none),
            F.when(F.col("b") != "0", F.concat(F.lit("有 "), "b", F.lit(" 段角色识别置信度低，接受候选前请优先复核相关样本"))).otherwise(none),
            F.when(F.col("n").isNull(), "未检测到分节页面设置，文档级页面候选无法自动提取").when(F.col("c").isNotNull(), "部分页面设置在不同分节间存在冲突，接受前请结合模板检查是否需要统一"),
            F.lit("行距候选仅统计显式固定/最小行距；多倍行距不会自动折算为 pt"),
        )
    )
    return j.select("doc_id", say.alias("notices"))


def apply_ignores(proposals: DataFrame, ignores: DataFrame) -> DataFrame:
    """proposals with ignored true or false; ignores(role, field_key): a null field hides the whole role."""
    whole = ignores.where("field_key is null").select("role", F.lit(True).alias("_a"))
    one = ignores.where("field_key is not null").select("role", "field_key", F.lit(True).alias("_b"))
    j = proposals.join(small(whole), "role", "left").join(small(one), ["role", "field_key"], "left")
    return j.withColumn("ignored", F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b")


def diff_proposals(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """proposals(role, field_key, value) against rules(role, field_key, value, enabled) → rule_changes with a status."""
    r = rules.select("role", "field_key", F.col("value").alias("previous"), "enabled")
    j = proposals.select("role", "field_key", F.col("value").alias("next")).hint("merge").join(r, ["role", "field_key"], "left")
    status = F.when(F.col("previous").isNull() & F.col("enabled").isNull(), "added").when(F.col("previous").eqNullSafe(F.col("next")), F.when(F.col("enabled"), "unchanged").otherwise("enabled")).otherwise("updated")
    return j.select("role", "field_key", "previous", "next", status.alias("status"))


def apply_proposals(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule table after all proposals are accepted."""
    p = proposals.select("role", "field_key", F.col("value").alias("_v"))
    j = rules.hint("merge").join(p, ["role", "field_key"], "full")
    return j.select("role", "field_key", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), True).otherwise(F.col("enabled")).alias("enabled"))


def change_feedback(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def same_as_saved(draft: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows by which two rule tables differ, each with its side."""
    return draft.exceptAll(saved).withColumn("side", F.lit("draft")).unionByName(saved.exceptAll(draft).withColumn("side", F.lit("saved")))

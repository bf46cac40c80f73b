"""Counts of keywords, abstracts and references against ranges: one aggregate a document.

Documents without such paragraphs count as zero, so the aggregates start from all roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import KEYWORD_PREFIX, cjk_count, en_word_count, is_foreign_reference, keyword_items, percent_text, range_text

# Metric → (field, label, unit).
METRICS = {
    "keywords_cn": ("keywords_cn_count", "中文关键词数量", "个"),
    "keywords_en": ("keywords_en_count", "英文关键词数量", "个"),
    "abstract_cn": ("abstract_cn_chars", "中文摘要字数", "字"),
    "abstract_en": ("abstract_en_words", "英文摘要词数", "词"),
}


def document_counts(roles: DataFrame) -> DataFrame:
    """doc_id and its counts: every metric in one pass with partial aggregates."""
    t, role = F.col("text"), F.col("role")
    is_ref = role == "reference_body"
    add = lambda r, v: F.coalesce(F.sum(F.when(role == r, v)), F.lit(0)).cast("long")
    return roles.groupBy("doc_id").agg(
        add("keywords_cn", keyword_items(t, KEYWORD_PREFIX["cn"])).alias("keywords_cn"),
        add("keywords_en", keyword_items(t, KEYWORD_PREFIX["en"])).alias("keywords_en"),
        add("abstract_body_cn", cjk_count(t)).alias("abstract_cn"),
        add("abstract_body_en", en_word_count(t)).alias("abstract_en"),
        F.count_if(is_ref).alias("refs"),
        F.count_if(is_ref & is_foreign_reference(t)).alias("foreign"),
    )


def _range(metric: str, low: float | None, high: float | None) -> Column:
    """The issue of a count that is outside [low, high], else null."""
    field, label, unit = METRICS[metric]
    n, lo, hi = F.col(metric), F.lit(low).cast("double"), F.lit(high).cast("double")
    want = range_text(lo, hi, unit)
    bad = F.coalesce(n < lo, F.lit(False)) | F.coalesce(n > hi, F.lit(False))
    message = F.concat(F.lit(f"{label}应"), F.when(want.startswith("不"), "").otherwise("为 "), want, F.lit("，实际 "), n.cast("string"), F.lit(f" {unit}"))
    return F.when(bad, _issue(field, want, n.cast("string"), "warn", message))


def _issue(field: str, expected: Column, actual: Column, severity: str, message: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), expected.alias("expected"), actual.alias("actual"), F.lit(severity).alias("severity"), message.alias("message"))


def _references(low: int) -> Column:
    n = F.col("refs").cast("string")
    return F.when(F.col("refs") < low, _issue("references_count", F.lit(f"不少于 {low} 条"), n, "error", F.concat(F.lit(f"参考文献应不少于 {low} 条，实际 "), n, F.lit(" 条"))))


def _foreign(low: float) -> Column:
    share, want = percent_text(F.col("foreign") / F.nullif("refs", F.lit(0))), percent_text(F.lit(low))
    counted = F.concat(F.col("foreign").cast("string"), F.lit("/"), F.col("refs").cast("string"))
    message = F.concat(F.lit("外文参考文献占比应不低于 "), want, F.lit("，实际 "), share, F.lit("（"), counted, F.lit("）"))
    return F.when((F.col("refs") > 0) & (F.col("foreign") < low * F.col("refs")), _issue("references_foreign_fraction", F.concat(F.lit("不低于 "), want), share, "warn", message))


def _found(counts: DataFrame, *issues: Column) -> DataFrame:
    return counts.select("doc_id", F.inline(F.array_compact(F.array(*issues))))


def check_range(counts: DataFrame, metric: str, low: float | None, high: float | None) -> DataFrame:
    """Documents whose count is outside [low, high]: doc_id, field, expected, actual, severity, message."""
    return _found(counts, _range(metric, low, high))


def check_reference_count(counts: DataFrame, low: int) -> DataFrame:
    return _found(counts, _references(low))


def check_foreign_fraction(counts: DataFrame, low: float) -> DataFrame:
    return _found(counts, _foreign(low))


def check_statistics(counts: DataFrame, stats: dict) -> DataFrame | None:
    """All checks of stats (ranges: metric → (low, high), min_references, min_foreign) in one pass over the counts; None without any."""
    found = [_range(m, lo, hi) for m, (lo, hi) in stats.get("ranges", {}).items()]
    found += [_references(stats["min_references"])] if stats.get("min_references") is not None else []
    found += [_foreign(stats["min_foreign"])] if stats.get("min_foreign") is not None else []
    return _found(counts, *found) if found else None

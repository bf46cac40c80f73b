"""Continuity of heading and caption numbers, list items and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import caption_number_text, extract_number


def check_heading_sequence(roles: DataFrame) -> DataFrame:
    """Headings whose number doesn't follow: doc_id, para_index, role, field, expected, actual, severity, message."""
    h = roles.where(F.col("role").startswith("heading") & F.col("outline_level").isNotNull() & (F.col("outline_level") <= 8))
    h = h.select("doc_id", "para_index", "role", F.col("outline_level").alias("lv"), extract_number(F.col("text")).alias("num"))
    w = Window.partitionBy("doc_id").orderBy("para_index").rowsBetween(Window.unboundedPreceding, 0)
    # A heading starts all deeper levels anew: level n counts anew with every heading above it.
    above = F.array(*[F.sum((F.col("lv") < n).cast("int")).over(w) for n in range(9)])
    h = h.withColumn("seg", F.element_at(above, F.col("lv") + 1))
    before = Window.partitionBy("doc_id", "lv", "seg").orderBy("para_index").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("expected", F.coalesce(F.last("num", ignorenulls=True).over(before), F.lit(0)) + 1)
    bad = h.where(F.col("num").isNotNull() & (F.col("num") != F.col("expected")))
    message = F.format_string("%d 级标题编号不连续：期望 %d，实际 %d", F.col("lv") + 1, F.col("expected"), F.col("num"))
    return bad.select("doc_id", "para_index", "role", F.lit("heading_sequence").alias("field"), F.col("expected").cast("string").alias("expected"), F.col("num").cast("string").alias("actual"), F.lit("error").alias("severity"), message.alias("message"))


def check_caption_sequence(roles: DataFrame, caption_numbers: DataFrame | None, kind: str) -> DataFrame:
    """Captions of a kind (figure, table) whose number doesn't follow; caption_numbers(doc_id, para_index, kind, parts) go before the text's."""
    label, role = {"figure": ("图", "figure_caption"), "table": ("表", "table_caption")}[kind]
    chapter = F.col("role").startswith("heading") & (F.col("outline_level") == 0)
    r = roles.where((F.col("role") == role) | chapter).select("doc_id", "para_index", "role", F.coalesce(chapter, F.lit(False)).alias("ch"), "text")
    if caption_numbers is not None:
        n = caption_numbers.where(F.col("kind") == kind).select("doc_id", "para_index", "parts")
        r = r.hint("merge").join(n, ["doc_id", "para_index"], "left")
    else:
        r = r.withColumn("parts", F.lit(None).cast("array<int>"))
    r = r.withColumn("nums", F.when(~F.col("ch"), F.coalesce("parts", caption_number_text(F.col("text")))))
    r = r.where(F.col("ch") | F.col("nums").isNotNull())
    w = Window.partitionBy("doc_id").orderBy("para_index")
    r = r.withColumn("g", F.sum(F.col("ch").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_g = Window.partitionBy("doc_id", "g").orderBy("para_index")
    r = r.withColumn("chapter", F.first(F.when(F.col("ch"), extract_number(F.col("text")))).over(in_g.rowsBetween(Window.unboundedPreceding, 0)))
    c = r.where(~F.col("ch")).withColumn("major", F.get("nums", F.lit(0))).withColumn("minor", F.get("nums", F.lit(1)))
    before = in_g.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("last", F.coalesce(F.lag("major").over(in_g), F.lit(0))).withColumn("last_minor", F.coalesce(F.last("minor", ignorenulls=True).over(before), F.lit(0)))
    major, minor, full = F.col("major"), F.col("minor"), F.concat_ws("-", "major", "minor")
    row = lambda e, a, s, m: F.struct(e.cast("string").alias("expected"), a.cast("string").alias("actual"), F.lit(s).alias("severity"), m.alias("message"))
    nxt = F.concat(major.cast("string"), F.lit("-"), (F.col("last_minor") + 1).cast("string"))
    one = F.concat(major.cast("string"), F.lit("-1"))
    want = F.concat(F.col("chapter").cast("string"), F.lit("-*"))
    out = F.array_compact(
        F.array(
            F.when(minor.isNull() & (major != F.col("last") + 1), row(F.col("last") + 1, major, "error", F.format_string(f"{label}题注编号不连续：期望 %d，实际 %d", F.col("last") + 1, major))),
            F.when(minor.isNotNull() & F.col("chapter").isNotNull() & (major != F.col("chapter")), row(want, full, "warn", F.concat(F.lit(f"{label}题注章节编号与当前章节不符：期望 "), want, F.lit("，实际 "), full))),
            F.when(minor.isNotNull() & (major == F.col("last")) & (minor != F.col("last_minor") + 1), row(nxt, full, "error", F.concat(F.lit(f"{label}题注次编号不连续：期望 "), nxt, F.lit("，实际 "), full))),
            F.when(minor.isNotNull() & (major != F.col("last")) & (minor != 1), row(one, full, "error", F.concat(F.lit(f"{label}题注主编号变化后次编号应从 1 开始：实际 "), full))),
        )
    )
    return c.select("doc_id", "para_index", "role", F.lit("caption_sequence").alias("field"), F.inline(out))


def resolve_numbering_level(instances: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """num_instances(doc_id, num_id, abstract_num_id), num_levels(doc_id, abstract_num_id, ilvl, start, num_fmt, lvl_text), num_overrides(doc_id, num_id, ilvl, start) → level of each (num, ilvl)."""
    base = instances.hint("merge").join(levels, ["doc_id", "abstract_num_id"])
    o = overrides.select("doc_id", "num_id", "ilvl", F.col("start").alias("_start"))
    return base.hint("merge").join(o, ["doc_id", "num_id", "ilvl"], "left").withColumn("start", F.coalesce("_start", "start")).drop("_start")


def recognize_list(paragraphs: DataFrame, instances: DataFrame, levels: DataFrame) -> DataFrame:
    """Paragraphs with a full chain of numbering: list_type unordered for bullets, else ordered."""
    p = paragraphs.where("num_id is not null and ilvl is not null").select("doc_id", "para_index", "num_id", "ilvl")
    hit = p.hint("merge").join(instances, ["doc_id", "num_id"]).hint("merge").join(levels, ["doc_id", "abstract_num_id", "ilvl"])
    return hit.select("doc_id", "para_index", "num_id", "ilvl", F.when(F.col("num_fmt") == "bullet", "unordered").otherwise("ordered").alias("list_type"))


def group_lists(items: DataFrame) -> DataFrame:
    """Consecutive list items of one numbering and type; other paragraphs between them don't part a group."""
    w = Window.partitionBy("doc_id").orderBy("para_index")
    same = (F.col("num_id") == F.lag("num_id").over(w)) & (F.col("list_type") == F.lag("list_type").over(w))
    g = items.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("list_no", F.sum("_new").over(w))
    return g.groupBy("doc_id", "list_no", "num_id", "list_type").agg(F.min("para_index").alias("first_para"), F.max("para_index").alias("last_para"), F.count("*").alias("n_items"))

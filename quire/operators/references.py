"""Captions, cross-references and notes as equi-joins on (doc_id, bookmark) and (doc_id, type, note)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import caption_number_field, field_descriptor, sequence_kind, trim_ws

ROLE_OF_KIND = {"figure": "figure_caption", "table": "table_caption", "equation": "formula_line"}
NOTE_LABELS = {"footnote": "脚注", "endnote": "尾注"}


def described(fields: DataFrame) -> DataFrame:
    """fields(…, instruction) with type, bookmark, sequence."""
    # Exploded, so that each instruction is taken apart once, not once a column and filter.
    return fields.select(*fields.columns, F.inline(F.array(field_descriptor(F.col("instruction")))))


def caption_ref_candidates(fields: DataFrame) -> DataFrame:
    """REF and PAGEREF fields with a bookmark, without numbered citations (switch \\r and a display like [1])."""
    cited = F.col("instruction").rlike(r"(?i)\\r(?:\s|\z)") & trim_ws(F.col("display_text")).rlike(r"^\[\s*\d+(?:\s*[-,，]\s*\d+)*\s*\]\z")
    return fields.where(F.col("type").isin("REF", "PAGEREF") & (F.coalesce("bookmark", F.lit("")) != "") & ~cited)


def captions(roles: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, para_index, kind, parts: of each caption the first sequence field of its kind."""
    f = fields.where("type = 'SEQ'").select("doc_id", "para_index", "field_index", "display_text", sequence_kind(F.col("sequence")).alias("kind")).where("kind is not null")
    first = f.groupBy("doc_id", "para_index", "kind").agg(F.min_by("display_text", "field_index").alias("display_text"))
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_OF_KIND.items() for x in kv]), F.col("kind"))
    hit = first.hint("merge").join(roles.select("doc_id", "para_index", "role"), ["doc_id", "para_index"]).where(F.col("role") == role)
    return hit.select("doc_id", "para_index", "kind", trim_ws(F.col("display_text")).alias("number_text"), caption_number_field(F.col("display_text")).alias("parts"))


def caption_graph(roles: DataFrame, fields: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """References with bookmark_exists and the paragraph of their caption (the first that holds the bookmark)."""
    b = bookmarks.select("doc_id", "para_index", F.col("name").alias("bookmark")).distinct()
    caps = captions(roles, fields).select("doc_id", "para_index", "kind")
    target = b.hint("merge").join(caps, ["doc_id", "para_index"]).groupBy("doc_id", "bookmark").agg(F.min(F.struct(F.col("para_index").alias("target_para"), F.col("kind").alias("target_kind"))).alias("_t"))
    known = b.groupBy("doc_id", "bookmark").agg(F.lit(True).alias("bookmark_exists")).hint("merge").join(target, ["doc_id", "bookmark"], "left")
    refs = caption_ref_candidates(fields).select("doc_id", "para_index", "field_index", "type", "bookmark")
    out = refs.hint("merge").join(known, ["doc_id", "bookmark"], "left").hint("merge").join(roles.select("doc_id", "para_index", "role"), ["doc_id", "para_index"], "left")
    return out.select("doc_id", "para_index", "field_index", "type", "bookmark", "role", F.coalesce("bookmark_exists", F.lit(False)).alias("bookmark_exists"), "_t.target_para", "_t.target_kind")


def check_references(graph: DataFrame) -> DataFrame:
    mark, kind = F.col("bookmark"), F.col("type")
    bad = graph.where("target_para is null")
    lost = ~F.col("bookmark_exists")
    return bad.select(
        "doc_id", "para_index", F.coalesce("role", F.lit("unknown")).alias("role"), F.lit("caption_reference").alias("field"),
        F.when(lost, F.concat(mark, F.lit("（不存在）"))).otherwise(F.concat(mark, F.lit("（存在但不是题注）"))).alias("actual"),
        F.when(lost, "error").otherwise("warn").alias("severity"),
        F.when(lost, F.concat(kind, F.lit(" 引用的书签「"), mark, F.lit("」不存在"))).otherwise(F.concat(kind, F.lit(" 引用的书签「"), mark, F.lit("」存在，但目标不是图/表/公式题注"))).alias("message"),
    )


def check_notes(refs: DataFrame, defs: DataFrame, roles: DataFrame) -> DataFrame:
    """References without a definition, one row each, with the role of their paragraph; definitions without a reference, one row a document and type."""
    label = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in NOTE_LABELS.items() for x in kv]), c)
    key, name = ["doc_id", "type", "note_id"], label(F.col("type"))
    lost = refs.hint("merge").join(defs.select(*key).distinct(), key, "left_anti")
    lost = lost.hint("merge").join(roles.select("doc_id", "para_index", "role"), ["doc_id", "para_index"], "left")
    lost = lost.select(
        "doc_id", "para_index", F.coalesce("role", F.lit("unknown")).alias("role"), F.lit("note_reference").alias("field"), F.concat(F.lit("存在对应"), name, F.lit("定义")).alias("expected"), F.concat(name, F.lit("#"), F.col("note_id"), F.lit("（缺失）")).alias("actual"), F.lit("error").alias("severity"),
        F.concat(name, F.lit("引用「"), F.col("note_id"), F.lit("」缺少对应定义")).alias("message"),
    )
    idle = defs.hint("merge").join(refs.select(*key).distinct(), key, "left_anti")
    five = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "note_id"))), 1, 5), lambda x: x["note_id"])
    idle = idle.groupBy("doc_id", "type").agg(F.count("*").alias("n"), five.alias("ids"))
    n = F.col("n").cast("string")
    idle = idle.select(
        "doc_id", F.lit(-1).alias("para_index"), F.lit("document").alias("role"), F.lit("note_definition").alias("field"), F.concat(F.lit("全部"), name, F.lit("定义均被正文引用")).alias("expected"),
        F.concat(n, F.lit(" 条未引用（"), F.array_join("ids", ", "), F.when(F.col("n") > 5, " ...").otherwise(""), F.lit("）")).alias("actual"), F.lit("info").alias("severity"),
        F.concat(F.lit("检测到 "), n, F.lit(" 条"), name, F.lit("定义未被正文引用")).alias("message"),
    )
    return lost.unionByName(idle)


def bookmark_rows(raw: DataFrame) -> DataFrame:
    return raw.where("name is not null").dropDuplicates(["doc_id", "para_index", "id", "name"])


def neighbours(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with prev_text and next_text, the nearest non-blank texts before and after each."""
    w = Window.partitionBy("doc_id").orderBy("para_index")
    p = paragraphs.withColumn("_said", F.when(trim_ws(F.col("text")) != "", F.col("text")))
    # lead goes on from where it was; a frame up to the end would be gone through for each row.
    ahead = F.expr("lead(_said) ignore nulls over (partition by doc_id order by para_index)")
    return p.select(*paragraphs.columns, F.last("_said", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_text"), ahead.alias("next_text"))


def neighbour_text(paragraphs: DataFrame) -> DataFrame:
    """Nearest non-blank text before and after each paragraph."""
    return neighbours(paragraphs.select("doc_id", "para_index", "text")).drop("text")


def numbered(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with occurrence: how many earlier ones of the document have the same text."""
    w = Window.partitionBy("doc_id", "text").orderBy("para_index")
    return paragraphs.select("*", (F.row_number().over(w) - 1).alias("occurrence"))


def occurrence_index(paragraphs: DataFrame) -> DataFrame:
    """How many earlier paragraphs of the document have the same text."""
    return numbered(paragraphs.select("doc_id", "para_index", "text")).drop("text")

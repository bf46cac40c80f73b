"""Inherited formatting: style ancestry by a fold over each document's style array, then coalesce.

Styles, defaults, paragraphs and runs carry run properties (RUN) and
paragraph properties (PARA) as columns of these names; null is "not set".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import once, trim_ws
from quire.functions.units import js_round, twips_to_chars

RUN = ["font_east_asia", "font_ascii", "font_hansi", "size_pt", "bold", "italic"]
#: line: struct(pt, multiple), so that a fixed height and a multiple replace each other.
PARA = ["alignment", "line", "space_before_pt", "space_after_pt", "outline_level", "first_twips", "first_chars", "hanging_twips", "hanging_chars", "left_twips", "left_chars"]


def fold_styles(styles: Column, props: list[str], keep: list[str] = []) -> Column:
    """array<struct<style_id, based_on, keep…, props…>> of different ids → array<struct<style_id, keep…, props…>> with inherited values.

    Each style knows the place of its parent. A round takes what the parent
    knows and makes the parent's parent the new one, so the reach doubles and
    log2 of the array's size rounds do for chains of any length. A style that
    is reached again adds nothing (its nearest copy wins): cycles are
    harmless. A missing parent ends the chain.
    """
    named = lambda x, up, values: F.struct(x["style_id"].alias("style_id"), up.alias("up"), *[x[k].alias(k) for k in keep], *[v.alias(p) for p, v in values.items()])

    def placed(ids: Column) -> Column:
        return F.transform(styles, lambda x: named(x, F.coalesce(F.array_position(ids, x["based_on"]).cast("int"), F.lit(0)), {p: x[p] for p in props}))

    def further(known: Column, _: Column) -> Column:
        def one(x):
            above = F.get(known, x["up"] - 1)
            return named(x, F.coalesce(above["up"], F.lit(0)), {p: F.coalesce(x[p], above[p]) for p in props})

        return F.transform(known, one)

    rounds = F.greatest(F.lit(1), F.ceil(F.log2(F.size(styles) + F.lit(1))).cast("int"))
    folded = F.aggregate(F.sequence(F.lit(1), rounds), once(F.transform(styles, lambda x: x["style_id"]), placed), further)
    return F.transform(folded, lambda x: F.struct(x["style_id"].alias("style_id"), *[x[p].alias(p) for p in [*keep, *props]]))


def style_chain(styles: DataFrame, props: list[str]) -> DataFrame:
    """styles(doc_id, style_id, based_on, props…), one row a style → (doc_id, style_id, props…) with inherited values, in one exchange."""
    all_ = styles.groupBy("doc_id").agg(F.collect_list(F.struct("style_id", "based_on", *props)).alias("_styles"))
    return all_.select("doc_id", F.explode(fold_styles(F.col("_styles"), props)).alias("s")).select("doc_id", "s.*")


def default_style(styles: DataFrame) -> DataFrame:
    """(doc_id, default_id): the first paragraph style marked as default."""
    return styles.where("type = 'paragraph' and is_default").groupBy("doc_id").agg(F.min_by("style_id", "seq").alias("default_id"))


def last_styles(raw: DataFrame) -> DataFrame:
    """Of repeated style ids the last definition."""
    rest = [c for c in raw.columns if c not in ("doc_id", "style_id")]
    return raw.groupBy("doc_id", "style_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("doc_id", "style_id", "s.*")


def dominant_run(runs: DataFrame, props: list[str]) -> DataFrame:
    """Properties of a paragraph's first run with text."""
    shown = runs.where(trim_ws(F.col("text")) != "")
    return shown.groupBy("doc_id", "para_index").agg(F.min_by(F.struct(*props), "run_index").alias("_run"))


def inherited(rows: DataFrame, chain: DataFrame, defaults: DataFrame, default_ids: DataFrame, props: list[str]) -> DataFrame:
    """rows(doc_id, style_id, …) with _chain and _def: props of the style chain (the default style's where style_id is null) and of the document's defaults."""
    r = rows.hint("merge").join(default_ids, "doc_id", "left").withColumn("_style", F.coalesce("style_id", "default_id")).drop("default_id")
    c = chain.select("doc_id", F.col("style_id").alias("_style"), F.struct(*props).alias("_chain"))
    d = defaults.select("doc_id", F.struct(*props).alias("_def"))
    return r.hint("merge").join(c, ["doc_id", "_style"], "left").hint("merge").join(d, "doc_id", "left").drop("_style")


def _mark(df: DataFrame, p: str) -> list[str]:
    """The paragraph mark's property, where there is one."""
    return [f"m_{p}"] if f"m_{p}" in df.columns else []


def effective(j: DataFrame, run_props: list[str], para_props: list[str] = [], marks: bool = False) -> DataFrame:
    """j(doc_id, para_index, _run, _chain, _def, p_…; with marks m_…) → (doc_id, para_index, properties).

    Run side: defaults < style chain < paragraph mark (m_…) < first run with
    text. Paragraph side: defaults < style chain < the paragraph's own (p_…).
    Indents in twips become characters of the effective size: first_line_chars,
    hanging_chars, left_chars.
    """
    mark = lambda p: [f"m_{p}"] if marks else []
    out = [F.coalesce(f"_run.{p}", *mark(p), f"_chain.{p}", f"_def.{p}").alias(p) for p in run_props]
    out += [F.coalesce(f"p_{p}", f"_chain.{p}", f"_def.{p}").alias(p) for p in para_props]
    kept = [c for c in j.columns if not c.startswith(("_", "m_", "p_"))]
    done = j.select(*kept, *out)
    size = F.col("size_pt")
    chars = {}
    for name, side in (("first_line_chars", "first"), ("hanging_chars", "hanging"), ("left_chars", "left")):
        if f"{side}_twips" in para_props:
            twips = F.when(size.isNotNull() & (size != 0), js_round(twips_to_chars(F.col(f"{side}_twips"), size), 2))
            chars[name] = F.coalesce(js_round(F.col(f"{side}_chars"), 2), twips) if f"{side}_chars" in para_props else twips
    return done.select(*kept, *[p for p in run_props + para_props if not p.endswith(("_twips", "_chars"))], *[c.alias(n) for n, c in chars.items()])


def resolve_paragraph(paragraphs: DataFrame, chain: DataFrame, defaults: DataFrame, default_ids: DataFrame, runs: DataFrame, run_props: list[str], para_props: list[str] = []) -> DataFrame:
    """Effective properties of each paragraph, from tables; where the parts of a document stand in one row, `effective` needs no join."""
    j = inherited(paragraphs, chain, defaults, default_ids, run_props + para_props)
    j = j.hint("merge").join(dominant_run(runs, run_props), ["doc_id", "para_index"], "left")
    marks = all(f"m_{p}" in paragraphs.columns for p in run_props)
    own = [*[f"m_{p}" for p in run_props if marks], *[f"p_{p}" for p in para_props]]
    return effective(j.select("doc_id", "para_index", *own, "_run", "_chain", "_def"), run_props, para_props, marks)


def resolve_run(runs: DataFrame, paragraphs: DataFrame, chain: DataFrame, defaults: DataFrame, default_ids: DataFrame, run_props: list[str]) -> DataFrame:
    """Effective properties of each run: defaults < style chain < paragraph mark (m_…) < its own."""
    marks = [f"m_{p}" for p in run_props if f"m_{p}" in paragraphs.columns]
    base = inherited(paragraphs.select("doc_id", "para_index", "style_id", *marks), chain, defaults, default_ids, run_props)
    j = runs.select("doc_id", "para_index", "run_index", "text", F.struct(*run_props).alias("_run")).hint("merge").join(base.drop("style_id"), ["doc_id", "para_index"])
    return effective(j, run_props, marks=bool(marks))

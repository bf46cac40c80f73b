"""Formatting of paragraphs and runs against rule tables: equi-joins on (role, field).

Rule tables are dimension tables (34 roles by 12 fields a library): rule_fields
is broadcast after a check of its size, beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import has_cjk, has_latin, norm_align, number_text, outline_comparable, preview24

# Field key → (label, issue field, unit suffix, tolerance), in rule order.
FIELDS = {
    "fontFamilyCn": ("中文字体", "font_east_asia", "", 0.01),
    "fontFamilyLatin": ("西文字体", "font_latin", "", 0.01),
    "fontSizePt": ("字号", "size_pt", "pt", 0.01),
    "bold": ("加粗", "bold", "", 0.01),
    "align": ("对齐", "alignment", "", 0.01),
    "lineHeightPt": ("行距", "line_spacing_pt", "pt", 0.5),
    "spaceBeforePt": ("段前", "spacing_before_pt", "pt", 0.05 + 1e-6),
    "spaceAfterPt": ("段后", "spacing_after_pt", "pt", 0.05 + 1e-6),
    "firstLineIndentChars": ("首行缩进", "first_line_indent_chars", " 字符", 0.1),
    "hangingIndentChars": ("悬挂缩进", "hanging_indent_chars", " 字符", 0.1),
    "leftIndentChars": ("左缩进", "left_indent_chars", " 字符", 0.1),
    "outlineLevel": ("大纲级别", "outline_level", " 级", 0.01),
}
# Roles whose rules another role's stand in for, in order.
FALLBACKS = {
    "acknowledgement_heading": ["back_matter_heading"],
    "acknowledgement_body": ["back_matter_body"],
    "appendix_heading": ["back_matter_heading"],
    "appendix_subheading": ["appendix_body", "back_matter_body"],
    "appendix_list_item": ["appendix_body", "back_matter_body"],
    "appendix_signature": ["appendix_body", "back_matter_body"],
    "appendix_body": ["back_matter_body"],
    "achievement_heading": ["back_matter_heading"],
    "achievement_body": ["back_matter_body"],
}
MAX_BROADCAST_BYTES = 16_000_000
RULE_SCHEMA = "role string, field_key string, enabled boolean, severity string, mode string, exact_str string, exact_num double, exact_bool boolean, one_of array<struct<s:string,n:double,b:boolean>>, min double, max double"


def small(table: DataFrame, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A dimension table, to be broadcast if its rows have at most `most` bytes as JSON, else to be shuffled."""
    size = table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= most else table.hint("merge")


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where("enabled and mode <> 'unset'")


def compare_scalar(s: Column, n: Column, b: Column, es: Column, en: Column, eb: Column, tolerance: Column) -> Column:
    """Whether a value equals an expected one, each a text, a number or a truth; numbers within the tolerance; no value equals nothing."""
    return F.coalesce(F.abs(n - en) <= tolerance, s == es, b == eb, F.lit(False))


def format_value(s: Column, n: Column, b: Column, unit: Column) -> Column:
    """A value in words: texts as they are, numbers with their unit, truths as yes or no, a dash for none."""
    return F.coalesce(s, F.concat(number_text(n), unit), F.when(b, "是").when(~b, "否"), F.lit("—"))


def matches_rule(s: Column, n: Column, b: Column, tolerance: Column) -> Column:
    """The value (one of text, number, truth) against the rule columns; no value matches nothing."""
    same = lambda es, en, eb: compare_scalar(s, n, b, es, en, eb, tolerance)
    return (
        F.when(F.col("mode") == "unset", True)
        .when(F.col("mode") == "exact", same(F.col("exact_str"), F.col("exact_num"), F.col("exact_bool")))
        .when(F.col("mode") == "oneOf", F.coalesce(F.exists("one_of", lambda x: same(x["s"], x["n"], x["b"])), F.lit(False)))
        .otherwise(n.isNotNull() & F.coalesce(n >= F.col("min"), F.lit(True)) & F.coalesce(n <= F.col("max"), F.lit(True)))
    )


def describe_rule(fmt) -> Column:
    """The rule in words; fmt(s, n, b) prints one value."""
    none_s, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    num = lambda c: fmt(none_s, F.col(c), none_b)
    return (
        F.when(F.col("mode") == "exact", F.concat(F.lit("应为 "), fmt(F.col("exact_str"), F.col("exact_num"), F.col("exact_bool"))))
        .when(F.col("mode") == "oneOf", F.concat(F.lit("应为以下之一："), F.array_join(F.transform("one_of", lambda x: fmt(x["s"], x["n"], x["b"])), " / ")))
        .when((F.col("mode") == "range") & F.col("min").isNotNull() & F.col("max").isNotNull(), F.concat(F.lit("应在 "), num("min"), F.lit(" ~ "), num("max"), F.lit(" 范围内")))
        .when((F.col("mode") == "range") & F.col("min").isNotNull(), F.concat(F.lit("应不小于 "), num("min")))
        .when(F.col("mode") == "range", F.concat(F.lit("应不大于 "), num("max")))
        .otherwise(F.lit("不校验"))
    )


# Alignment → words of a hint.
ALIGN_WORDS = {"left": "左对齐", "right": "右对齐", "center": "居中", "justify": "两端对齐", "both": "两端对齐", "distribute": "分散对齐"}


def rule_target(unit: Column) -> Column:
    """What the rule asks for, as hints say it; unit: suffix of numbers."""
    words = F.create_map(*[F.lit(x) for kv in ALIGN_WORDS.items() for x in kv])
    num = lambda n: F.concat(number_text(n), unit)
    one = lambda s, n, b: F.coalesce(num(n), F.concat(F.lit("「"), F.coalesce(F.try_element_at(words, s), s), F.lit("」")), F.when(b, "「加粗」").when(~b, "「不加粗」"))
    low, high, none = num(F.col("min")), num(F.col("max")), F.lit("规范值")
    return (
        F.when(F.col("mode") == "exact", F.coalesce(one(F.col("exact_str"), F.col("exact_num"), F.col("exact_bool")), none))
        .when(F.col("mode") == "oneOf", F.coalesce(F.nullif(F.array_join(F.transform("one_of", lambda x: one(x["s"], x["n"], x["b"])), " 或 "), F.lit("")), none))
        .when(F.col("mode") == "range", F.coalesce(F.concat(low, F.lit(" ~ "), high), F.concat(F.lit("不小于 "), low), F.concat(F.lit("不大于 "), high), F.lit("规范范围")))
        .otherwise(none)
    )


def rule_for_role(rule_roles: DataFrame) -> DataFrame:
    """The roles that have rules (role) → (role, rule_role): of every role that is known or has rules its own rules, else the first stand-in's.

    Works on rule tables alone; the corpus is not read.
    """
    have = rule_roles.select("role").where("role is not null").distinct()
    stands = [(r, x, i) for r, xs in FALLBACKS.items() for i, x in enumerate(xs, 1)]
    fixed = F.array(*[F.struct(F.lit(x).alias("rule_role"), F.lit(r).alias("role"), F.lit(i).alias("rank")) for r, x, i in stands])
    own = have.select(F.col("role").alias("rule_role"), "role", F.lit(0).alias("rank"))
    other = have.select(F.col("role").alias("_have"), F.inline(fixed)).where("_have = rule_role").drop("_have")
    return own.unionByName(other).groupBy("role").agg(F.min_by("rule_role", "rank").alias("rule_role"))


def rules_by_role(rules: DataFrame) -> DataFrame:
    """rules(role, …) with one copy for every role that they hold for; dimension-sized."""
    to = rule_for_role(rules).select(F.col("role").alias("_for"), F.col("rule_role").alias("role"))
    return rules.join(small(to), "role").drop("role").withColumnRenamed("_for", "role")


def _values(roles: DataFrame) -> DataFrame:
    """One row a paragraph and field that can be checked: field_key, s, n, b, and line_multiple for their words."""
    none = {"s": F.lit(None).cast("string"), "n": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}

    def v(key, ok, **value):
        x = none | value
        return F.struct(F.lit(key).alias("field_key"), x["s"].alias("s"), x["n"].alias("n"), x["b"].alias("b"), ok.alias("ok"))

    t, always = F.col("text"), F.lit(True)
    number = lambda key, c: v(key, F.col(c).isNotNull(), n=F.col(c))
    text = lambda key, c, test: v(key, (F.coalesce(c, F.lit("")) != "") & test, s=F.col(c))
    every = F.array(
        text("fontFamilyCn", "font_east_asia", has_cjk(t)),
        text("fontFamilyLatin", "font_ascii", has_latin(t)),
        number("fontSizePt", "size_pt"),
        v("bold", always, b=F.coalesce("bold", F.lit(False))),
        v("align", always, s=norm_align(F.col("alignment"))),
        v("lineHeightPt", always, n=F.col("line_pt")),
        number("spaceBeforePt", "space_before_pt"),
        number("spaceAfterPt", "space_after_pt"),
        number("firstLineIndentChars", "first_line_chars"),
        number("hangingIndentChars", "hanging_chars"),
        number("leftIndentChars", "left_chars"),
        v("outlineLevel", always, n=outline_comparable(F.col("outline_level")).cast("double")),
    )
    # Rows are tested after the array is taken apart: a filter of the array would run outside generated code.
    return roles.where("role is not null").select("doc_id", "para_index", "role", "text", "line_multiple", F.inline(every)).where("ok").drop("ok")


def _in_words() -> Column:
    """A row of _values() in words."""
    quoted = lambda c: F.concat(F.lit("「"), c, F.lit("」"))
    key, s, n, b, unset = F.col("field_key"), F.col("s"), F.col("n"), F.col("b"), F.lit("（未设置）")
    return (
        F.when(key == "lineHeightPt", F.coalesce(F.concat(number_text(n), F.lit("pt")), F.concat(number_text(F.col("line_multiple")), F.lit(" 倍")), unset))
        .when(key == "outlineLevel", F.concat(number_text(n), F.lit(" 级")))
        .when(key == "bold", quoted(F.when(b, "是").otherwise("否")))
        .when(key.isin("fontFamilyCn", "fontFamilyLatin", "align"), F.coalesce(quoted(s), unset))
        .otherwise(F.concat(number_text(n), _by_key({k: x[2] for k, x in FIELDS.items()})))
    )


def actual_values(roles: DataFrame) -> DataFrame:
    """One row a paragraph and field that can be checked: field_key, s, n, b, shown (the value in words)."""
    return _values(roles).select("doc_id", "para_index", "role", preview24(F.col("text")).alias("text_preview"), "field_key", "s", "n", "b", _in_words().alias("shown"))


def _by_key(values: dict, key="field_key") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def _shown(s: Column, n: Column, b: Column) -> Column:
    quoted = F.concat(F.lit("「"), F.coalesce(s, F.when(b, "是").when(~b, "否"), F.lit("（未设置）")), F.lit("」"))
    return F.coalesce(F.concat(number_text(n), _by_key({k: x[2] for k, x in FIELDS.items()})), quoted)


def check_paragraph_fields(roles: DataFrame, rules: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Paragraph values that break an enabled rule; skip(doc_id, para_index, field_key): checked by runs instead."""
    own = small(rules_by_role(enabled_rules(rules)))
    hit = _values(roles).join(own, ["role", "field_key"])
    bad = hit.where(~matches_rule(F.col("s"), F.col("n"), F.col("b"), _by_key({k: x[3] for k, x in FIELDS.items()})))
    keys = ["doc_id", "para_index", "field_key"]
    out = bad.withColumn("shown", _in_words()).select(
        *keys, "role", _by_key({k: x[1] for k, x in FIELDS.items()}).alias("field"), "severity", "shown", preview24(F.col("text")).alias("text_preview"),
        F.concat(_by_key({k: x[0] for k, x in FIELDS.items()}), describe_rule(_shown), F.lit("，实际 "), F.col("shown")).alias("message"), rule_target(_by_key({k: x[2] for k, x in FIELDS.items()})).alias("target"),
    )
    if skip is not None:
        # After the rules, since few values break one: no anti join, which Spark would take to before them, where each value is moved.
        out = out.hint("merge").join(skip.select(*keys, F.lit(True).alias("_by_run")), keys, "left").where("_by_run is null").drop("_by_run")
    return out.select("doc_id", "para_index", "role", "field", "severity", "shown", "text_preview", "message", "target")


RUN_FIELDS = {"fontFamilyCn": ("font_east_asia", has_cjk), "fontFamilyLatin": ("font_ascii", has_latin), "fontSizePt": ("size_pt", lambda t: F.lit(True))}


def comparable_runs(runs: DataFrame) -> DataFrame:
    """One row a run and field that can be compared: its text isn't blank and of the field's script, the value is set. Runs may have the role of their paragraph."""
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")
    every = F.array(
        *[
            F.struct(F.lit(k).alias("field_key"), (F.col(c) if k != "fontSizePt" else none_s).alias("s"), (F.col(c) if k == "fontSizePt" else none_n).alias("n"), (test(F.col("text")) & F.col(c).isNotNull()).alias("ok"))
            for k, (c, test) in RUN_FIELDS.items()
        ]
    )
    shown = runs.where(F.col("text").rlike(r"[^\s\x{A0}\x{3000}\x{FEFF}]"))
    return shown.select("doc_id", "para_index", "run_index", "text", *[c for c in ("role",) if c in runs.columns], F.inline(every)).where("ok").drop("ok")


def run_islands(failing: DataFrame, carry: list[str] = []) -> DataFrame:
    """Neighbouring failing runs of one value become one row: start_run, end_run, affected_text; carry: columns that a paragraph and field fix."""
    keys = ["doc_id", "para_index", "field_key", *carry]
    w = Window.partitionBy(*keys).orderBy("run_index")
    value = F.struct("s", "n")
    joined = (F.col("run_index") == F.lag("run_index").over(w) + 1) & value.eqNullSafe(F.lag(value).over(w))
    g = failing.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("_no", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("run_index", "text")))
    return g.groupBy(*keys, "_no", "s", "n").agg(
        F.min("run_index").alias("start_run"), F.max("run_index").alias("end_run"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("affected_text")
    ).drop("_no")


def check_run_fields(roles: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs whose font or size breaks a rule of their paragraph's role, by islands; the role comes from the runs, if they have it."""
    own = small(rules_by_role(enabled_rules(rules)))
    r = comparable_runs(runs)
    if "role" not in r.columns:
        r = r.hint("merge").join(roles.where("role is not null").select("doc_id", "para_index", "role"), ["doc_id", "para_index"])
    bad = r.join(own, ["role", "field_key"]).where(~matches_rule(F.col("s"), F.col("n"), F.lit(None).cast("boolean"), F.lit(0.01)))
    unit = _by_key({k: x[2] for k, x in FIELDS.items()})
    bad = bad.withColumns({"_say": F.concat(_by_key({k: x[0] for k, x in FIELDS.items()}), describe_rule(_shown)), "target": rule_target(unit)})
    i = run_islands(bad.select("doc_id", "para_index", "field_key", "role", "severity", "_say", "target", "run_index", "text", "s", "n"), ["role", "severity", "_say", "target"])
    shown = _shown(F.col("s"), F.col("n"), F.lit(None).cast("boolean"))
    first, last = (F.col("start_run") + 1).cast("string"), (F.col("end_run") + 1).cast("string")
    place = F.concat(F.lit("第 "), first, F.when(F.col("end_run") > F.col("start_run"), F.concat(F.lit("-"), last)).otherwise(""), F.lit(" 个文本片段「"), F.col("affected_text"), F.lit("」"))
    return i.select(
        "doc_id", "para_index", "role", _by_key({k: x[1] for k, x in FIELDS.items()}).alias("field"), "severity", shown.alias("shown"), preview24(F.col("affected_text")).alias("text_preview"),
        F.concat(place, F.col("_say"), F.lit("，实际 "), shown).alias("message"), "target", "start_run", "end_run", "affected_text",
    )


def check_fields(roles: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Paragraph and run checks together: fonts and sizes by runs where a run can be compared, else by the paragraph."""
    by_run = check_run_fields(roles, runs, rules)
    skip = comparable_runs(runs).select("doc_id", "para_index", "field_key").distinct()
    return check_paragraph_fields(roles, rules, skip).unionByName(by_run, allowMissingColumns=True)


def check_legacy_fields(roles: DataFrame, styles: DataFrame) -> DataFrame:
    """The older rule form: one row a role, styles(role, font_east_asia, font_latin, size_pt, bold, alignment, line_spacing_pt, first_line_indent_chars) as x_*."""
    own = rules_by_role(styles)
    own = own.select("role", *[F.col(c).alias(f"x_{c}") for c in own.columns if c != "role"])
    j = roles.where("role is not null").join(small(own), "role")
    t, c, x = F.col("text"), F.col, lambda n: F.col(f"x_{n}")
    off = lambda a, e, tol: F.abs(a - e) > tol
    bold = F.coalesce("bold", F.lit(False))
    row = lambda f, e, a, s: F.struct(F.lit(f).alias("field"), e.cast("string").alias("expected"), a.cast("string").alias("actual"), F.lit(s).alias("severity"))
    line = F.when(c("line_pt").isNotNull(), F.when(off(c("line_pt"), x("line_spacing_pt"), 0.5), row("line_spacing_pt", number_text(x("line_spacing_pt")), number_text(c("line_pt")), "warn"))).when(
        c("line_multiple").isNotNull(), row("line_spacing_pt", number_text(x("line_spacing_pt")), F.concat(number_text(c("line_multiple")), F.lit(" 倍")), "warn")
    ).otherwise(row("line_spacing_pt", number_text(x("line_spacing_pt")), F.lit("(未设置)"), "info"))
    out = F.array_compact(
        F.array(
            F.when((x("font_east_asia") != "") & has_cjk(t) & (c("font_east_asia") != x("font_east_asia")), row("font_east_asia", x("font_east_asia"), c("font_east_asia"), "error")),
            F.when((x("font_latin") != "") & has_latin(t) & (c("font_ascii") != x("font_latin")), row("font_latin", x("font_latin"), c("font_ascii"), "error")),
            F.when(off(c("size_pt"), x("size_pt"), 0.01), row("size_pt", number_text(x("size_pt")), number_text(c("size_pt")), "error")),
            F.when(bold != x("bold"), row("bold", x("bold"), bold, "warn")),
            F.when((x("alignment") != "") & ~norm_align(c("alignment")).eqNullSafe(norm_align(x("alignment"))), row("alignment", x("alignment"), F.coalesce(norm_align(c("alignment")), F.lit("(未设置)")), "warn")),
            F.when(x("line_spacing_pt").isNotNull(), line),
            F.when(off(c("first_line_chars"), x("first_line_indent_chars"), 0.1), row("first_line_indent_chars", number_text(x("first_line_indent_chars")), number_text(c("first_line_chars")), "warn")),
        )
    )
    return j.select("doc_id", "para_index", "role", F.inline(out))

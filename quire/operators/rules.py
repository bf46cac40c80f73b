"""Rule libraries: JSON of both forms as rule tables and back, lint, publication.

A rule table has one row a role and field (RULE columns); the columns in front
of them, `keys`, name the library where a table holds several.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import bump_version, number_text, trim_ws
from quire.operators.report import role_label
from quire.operators.style_checks import FIELDS

# Field key → (column of the older form, kind of value, unit).
LEGACY = {
    "fontFamilyCn": ("font_east_asia", "s", "enum"),
    "fontFamilyLatin": ("font_latin", "s", "enum"),
    "fontSizePt": ("size_pt", "n", "pt"),
    "bold": ("bold", "b", "bool"),
    "align": ("alignment", "s", "enum"),
    "lineHeightPt": ("line_spacing_pt", "n", "pt"),
    "spaceBeforePt": ("spacing_before_pt", "n", "pt"),
    "spaceAfterPt": ("spacing_after_pt", "n", "pt"),
    "firstLineIndentChars": ("first_line_indent_chars", "n", "chars"),
    "hangingIndentChars": ("hanging_indent_chars", "n", "chars"),
    "leftIndentChars": ("left_indent_chars", "n", "chars"),
    "outlineLevel": ("outline_level", "n", "level"),
}
ERROR_FIELDS = ("fontFamilyCn", "fontFamilyLatin", "fontSizePt")
RULE = ["role", "field_key", "enabled", "severity", "mode", "unit", "exact_str", "exact_num", "exact_bool", "one_of", "min", "max"]
ONE_OF = "array<struct<s:string,n:double,b:boolean>>"
# Usual ranges of values.
SANE = {"fontSizePt": (5, 72), "lineHeightPt": (1, 200), "spaceBeforePt": (0, 200), "spaceAfterPt": (0, 200), "firstLineIndentChars": (0, 10), "hangingIndentChars": (0, 10), "leftIndentChars": (0, 10)}
ALIGNMENTS = ["left", "center", "right", "justify"]


def _by_key(values: dict, key: str = "field_key") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def kind_of() -> Column:
    """s, n or b: what values a field takes."""
    return _by_key({k: t for k, (_, t, _) in LEGACY.items()})


def unit_of() -> Column:
    return _by_key({k: u for k, (_, _, u) in LEGACY.items()})


def field_order() -> Column:
    """Place of a field in the fixed order, from 1; unknown fields 0."""
    return F.array_position(F.array(*[F.lit(k) for k in FIELDS]), F.col("field_key"))


def sort_rule_fields(rules: DataFrame, keys: list[str] = []) -> DataFrame:
    """rules with `ord`, the place of each field within its role."""
    return rules.select(*keys, *[c for c in rules.columns if c not in keys], field_order().alias("ord"))


# ---- the older form and back -------------------------------------------------------------------


def normalize_rules(styles: DataFrame, keys: list[str] = []) -> DataFrame:
    """The older form, one row a role with LEGACY columns, → one exact rule a role and field; unset values give disabled rules."""
    rows = []
    for key, (c, kind, unit) in LEGACY.items():
        has = F.col(c).isNotNull() if c in styles.columns else F.lit(False)
        v = lambda k, t: (F.col(c) if c in styles.columns and kind == k else F.lit(None)).cast(t)  # noqa: E731, B023
        rows.append(
            F.struct(
                F.lit(key).alias("field_key"), has.alias("enabled"), F.lit("error" if key in ERROR_FIELDS else "warn").alias("severity"), F.when(has, "exact").otherwise("unset").alias("mode"), F.lit(unit).alias("unit"),
                v("s", "string").alias("exact_str"), v("n", "double").alias("exact_num"), v("b", "boolean").alias("exact_bool"),
            )
        )
    out = styles.select(*keys, "role", F.inline(F.array(*rows)))
    return out.withColumns({"one_of": F.lit(None).cast(ONE_OF), "min": F.lit(None).cast("double"), "max": F.lit(None).cast("double")})


def to_legacy_rules(rules: DataFrame, keys: list[str] = []) -> DataFrame:
    """Only enabled exact rules, one row a role."""
    r = rules.where("enabled and mode = 'exact'")
    pick = {"s": "exact_str", "n": "exact_num", "b": "exact_bool"}
    return r.groupBy(*keys, "role").agg(*[F.max(F.when(F.col("field_key") == k, F.col(pick[kind]))).alias(c) for k, (c, kind, _) in LEGACY.items()])


def normalize_statistics(raw: DataFrame) -> DataFrame:
    """libraries' `keywords`, `abstract` and `references` of the older form → (keys…, metric, min, max).

    Abstracts: the general bound, else the master's, else the doctor's. The
    least number of references: a number, or by degree (master, doctor, else
    the first that is a number). Metrics without a bound are left out.
    """
    keys = [c for c in raw.columns if c not in ("keywords", "abstract", "references")]
    number = lambda c: F.when(F.isnan(c), None).otherwise(c)
    row = lambda m, lo, hi: F.struct(F.lit(m).alias("metric"), number(lo).alias("min"), number(hi).alias("max"))
    rows = []
    for lang in ("cn", "en"):
        k = F.col(f"keywords.{lang}")
        rows.append(row(f"keywords_{lang}", k["recommended_count_min"], k["recommended_count_max"]))
        a = F.col(f"abstract.{lang}.recommended_word_count")
        rows.append(row(f"abstract_{lang}", *[F.coalesce(a[side], a[f"master_{side}"], a[f"doctor_{side}"]) for side in ("min", "max")]))
    count = F.col("references.minimum_count")
    least = F.coalesce(count.try_cast("double"), _degree(count))
    rows.append(row("references", least, F.lit(None).cast("double")))
    rows.append(row("foreign_fraction", F.col("references.minimum_foreign_language_fraction"), F.lit(None).cast("double")))
    out = raw.select(*keys, F.inline(F.array(*rows)))
    return out.where("min is not null or max is not null")


def _degree(count: Column) -> Column:
    """Of {"master": …, "doctor": …, …} as JSON text the first that is a number."""
    by = F.from_json(count, "map<string,string>")
    value = lambda k: F.try_element_at(by, F.lit(k)).try_cast("double")
    rest = F.get(F.filter(F.transform(F.map_values(by), lambda x: x.try_cast("double")), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(value("master"), value("doctor"), rest)


# ---- JSON ----------------------------------------------------------------------------------------

_VALUE = "struct<mode:string,unit:string,exact:variant,oneOf:array<variant>,min:double,max:double>"
_STYLE = ",".join(f"{c}:{ {'s': 'string', 'n': 'double', 'b': 'boolean'}[t] }" for c, t, _ in LEGACY.values())
_COUNT = "struct<recommended_count_min:double,recommended_count_max:double>"
_WORDS = "struct<recommended_word_count:struct<min:double,max:double,master_min:double,master_max:double,doctor_min:double,doctor_max:double>>"
_RANGE = "struct<min:double,max:double>"
#: Both forms in one schema; a text of the editable form has roles, one of the older form styles.
LIBRARY = ", ".join(
    [
        "id string, name string, version string",
        "source struct<provenance:map<string,string>>",
        "document struct<paper_size:string,margin_top_cm:double,margin_bottom_cm:double,margin_left_cm:double,margin_right_cm:double,header_distance_cm:double,footer_distance_cm:double,gutter_cm:double>",
        "headers struct<left_text:string,font_east_asia:string,font_latin:string,size_pt:double,bottom_border:boolean>",
        *[f"{n} struct<front_matter_format:string,body_format:string,body_restart_at:int,alignment:string,font_latin:string,size_pt:double>" for n in ("pageNumbers", "page_numbers")],
        f"roles array<struct<role:string,label:string,fields:array<struct<key:string,label:string,enabled:boolean,severity:string,value:{_VALUE}>>>>",
        f"statistics struct<keywords:struct<cn:{_RANGE},en:{_RANGE}>,abstract:struct<cn:{_RANGE},en:{_RANGE}>,references:struct<min_count:double,min_foreign_fraction:double>>",
        "meta struct<name:string,version:string>",
        f"styles map<string,struct<{_STYLE}>>",
        f"keywords struct<cn:{_COUNT},en:{_COUNT}>",
        f"abstract struct<cn:{_WORDS},en:{_WORDS}>",
        "references struct<minimum_count:string,minimum_foreign_language_fraction:double>",
    ]
)

#: The same without what the roles' fields say: enough for library_settings().
SETTINGS = re.sub(r"roles array<.*>(?=, statistics)", "roles array<struct<role:string>>", LIBRARY)
#: What library_rules() reads alone.
RULES = f"{re.search(r'roles array<.*>(?=, statistics)', LIBRARY)[0]}, {re.search(r'styles map<.*>(?=, keywords)', LIBRARY)[0]}".replace("role:string,label:string", "role:string").replace("key:string,label:string", "key:string")


def scan_rules(texts: DataFrame, schema: str = LIBRARY) -> DataFrame:
    """texts(keys…, value) → keys…, library: rule JSON of whole texts, byte-order mark stripped; text that is no JSON gives null."""
    keys = [c for c in texts.columns if c != "value"]
    plain = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return texts.select(*keys, F.from_json(plain, schema, {"mode": "PERMISSIVE"}).alias("library"))


def _typed(v: Column) -> dict[str, Column]:
    """A JSON value as text, number or truth."""
    kind = F.schema_of_variant(v)
    text, truth = kind == "STRING", kind == "BOOLEAN"
    return {"s": F.when(text, F.try_variant_get(v, "$", "string")), "n": F.when(~text & ~truth, F.try_variant_get(v, "$", "double")), "b": F.when(truth, F.try_variant_get(v, "$", "boolean"))}


def _fields_of(style: Column, kind) -> Column:
    """A role of the older form as fields of the editable form, as normalize_rules() has them; kind: their type."""
    row = lambda of, values: F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in of])
    out = []
    for key, (c, _, unit) in LEGACY.items():
        has = style[c].isNotNull()
        value = {"mode": F.when(has, "exact").otherwise("unset"), "unit": F.lit(unit), "exact": style[c]}
        out.append(row(kind.elementType, {"key": F.lit(key), "enabled": has, "severity": F.lit("error" if key in ERROR_FIELDS else "warn"), "value": row(kind.elementType["value"].dataType, value)}))
    return F.array(*out)


def library_rules(libraries: DataFrame) -> DataFrame:
    """scan_rules() → keys…, RULE: the rules of libraries of both forms."""
    keys = [c for c in libraries.columns if c != "library"]
    roles = libraries.schema["library"].dataType["roles"].dataType.elementType
    fields = roles["fields"].dataType
    # An array is exploded and both forms become the same rows, so that each text is read once, not once a form and filter.
    own = libraries.select(*keys, F.explode(F.array("library")).alias("library"))
    old = F.transform(F.map_entries("library.styles"), lambda e: F.struct(e["key"].alias("role"), _fields_of(e["value"], fields).alias("fields")))
    mine = F.transform("library.roles", lambda r: F.struct(r["role"].alias("role"), r["fields"].alias("fields")))
    role = own.select(*keys, F.inline(F.when(F.col("library.roles").isNotNull(), mine).otherwise(old)))
    field = role.select(*keys, "role", F.inline("fields"))
    exact = _typed(F.col("value.exact"))
    one = F.transform("value.oneOf", lambda v: F.struct(*[c.alias(n) for n, c in _typed(v).items()]))
    return field.select(
        *keys, "role", F.col("key").alias("field_key"), "enabled", "severity", F.col("value.mode").alias("mode"), F.col("value.unit").alias("unit"),
        exact["s"].alias("exact_str"), exact["n"].alias("exact_num"), exact["b"].alias("exact_bool"), one.cast(ONE_OF).alias("one_of"), F.col("value.min").alias("min"), F.col("value.max").alias("max"),
    )


def library_settings(libraries: DataFrame) -> DataFrame:
    """scan_rules() → keys…, id, name, version, document, page_numbers, headers, provenance: what a library says besides its rules, defaults filled in."""
    keys = [c for c in libraries.columns if c != "library"]
    c = lambda n: F.col(f"library.{n}")
    slug = F.regexp_replace(F.lower(c("meta.name")), r"\s+", "-")
    editable = c("roles").isNotNull()
    # Text that is no JSON has no field at all. An array is exploded, so that each text is read once, not once a column.
    some = F.filter(F.array("library"), lambda x: reduce(Column.__or__, [x[f.name].isNotNull() for f in libraries.schema["library"].dataType]))
    return libraries.select(*keys, F.explode(some).alias("library")).select(
        *keys,
        F.when(editable, c("id")).otherwise(F.coalesce(slug, F.lit("rule-library"))).alias("id"),
        F.when(editable, c("name")).otherwise(F.coalesce(c("meta.name"), F.lit("未命名规则库"))).alias("name"),
        F.when(editable, c("version")).otherwise(F.coalesce(c("meta.version"), F.lit("0.0.0"))).alias("version"),
        c("document").alias("document"),
        F.when(editable, c("pageNumbers")).otherwise(c("page_numbers")).alias("page_numbers"),
        c("headers").alias("headers"),
        c("source.provenance").alias("provenance"),
    )


def _json_value(s: Column, n: Column, b: Column) -> Column:
    whole = F.when(n == F.floor(n), n.cast("bigint").cast("variant")).otherwise(n.cast("variant"))
    return F.coalesce(s.cast("variant"), whole, b.cast("variant"))


def sink_rules(rules: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """rules and settings(keys…, id, name, version) → keys…, json: one library of the editable form a row, roles and fields in order."""
    value = F.struct(
        "mode", "unit", _json_value(F.col("exact_str"), F.col("exact_num"), F.col("exact_bool")).alias("exact"),
        F.transform("one_of", lambda x: _json_value(x["s"], x["n"], x["b"])).alias("oneOf"), "min", "max",
    )
    label = F.coalesce(_by_key({k: x[0] for k, x in FIELDS.items()}), F.col("field_key"))
    # Variants have no order: fields are sorted by their place, then their JSON is put together as text. What is collected is worked out before, in generated code.
    field = F.to_json(F.struct(F.col("field_key").alias("key"), label.alias("label"), "enabled", "severity", value.alias("value")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["j"]), ",")
    text = lambda name, c: F.concat(F.lit(f'"{name}":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    r = rules.select(*keys, "role", F.struct(field_order().alias("o"), field.alias("j")).alias("x")).groupBy(*keys, "role").agg(joined("x").alias("fields"))
    r = r.withColumn("j", F.concat(F.lit("{"), text("role", F.col("role")), F.lit(","), text("label", role_label(F.col("role"))), F.lit(',"fields":['), "fields", F.lit("]}")))
    per = r.select(*keys, F.struct("role", "j").alias("x")).groupBy(*keys).agg(joined("x").alias("roles"))
    own = settings.select(*keys, "id", "name", "version").hint("merge").join(per, keys, "left")
    head = F.concat_ws(",", *[text(n, F.col(n).cast("string")) for n in ("id", "name", "version")])
    return own.select(*keys, F.concat(F.lit("{"), head, F.lit(',"roles":['), F.coalesce("roles", F.lit("")), F.lit("]}")).alias("json"))


# ---- lint and publication ------------------------------------------------------------------------


def lint_rules(rules: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys…, level, code, role, field_key, message of each flaw; a library may be published if none is an error."""
    kind, unit = kind_of(), unit_of()
    label = F.coalesce(_by_key({k: x[0] for k, x in FIELDS.items()}), F.col("field_key"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in ("「", label, "」", *parts)])
    flaw = lambda cond, level, code, message: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")))
    on, mode = F.col("enabled"), F.col("mode")
    low, high = _by_key({k: a for k, (a, _) in SANE.items()}), _by_key({k: b for k, (_, b) in SANE.items()})

    def outside(cond: Column, n: Column) -> Column:
        text = said("的值 ", number_text(n), " 超出常见范围 ", low.cast("string"), "~", high.cast("string"), "，请确认")
        return flaw(cond & ((n < low) | (n > high)), "warn", "FIELD_OUT_OF_RANGE", text)

    def no_alignment(cond: Column, s: Column) -> Column:
        return flaw(cond & (F.col("field_key") == "align") & ~s.isin(*ALIGNMENTS), "error", "FIELD_ENUM_INVALID", said("的值「", s, f"」不是合法对齐方式（{' / '.join(ALIGNMENTS)}）"))

    fits = lambda s, n, b: F.when(kind == "s", s.isNotNull()).when(kind == "n", n.isNotNull()).otherwise(b.isNotNull())
    es, en, eb = F.col("exact_str"), F.col("exact_num"), F.col("exact_bool")
    exact = on & (mode == "exact")
    has = F.coalesce(trim_ws(es) != "", F.lit(False)) | en.isNotNull() | eb.isNotNull()
    right = exact & has & fits(es, en, eb)
    some = F.coalesce(F.size("one_of"), F.lit(0)) > 0
    shown = lambda x: F.coalesce(x["s"], number_text(x["n"]), x["b"].cast("string"))
    item = lambda x: F.array_compact(
        F.array(
            flaw(~fits(x["s"], x["n"], x["b"]), "error", "FIELD_TYPE_MISMATCH", said("的候选值「", shown(x), "」类型与字段不匹配")),
            no_alignment(fits(x["s"], x["n"], x["b"]), x["s"]),
            outside(fits(x["s"], x["n"], x["b"]), x["n"]),
        )
    )
    lo, hi, ranged = F.col("min"), F.col("max"), on & (mode == "range")
    number = kind == "n"
    substantive = has | es.isNotNull() | some | lo.isNotNull() | hi.isNotNull()
    single = [
        flaw(on & F.col("unit").isNotNull() & (F.col("unit") != unit), "warn", "FIELD_UNIT_MISMATCH", said("的单位「", F.col("unit"), "」与字段类型不符（应为「", unit, "」）")),
        flaw(on & (mode == "unset"), "warn", "FIELD_ENABLED_BUT_UNSET", said("已启用校验，但规则方式为「不校验」，请改用具体规则或停用该字段")),
        flaw(exact & ~has, "error", "FIELD_EXACT_MISSING", said("选择了精确值，但未填写规则值")),
        flaw(exact & has & ~fits(es, en, eb), "error", "FIELD_TYPE_MISMATCH", said("的规则值类型与字段不匹配")),
        no_alignment(right, es),
        outside(right, en),
        flaw(on & (mode == "oneOf") & ~some, "error", "FIELD_ONEOF_EMPTY", said("选择了候选值之一，但候选列表为空")),
        flaw(ranged & ~number, "error", "FIELD_RANGE_UNIT", said("是非数值字段，不能使用「范围」方式")),
        flaw(ranged & number & lo.isNull() & hi.isNull(), "error", "FIELD_RANGE_EMPTY", said("选择了范围，但未填写上下限")),
        flaw(ranged & number & (lo > hi), "error", "FIELD_RANGE_MINMAX", said("范围下限 ", number_text(lo), " 大于上限 ", number_text(hi))),
        outside(ranged & number, lo),
        outside(ranged & number, hi),
        flaw(~on & (mode != "unset") & substantive, "info", "FIELD_DISABLED_HAS_VALUE", said("已停用，但仍保留规则值，可清理")),
    ]
    candidates = F.when(on & (mode == "oneOf") & some, F.flatten(F.transform("one_of", item))).otherwise(F.array().cast("array<struct<level:string,code:string,message:string>>"))
    own = rules if "unit" in rules.columns else rules.withColumn("unit", F.lit(None).cast("string"))
    rows = own.select(*keys, "role", "field_key", F.inline(F.concat(F.array_compact(F.array(*single)), candidates)))

    size = lambda role: F.max(F.when((F.col("role") == role) & exact & (F.col("field_key") == "fontSizePt"), en))
    body = F.col("role") == "body_text"
    whole = own.groupBy(*keys).agg(F.bool_or(body).alias("_b"), F.bool_or(body & on & F.col("field_key").isin("fontFamilyCn", "fontFamilyLatin")).alias("_f"), size("body_text").alias("_s"), size("heading1").alias("_h"))
    found = lambda cond, level, code, role, key, message: F.when(cond, F.struct(F.lit(role).alias("role"), F.lit(key).cast("string").alias("field_key"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")))
    same = F.concat(F.lit("一级标题字号与正文相同（"), number_text(F.col("_s")), F.lit("pt），可能缺乏层级区分"))
    library = F.array_compact(
        F.array(
            found(~F.col("_b"), "error", "ROLE_REQUIRED_MISSING", "body_text", None, F.lit("缺少必填角色「正文」")),
            found(F.col("_s") == F.col("_h"), "warn", "HIERARCHY_SIZE_SAME", "heading1", "fontSizePt", same),
            found(F.col("_b") & ~F.coalesce("_f", F.lit(False)), "info", "FONT_INCOMPLETE", "body_text", None, F.lit("正文未配置中文/西文字体，字体检测可能不稳定")),
        )
    )
    columns = [*keys, "level", "code", "role", "field_key", "message"]
    return rows.select(*columns).unionByName(whole.select(*keys, F.inline(library)).select(*columns))


def publish_rules(draft: DataFrame, published: DataFrame, lint: DataFrame, at: Column | None = None) -> DataFrame:
    """The versions of every library after publication: published(library_id, version, content, published_at) and a row for each draft(library_id, content) that changes its newest version and has no error in lint(library_id, level).

    The new row has the next version and the time `at` (now, if not given).
    """
    bad = lint.where("level = 'error'").select("library_id").distinct()
    good = draft.hint("merge").join(bad, "library_id", "left_anti").select("library_id", F.col("content").alias("_c"))
    rest = [c for c in published.columns if c != "library_id"]
    newest = published.groupBy("library_id").agg(F.max_by(F.struct(*rest), "published_at").alias("x")).select("library_id", "x.*")
    j = newest.hint("merge").join(good, "library_id").where(F.col("_c") != F.col("content"))
    added = j.select("library_id", bump_version(F.col("version")).alias("version"), F.col("_c").alias("content"), (F.current_timestamp() if at is None else at).alias("published_at"))
    return published.select("library_id", "version", "content", "published_at").unionByName(added)


def parse_scalar_value(raw: Column, unit: str | None) -> Column:
    """struct(s, n, b): typed text as truth, number or text by the field's unit."""
    t = trim_ws(raw)
    low, none_n, none_b = F.lower(t), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    b = F.when(low.isin("true", "1", "是", "yes"), True).when(low.isin("false", "0", "否", "no"), False) if unit == "bool" else none_b
    n = t.try_cast("double") if unit in ("pt", "chars", "level") else none_n
    return F.struct(F.when(b.isNull() & n.isNull(), t).alias("s"), n.alias("n"), b.alias("b"))

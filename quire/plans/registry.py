"""Queries of the library's own operators over the overlay, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import numbering as N
from quire.operators import page as P

from quire.operators import references as X
from quire.operators import report as RP

from quire.operators import roles as R
from quire.operators import rules as RU

from quire.operators import statistics as S
from quire.operators import style_checks as C

from quire.plans import overlay as O
from quire.plans.flow_sql import HEADINGS, RX, ROLES, W, WB, WITH, compact, inline, level, m, num, trim

_Q: dict = {}
_S: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    _Q[name] = fn
    if sql:
        _S[name] = sql


def _par(s, d):
    return O.paragraphs(s, d)


def _roles(s, d):
    return R.classify_roles(O.paragraphs(s, d))


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id")


def _scalars(name: str, cols: dict) -> None:
    """One query of paragraph columns: name → (function that gives the Column, SQL)."""
    _add(
        name,
        lambda s, d: _par(s, d).select("doc_id", "para_index", *[c().alias(k) for k, (c, _) in cols.items()]),
        f"{WITH} select doc_id, para_index, {', '.join(f'{q} as {k}' for k, (_, q) in cols.items())} from par",
    )


def t():
    return F.col("text")


NUM = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"

# ---- roles and sequences --------------------------------------------------------------------
_add("classify_roles", lambda s, d: _roles(s, d).select("doc_id", "para_index", "role", "confidence", "reason", "section"), f"{ROLES} select doc_id, para_index, role, confidence, reason, section from rol")
_special = "role in ('figure_caption', 'table_caption', 'source_note', 'formula_line')"
_add("special_roles", lambda s, d: _roles(s, d).where(_special).select("doc_id", "para_index", "role", "confidence"), f"{ROLES} select doc_id, para_index, role, confidence from rol where {_special}")
_add("appendix_roles", lambda s, d: _roles(s, d).where("role like 'appendix%'").select("doc_id", "para_index", "role", "confidence"), f"{ROLES} select doc_id, para_index, role, confidence from rol where role like 'appendix%'")
_add("role_distribution", lambda s, d: _roles(s, d).groupBy("role").agg(F.count("*").alias("n")), f"{ROLES} select role, count(*) as n from rol group by role")
_add("report_counts", lambda s, d: RP.report_counts(_roles(s, d)), f"{ROLES} select doc_id, count(*) as paragraph_count, count(role) as classified_count from rol group by doc_id")
_add("classified_only", lambda s, d: _roles(s, d).where("role is not null").select("doc_id", "para_index", "role"), f"{ROLES} select doc_id, para_index, role from rol where role is not null")
_add("role_texts", lambda s, d: _roles(s, d).where("role = 'reference_body'").select("doc_id", "para_index", "text"), f"{ROLES} select doc_id, para_index, text from rol where role = 'reference_body'")
_add("check_heading_sequence", lambda s, d: N.check_heading_sequence(_roles(s, d)), f"{HEADINGS} select * from hseq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have broken heading numbers, and how many."""
    return N.check_heading_sequence(_roles(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_errors"))


_add("heading_errors_per_doc", flagship, f"{HEADINGS} select doc_id, count(*) as n_errors from hseq group by doc_id")

# ---- text functions ---------------------------------------------------------------------------
_scalars("compact_text", {"v": (lambda: T.compact_text(t()), compact("text"))})
_scalars("inline_text", {"v": (lambda: T.inline_text(t()), inline("text"))})
_scalars("preview24", {"v": (lambda: T.preview24(t()), f"substr({inline('text')}, 1, 24)")})
_scalars("has_cjk", {"v": (lambda: T.has_cjk(t()), m("text", r"[\x{4E00}-\x{9FFF}]"))})
_scalars("has_latin", {"v": (lambda: T.has_latin(t()), m("text", "[A-Za-z]"))})
_scalars("cjk_count", {"v": (lambda: T.cjk_count(t()), r"len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]'))")})
_EN = "len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*'))"
_scalars("en_word_count", {"v": (lambda: T.en_word_count(t()), _EN)})
_scalars("is_foreign_reference", {"v": (lambda: T.is_foreign_reference(t()), rf"len(regexp_extract_all(text, '[\x{{3400}}-\x{{9FFF}}]')) = 0 and {_EN} >= 3")})


def _kw(prefix: str) -> str:
    body = trim(rf"regexp_replace(regexp_replace(text, '{prefix}', ''), '[。.;；{WB}]+\z', '')")
    return f"len(list_filter(string_split_regex({body}, '[；;、，,]+'), lambda x: {trim('x')} <> ''))"


_CNP, _ENP = rf"^关键词{W}*[:：]?{W}*", rf"(?i)^key{W}*words?{W}*[:：]?{W}*"
_scalars("keyword_items", {"cn": (lambda: T.keyword_items(t(), T.KEYWORD_PREFIX["cn"]), _kw(_CNP)), "en": (lambda: T.keyword_items(t(), T.KEYWORD_PREFIX["en"]), _kw(_ENP))})
_scalars("extract_number", {"v": (lambda: T.extract_number(t()), num("text"))})
_cap = rf"^[图表]{W}*(\d+)(?:[-.](\d+))?"
_major, _minor = (f"try_cast(regexp_extract({trim('text')}, '{_cap}', {i}) as int)" for i in (1, 2))
_CAPNUM = f"case when {m(trim('text'), _cap)} then case when {_minor} is null then [{_major}] else [{_major}, {_minor}] end end"
_scalars("caption_number_text", {"v": (lambda: F.array_join(T.caption_number_text(t()), "-"), f"array_to_string({_CAPNUM}, '-')")})
_scalars("heading_level", {"v": (lambda: T.heading_level(F.col("outline_level"), F.col("style_name")), level())})
_scalars("outline_comparable", {"v": (lambda: T.outline_comparable(F.col("outline_level")), "coalesce(outline_level + 1, 10)")})
_ALIGN = "case alignment when 'both' then 'justify' when 'distribute' then 'justify' when 'start' then 'left' when 'end' then 'right' else alignment end"
_scalars("norm_align", {"v": (lambda: T.norm_align(F.col("alignment")), _ALIGN)})
_scalars("text_patterns", {f"p_{k}": (lambda k=k: T.text_pattern(t(), k), m("text", RX[k])) for k in RX})
_scalars("slugify", {"v": (lambda: T.slugify(t()), rf"regexp_replace(regexp_replace(lower({trim('text')}), '[^a-z0-9\x{{4E00}}-\x{{9FFF}}]+', '-', 'g'), '^-+|-+\z', '', 'g')")})
_ver = lambda: F.concat(F.lit("1."), F.col("v").cast("string"), F.when(F.col("v") == 3, F.lit("b")).otherwise(F.lit("")))
_scalars("bump_version", {"ver": (lambda: T.bump_version(_ver()), "case when v = 3 then '1.3b-1' else '1.' || (v + 1) end")})
_scalars("range_text", {
    "a": (lambda: T.range_text(F.when(F.col("v") > 2, F.col("v").cast("double")), F.when(F.col("v") < 8, F.lit(9.5)), "个"),
          "case when v > 2 and v < 8 then v || '-9.5 个' when v > 2 then '不少于 ' || v || ' 个' else '不超过 9.5 个' end"),
    "b": (lambda: T.percent_text(F.col("v") / F.lit(8.0)), "regexp_replace(regexp_replace(printf('%.2f', v * 100 / 8.0), '0+$', ''), '\\.$', '') || '%'"),
})
_scalars("percent_text", {"p": (lambda: T.percent_text(F.col("v") / F.lit(3.0)), "regexp_replace(regexp_replace(printf('%.2f', v * 100 / 3.0), '0+$', ''), '\\.$', '') || '%'")})
_none = lambda t: F.lit(None).cast(t)
_size = lambda: C.format_value(_none("string"), F.col("size_pt"), _none("boolean"), F.lit("pt"))
_bold = lambda: C.format_value(_none("string"), _none("double"), F.col("bold"), F.lit(""))
_scalars("format_value", {"size": (_size, f"{NUM.format('size_pt')} || 'pt'"), "bold": (_bold, "case when bold then '是' when not bold then '否' else '—' end")})
_cmp = lambda s, n, b, es, en, eb, tol: lambda: C.compare_scalar(*[F.col(x) if x else _none(t) for x, t in ((s, "string"), (n, "double"), (b, "boolean"))], *[F.lit(x).cast(t) for x, t in ((es, "string"), (en, "double"), (eb, "boolean"))], F.lit(tol))
_scalars("compare_scalar", {
    "near": (_cmp(None, "size_pt", None, None, 12.0, None, 0.01), "coalesce(abs(size_pt - 12) <= 0.01, false)"), "same": (_cmp("alignment", None, None, "both", None, None, 0.01), "coalesce(alignment = 'both', false)"),
    "truth": (_cmp(None, None, "bold", None, None, True, 0.01), "coalesce(bold = true, false)"), "kinds": (_cmp(None, "size_pt", None, "12", None, None, 0.01), "false"), "wide": (_cmp(None, "space_before_pt", None, None, 6.5, None, 0.5), "coalesce(abs(space_before_pt - 6.5) <= 0.5, false)"),
})
_raw = lambda: F.element_at(F.array(*[F.lit(x) for x in (" 是 ", "No", "12.50", "x", "1")]), (F.col("v") % 5 + 1).cast("int"))
_scalars("parse_scalar_value", {"b": (lambda: RU.parse_scalar_value(_raw(), "bool")["b"], "case v % 5 when 0 then true when 1 then false when 4 then true end"), "n": (lambda: RU.parse_scalar_value(_raw(), "pt")["n"], "case v % 5 when 2 then 12.5 when 4 then 1.0 end"), "s": (lambda: RU.parse_scalar_value(_raw(), "pt")["s"], "case v % 5 when 0 then '是' when 1 then 'No' when 3 then 'x' end")})
_scalars("issue_key", {"k": (lambda: T.issue_key(F.col("doc_id"), F.col("para_index"), F.col("kind"), F.col("alignment"), T.preview24(t())),
         f"concat_ws('|', doc_id, para_index, kind, coalesce(alignment, ''), replace(replace(replace(replace(replace(replace(url_encode(substr({inline('text')}, 1, 24)), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'))")})
_frag = lambda: F.lit("th e")
_scalars("locate_fragment", {"n": (lambda: F.size(T.locate_fragment(t(), _frag())), rf"len(regexp_extract_all(text, 't{W}*h{W}*e'))"), "first_start": (lambda: F.get(T.locate_fragment(t(), _frag()), F.lit(0))["start"], rf"case when {m('text', f't{W}*h{W}*e')} then length(regexp_extract(text, '^((?s:.*?))t{W}*h{W}*e', 1)) end")})
_bf = rf"len(regexp_extract_all(text, 't{W}*h{W}*e')) = 1"
_bs = rf"length(regexp_extract(text, '^((?s:.*?))t{W}*h{W}*e', 1))"
_scalars("best_fragment", {"first": (lambda: T.best_fragment(t(), _frag())["start"], f"case when {_bf} then {_bs} end"), "past": (lambda: T.best_fragment(t(), _frag())["end"], rf"case when {_bf} then {_bs} + length(regexp_extract(text, 't{W}*h{W}*e')) end")})

# ---- measures ---------------------------------------------------------------------------------
_meas = lambda: F.concat(F.when(F.col("v") == 0, "-").otherwise(""), (F.col("v") * 1.5).cast("decimal(6,1)").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("pt", "cm", "mm", "in", "pc", "", "px")]), (F.col("para_index") % 7 + 1).cast("int")))
_scalars("measure_to_twips", {"tw": (lambda: U.measure_to_twips(_meas()), "case para_index % 7 when 0 then v * 30.0 when 1 then floor(v * 1.5 * 1440 / 2.54 + 0.5) when 2 then floor(v * 1.5 * 1440 / 25.4 + 0.5) when 3 then v * 2160.0 when 4 then v * 360.0 when 5 then v * 1.5 end")})
_scalars("unit_convert", {
    "pt": (lambda: U.twips_to_pt(F.col("v") * 100), "v * 100 / 20.0"), "cm": (lambda: U.js_round(U.twips_to_cm(F.col("v") * 100.0), 2), "floor(v * 100.0 / (1440 / 2.54) * 100 + 0.5) / 100"),
    "half": (lambda: U.half_points_to_pt(F.col("v")), "v / 2.0"), "chars": (lambda: U.hundredths_to_chars(F.col("v")), "v / 100.0"), "wide": (lambda: U.twips_to_chars(F.col("v") * 240.0, F.col("size_pt")), "case when size_pt > 0 then v * 240.0 / 20 / size_pt else 0 end"),
})
_scalars("js_round", {"r": (lambda: U.js_round((F.col("v") - 5) * 0.5, 0), "floor((v - 5) * 0.5 + 0.5)")})
_scalars("line_spacing", {"pt": (lambda: U.line_spacing((F.col("v") * 40).cast("string"), F.when(F.col("v") % 2 == 0, "exact"))["pt"], "case when v % 2 = 0 then v * 2.0 end"), "multiple": (lambda: U.line_spacing((F.col("v") * 40).cast("string"), F.when(F.col("v") % 2 == 0, "exact"))["multiple"], "case when v % 2 = 1 then v * 40 / 240.0 end")})
_scalars("paragraph_numbering", {"num": (lambda: F.when(F.col("num_id").isNotNull() & F.col("ilvl").isNotNull(), F.col("num_id")), "case when num_id is not null and ilvl is not null then num_id end")})

# ---- statistics ---------------------------------------------------------------------------------
_CNT = rf"""{ROLES}, cnt as (select doc_id, cast(sum(case when role = 'keywords_cn' then {_kw(_CNP)} else 0 end) as bigint) as keywords_cn, cast(sum(case when role = 'keywords_en' then {_kw(_ENP)} else 0 end) as bigint) as keywords_en,
 cast(sum(case when role = 'abstract_body_cn' then len(regexp_extract_all(text, '[\x{{3400}}-\x{{9FFF}}]')) else 0 end) as bigint) as abstract_cn, cast(sum(case when role = 'abstract_body_en' then {_EN} else 0 end) as bigint) as abstract_en,
 count(*) filter (where role = 'reference_body') as refs, count(*) filter (where role = 'reference_body' and len(regexp_extract_all(text, '[\x{{3400}}-\x{{9FFF}}]')) = 0 and {_EN} >= 3) as fgn from rol group by doc_id)"""


def _counts(s, d):
    return S.document_counts(_roles(s, d))


def _range(metric, low, high, want, say):
    field, label, unit = S.METRICS[metric]
    cond = " or ".join([f"{metric} < {low}"] * (low is not None) + [f"{metric} > {high}"] * (high is not None))
    return f"{_CNT} select doc_id, '{field}' as field, '{want}' as expected, cast({metric} as varchar) as actual, 'warn' as severity, '{label}应{say}{want}，实际 ' || {metric} || ' {unit}' as message from cnt where {cond}"


_add("check_keyword_count", lambda s, d: S.check_range(_counts(s, d), "keywords_cn", 3, 5), _range("keywords_cn", 3, 5, "3-5 个", "为 "))
_add("check_keyword_count_en", lambda s, d: S.check_range(_counts(s, d), "keywords_en", 4, None), _range("keywords_en", 4, None, "不少于 4 个", ""))
_add("check_abstract_length", lambda s, d: S.check_range(_counts(s, d), "abstract_en", None, 40), _range("abstract_en", None, 40, "不超过 40 词", ""))
_add("check_reference_count", lambda s, d: S.check_reference_count(_counts(s, d), 3), f"{_CNT} select doc_id, 'references_count' as field, '不少于 3 条' as expected, cast(refs as varchar) as actual, 'error' as severity, '参考文献应不少于 3 条，实际 ' || refs || ' 条' as message from cnt where refs < 3")
_PC = "regexp_replace(regexp_replace(printf('%.2f', fgn * 100.0 / refs), '0+$', ''), '\\.$', '') || '%'"
_add("check_foreign_fraction", lambda s, d: S.check_foreign_fraction(_counts(s, d), 0.6), f"{_CNT} select doc_id, 'references_foreign_fraction' as field, '不低于 60%' as expected, {_PC} as actual, 'warn' as severity, '外文参考文献占比应不低于 60%，实际 ' || {_PC} || '（' || fgn || '/' || refs || '）' as message from cnt where refs > 0 and fgn < 0.6 * refs")

# ---- fields, captions, references, notes ---------------------------------------------------------
_FD = rf"""fd0 as (select *, regexp_extract_all({inline('instruction')}, '"[^"]*"|''[^'']*''|[^{WB}]+') as tk from fld),
fd as (select *, upper(coalesce(tk[1], 'UNKNOWN')) as type, case when upper(tk[1]) in ('REF', 'PAGEREF') then trim(tk[2], '"''') end as bookmark, case when upper(tk[1]) = 'SEQ' then trim(tk[2], '"''') end as sequence from fd0)"""
_add("field_descriptor", lambda s, d: X.described(O.fields(_par(s, d))).select("doc_id", "para_index", "type", "bookmark", "sequence"), f"{WITH}, {_FD} select doc_id, para_index, type, bookmark, sequence from fd")
_add("sequence_kind", lambda s, d: X.described(O.fields(_par(s, d))).select("doc_id", "para_index", T.sequence_kind(F.col("sequence")).alias("kind")), f"{WITH}, {_FD} select doc_id, para_index, case when lower(sequence) in ('figure', 'fig') then 'figure' when lower(sequence) in ('table', 'tbl') then 'table' when lower(sequence) in ('equation', 'eq') then 'equation' end as kind from fd")
_CF = r"regexp_replace(regexp_replace(display_text, '^[（(]|[)）]$', '', 'g'), '[－—．]', '-', 'g')"
_CFN = rf"case when regexp_matches({_CF}, '^[-.]*\d+([-.]+\d+)*[-.]*$') then array_to_string(list_filter(string_split_regex({_CF}, '[-.]'), lambda x: x <> ''), '-') end"
_add("caption_number_field", lambda s, d: O.fields(_par(s, d)).select("doc_id", "para_index", F.array_join(T.caption_number_field(F.col("display_text")), "-").alias("v")), f"{WITH} select doc_id, para_index, {_CFN} as v from fld")
_CAND = r"type in ('REF', 'PAGEREF') and coalesce(bookmark, '') <> '' and not (regexp_matches(instruction, '(?i)\\r(\s|$)') and regexp_matches(display_text, '^\[\s*\d+(\s*[-,，]\s*\d+)*\s*\]$'))"
_add("caption_ref_candidates", lambda s, d: X.caption_ref_candidates(X.described(O.fields(_par(s, d)))).select("doc_id", "para_index", "type", "bookmark"), f"{WITH}, {_FD} select doc_id, para_index, type, bookmark from fd where {_CAND}")
_GR = rf"""{ROLES}, {_FD}, cap as (select fd.doc_id, fd.para_index, 'figure' as kind, {_CFN} as parts from fd join rol using (doc_id, para_index) where type = 'SEQ' and lower(sequence) in ('figure', 'fig') and rol.role = 'figure_caption'),
kb as (select distinct doc_id, name from bkm), tg as (select doc_id, name, min(para_index) as target_para from (select distinct doc_id, para_index, name from bkm) join cap using (doc_id, para_index) group by all),
gr as (select fd.doc_id, fd.para_index, type, bookmark, rol.role, kb.name is not null as bookmark_exists, target_para from fd join rol using (doc_id, para_index) left join kb on kb.doc_id = fd.doc_id and kb.name = bookmark left join tg on tg.doc_id = fd.doc_id and tg.name = bookmark where {_CAND})"""


def _graph(s, d):
    p = _par(s, d)
    return X.caption_graph(R.classify_roles(p), X.described(O.fields(p)), O.bookmarks(p))


_add("caption_graph", lambda s, d: _graph(s, d).select("doc_id", "para_index", "type", "bookmark", "role", "bookmark_exists", "target_para"), f"{_GR} select doc_id, para_index, type, bookmark, role, bookmark_exists, target_para from gr")
_RSQL = "select doc_id, para_index, coalesce(role, 'unknown') as role, 'caption_reference' as field, case when bookmark_exists then bookmark || '（存在但不是题注）' else bookmark || '（不存在）' end as actual, case when bookmark_exists then 'warn' else 'error' end as severity, case when bookmark_exists then type || ' 引用的书签「' || bookmark || '」存在，但目标不是图/表/公式题注' else type || ' 引用的书签「' || bookmark || '」不存在' end as message from gr where target_para is null"
_add("check_references", lambda s, d: X.check_references(_graph(s, d)), f"{_GR} {_RSQL}")
_add("field_rows", lambda s, d: O.fields(_par(s, d)).select("doc_id", "para_index", "field_index", "display_text", "start_run", "end_run"), f"{WITH} select doc_id, para_index, field_index, display_text, start_run, end_run from fld")
_add("bookmark_rows", lambda s, d: X.bookmark_rows(O.bookmarks(_par(s, d))), f"{WITH} select distinct * from bkm")
_NL = "case type when 'footnote' then '脚注' else '尾注' end"
_NOTES = f"""lost as (select nref.doc_id, nref.para_index, coalesce(rol.role, 'unknown') as role, 'note_reference' as field, '存在对应' || {_NL} || '定义' as expected, {_NL} || '#' || note_id || '（缺失）' as actual, 'error' as severity, {_NL} || '引用「' || note_id || '」缺少对应定义' as message from nref left join rol using (doc_id, para_index) where not exists (select 1 from ndef x where x.doc_id = nref.doc_id and x.type = nref.type and cast(x.seq as varchar) = nref.note_id)),
idl as (select doc_id, type, count(*) as n, array_to_string(list(cast(seq as varchar) order by seq)[1:5], ', ') as ids from ndef where not exists (select 1 from nref x where x.doc_id = ndef.doc_id and x.type = ndef.type and x.note_id = cast(ndef.seq as varchar)) group by doc_id, type),
nts as (select * from lost union all select doc_id, -1, 'document', 'note_definition', '全部' || {_NL} || '定义均被正文引用', n || ' 条未引用（' || ids || case when n > 5 then ' ...' else '' end || '）', 'info', '检测到 ' || n || ' 条' || {_NL} || '定义未被正文引用' from idl)"""


def _notes(s, d):
    p = _par(s, d)
    return X.check_notes(O.note_refs(p), O.note_defs(p), R.classify_roles(p))


_add("check_notes", _notes, f"{ROLES}, {_NOTES} select * from nts")
_add("note_rows", lambda s, d: O.note_defs(_par(s, d)).select("doc_id", "type", "note_id"), f"{WITH} select doc_id, type, cast(seq as varchar) as note_id from ndef")
_NB = f"case when {trim('text')} <> '' then text end"
_add("neighbour_text", lambda s, d: X.neighbour_text(_par(s, d)), f"{WITH} select doc_id, para_index, last_value({_NB} ignore nulls) over (partition by doc_id order by para_index rows between unbounded preceding and 1 preceding) as prev_text, first_value({_NB} ignore nulls) over (partition by doc_id order by para_index rows between 1 following and unbounded following) as next_text from par")
_add("occurrence_index", lambda s, d: X.occurrence_index(_par(s, d)), f"{WITH} select doc_id, para_index, row_number() over (partition by doc_id, text order by para_index) - 1 as occurrence from par")


def _captions(kind):
    def run(s, d):
        p = _par(s, d)
        r = R.classify_roles(p)
        return N.check_caption_sequence(r, X.captions(r, X.described(O.fields(p))), kind)

    return run


def _caps(role: str, label: str, p: str, fields: str) -> str:
    """Steps of the caption check over rol, with names that start with p; fields: table of numbers that go before the text's."""
    return rf"""{p}0 as (select rol.doc_id, rol.para_index, role, role like 'heading%' and outline_level = 0 as ch, text, coalesce({fields}.parts, array_to_string({_CAPNUM}, '-')) as parts from rol left join {fields} using (doc_id, para_index) where role = '{role}' or (role like 'heading%' and outline_level = 0)),
{p}1 as (select *, sum(case when ch then 1 else 0 end) over (partition by doc_id order by para_index) as g, {num('text')} as hn from {p}0 where ch or parts is not null),
{p}2 as (select *, max(case when ch then hn end) over (partition by doc_id, g) as chapter from {p}1),
{p}3 as (select doc_id, para_index, role, g, chapter, cast(split_part(parts, '-', 1) as int) as major, try_cast(split_part(parts, '-', 2) as int) as minor from {p}2 where not ch),
{p}4 as (select *, coalesce(lag(major) over w, 0) as lm, coalesce(last_value(minor ignore nulls) over (w rows between unbounded preceding and 1 preceding), 0) as ln from {p}3 window w as (partition by doc_id, g order by para_index)),
{p}seq as (select doc_id, para_index, role, 'caption_sequence' as field, cast(lm + 1 as varchar) as expected, cast(major as varchar) as actual, 'error' as severity, '{label}题注编号不连续：期望 ' || (lm + 1) || '，实际 ' || major as message from {p}4 where minor is null and major <> lm + 1
 union all select doc_id, para_index, role, 'caption_sequence', chapter || '-*', major || '-' || minor, 'warn', '{label}题注章节编号与当前章节不符：期望 ' || chapter || '-*，实际 ' || major || '-' || minor from {p}4 where minor is not null and chapter is not null and major <> chapter
 union all select doc_id, para_index, role, 'caption_sequence', major || '-' || (ln + 1), major || '-' || minor, 'error', '{label}题注次编号不连续：期望 ' || major || '-' || (ln + 1) || '，实际 ' || major || '-' || minor from {p}4 where minor is not null and major = lm and minor <> ln + 1
 union all select doc_id, para_index, role, 'caption_sequence', major || '-1', major || '-' || minor, 'error', '{label}题注主编号变化后次编号应从 1 开始：实际 ' || major || '-' || minor from {p}4 where minor is not null and major <> lm and minor <> 1)"""


_FIG = _caps("figure_caption", "图", "cf", "cap")
_TAB = "nocap as (select doc_id, para_index, parts from cap where false), " + _caps("table_caption", "表", "ct", "nocap")
_add("check_caption_sequence", _captions("figure"), f"{_GR}, {_FIG} select * from cfseq")
_add("check_caption_sequence_table", _captions("table"), f"{_GR}, {_TAB} select * from ctseq")

# ---- numbering and lists -----------------------------------------------------------------------
_LEVELS = [("1", 0, 1, "decimal", "%1"), ("2", 0, 1, "bullet", "•"), ("1", 1, 3, "lowerLetter", "%2")]


def _numbering(s, d):
    docs = _docs(s, d)
    lv = F.array(*[F.struct(F.lit(a).alias("abstract_num_id"), F.lit(i).alias("ilvl"), F.lit(st).alias("start"), F.lit(f).alias("num_fmt"), F.lit(x).alias("lvl_text")) for a, i, st, f, x in _LEVELS])
    inst = F.array(*[F.struct(F.lit(n).alias("num_id"), F.lit(a).alias("abstract_num_id")) for n, a in (("1", "1"), ("2", "2"))])
    over = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("1").alias("num_id"), F.lit(0).alias("ilvl"), F.lit(5).alias("start"))
    return docs.select("doc_id", F.inline(inst)), docs.select("doc_id", F.inline(lv)), over


_NUMSQL = f"""lvl(abstract_num_id, ilvl, start, num_fmt, lvl_text) as (values {", ".join(str(x) for x in _LEVELS)}), inst(num_id, abstract_num_id) as (values ('1', '1'), ('2', '2'))"""
_add("resolve_numbering_level", lambda s, d: N.resolve_numbering_level(*_numbering(s, d)), f"with {_NUMSQL} select doc_id, num_id, abstract_num_id, ilvl, case when doc_id % 2 = 0 and num_id = '1' and ilvl = 0 then 5 else start end as start, num_fmt, lvl_text from documents, inst join lvl using (abstract_num_id)")
_LIST = f"{WITH}, {_NUMSQL}, li as (select doc_id, para_index, num_id, ilvl, case num_fmt when 'bullet' then 'unordered' else 'ordered' end as list_type from par join inst using (num_id) join lvl using (abstract_num_id, ilvl))"


def _lists(s, d):
    i, lv, _ = _numbering(s, d)
    return N.recognize_list(_par(s, d), i, lv)


_add("recognize_list", _lists, f"{_LIST} select * from li")
_add("group_lists", lambda s, d: N.group_lists(_lists(s, d)), f"""{_LIST}, l1 as (select *, case when num_id = lag(num_id) over w and list_type = lag(list_type) over w then 0 else 1 end as nw from li window w as (partition by doc_id order by para_index)),
l2 as (select *, sum(nw) over (partition by doc_id order by para_index) as list_no from l1) select doc_id, cast(list_no as bigint) as list_no, num_id, list_type, min(para_index) as first_para, max(para_index) as last_para, count(*) as n_items from l2 group by doc_id, list_no, num_id, list_type""")

# ---- page setup, headers, footers ----------------------------------------------------------------
PAGE_RULES = {"paper_size": "A4", "margin_top_cm": 2.5, "margin_bottom_cm": 2.5, "margin_left_cm": 3.0, "margin_right_cm": 2.5, "header_distance_cm": 1.5, "gutter_cm": 0.0}
NUMBER_RULES = {"front_matter_format": "RomanUpper", "body_format": "Arabic", "body_restart_at": 1}
_CM = "floor({0} / (1440 / 2.54) * 100 + 0.5) / 100"
_LAST = "ls as (select * from sec where section_index = 1)"
_dim = " union all ".join(
    f"select doc_id, '{k}' as field, '{NUM_V}' as expected, {NUM.format(_CM.format(c))} as actual, '{lab}应为 {NUM_V}cm，实际 ' || {NUM.format(_CM.format(c))} || 'cm' as message from ls where abs({_CM.format(c)} - {PAGE_RULES[k]}) > 0.05"
    for k, (c, lab) in P.DIMENSIONS.items()
    if k in PAGE_RULES
    for NUM_V in [str(PAGE_RULES[k]).removesuffix(".0")]
)
_SZ = f"{NUM.format(_CM.format('page_width'))} || '×' || {NUM.format(_CM.format('page_height'))} || 'cm'"
_PAGE = f"{_LAST}, pg as ({_dim} union all select doc_id, 'paper_size', 'A4 (21×29.7cm)', {_SZ}, '纸张应为 A4 (21×29.7cm)，实际 ' || {_SZ} from ls where abs({_CM.format('page_width')} - 21) > 0.1 or abs({_CM.format('page_height')} - 29.7) > 0.1)"
_add("check_page_setup", lambda s, d: P.check_page_setup(O.sections(_par(s, d)), PAGE_RULES), f"{WITH}, {_PAGE} select * from pg")
_PN = """pn0 as (select doc_id, string_agg(coalesce(number_format, 'decimal'), ',' order by section_index) as formats, bool_or(number_format = 'upperRoman') as front, bool_or(coalesce(number_format, 'decimal') = 'decimal' and coalesce(number_start = 1, false)) as body from sec group by doc_id),
pn1 as (select documents.doc_id, coalesce(formats, '') as actual, coalesce(front, false) as front, coalesce(body, false) as body from documents left join pn0 using (doc_id)),
pnn as (select doc_id, actual, 'page_number_front' as field, 'RomanUpper' as expected, '前置部分页码应使用 RomanUpper（upperRoman），未找到对应分节' as message from pn1 where not front
 union all select doc_id, actual, 'page_number_body', 'Arabic start=1', '正文页码应为 Arabic（decimal）并从 1 重新编号' from pn1 where not body)"""
_add("check_page_numbers", lambda s, d: P.check_page_numbers(_docs(s, d), O.sections(_par(s, d)), NUMBER_RULES), f"{WITH}, {_PN} select * from pnn")


def _segs(s, d):
    return P.hf_align(O.hf_tokens(_par(s, d)))


# Of the overlay's tokens only two paragraphs part at a gap: '左      右侧文字' (left, gap, right).
_SEG = """sg0 as (select *, sum(case when tok_kind = 'tab' then 1 else 0 end) over (partition by doc_id, kind, part, para order by tok) as z, sum(case when tok_kind = 'tab' then 1 else 0 end) over (partition by doc_id, kind, part, para) as tabs,
 case when para_alignment = 'end' then 'right' when para_alignment in ('left', 'center', 'right') then para_alignment else 'left' end as base from tok),
sg1 as (select *, tabs = 0 and base = 'left' and tok_kind = 'text' and regexp_matches(text, ' {4,}') as sp from sg0 where tok_kind <> 'tab'),
seg as materialized (select doc_id, kind, part, para, tok, 0 as seg, tok_kind as seg_kind, text, instruction, case when tabs >= 2 and z = 1 then 'center' when tabs > 0 and z > 0 then 'right' when tabs > 0 then 'left' else base end as alignment, font_east_asia, font_ascii, font_hansi, size_pt, border_style from sg1 where not sp
 union all select doc_id, kind, part, para, tok, unnest([0, 1, 2]), tok_kind, unnest([regexp_extract(text, '^(.*?) {4,}', 1), regexp_extract(text, ' {4,}'), regexp_extract(text, ' {4,}(.*)$', 1)]), instruction, unnest(['left', 'left', 'right']), font_east_asia, font_ascii, font_hansi, size_pt, border_style from sg1 where sp),
rl0 as (select doc_id, kind, part, para, string_agg(seg_kind || ':' || alignment || ':' || text || ':' || instruction, '|' order by tok, seg) as k, bool_or(seg_kind = 'pageNumber') as has, bool_or({TRIM_TEXT} <> '') as any_text, max(border_style) as border_style from seg group by doc_id, kind, part, para),
kept as (select * from (select *, row_number() over (partition by doc_id, kind, part, k order by para) as rn from rl0 where has or any_text) where rn = 1)""".replace("{TRIM_TEXT}", trim("text"))
_add("hf_align", lambda s, d: _segs(s, d).select("doc_id", "kind", "part", "para", "tok", "seg", "seg_kind", "text", "alignment"), f"{WITH}, {_SEG} select doc_id, kind, part, para, tok, seg, seg_kind, text, alignment from seg")
_sd = lambda a: inline(f"coalesce(string_agg(text, '' order by tok, seg) filter (where alignment = '{a}' and seg_kind = 'text'), '')")
_ag = lambda a: inline(f"coalesce(string_agg({a}, ' ' order by para) filter (where {a} <> ''), '')")
_ROLL = f"""rl1 as (select doc_id, kind, part, para, any_value(has) as has, {_sd('left')} as l, {_sd('center')} as c, {_sd('right')} as r from seg join kept using (doc_id, kind, part, para) group by doc_id, kind, part, para),
roll as (select doc_id, kind, part, {_ag('l')} as left_text, {_ag('c')} as center_text, {_ag('r')} as right_text, bool_or(has) as has_page_number from rl1 group by doc_id, kind, part)"""
_add("hf_rollup", lambda s, d: P.hf_rollup(_segs(s, d)), f"{WITH}, {_SEG}, {_ROLL} select * from roll")
_add("hf_border", lambda s, d: O.hf_tokens(_par(s, d)).where("kind = 'header' and tok = 0").select("doc_id", "part", "para", P.border_visible(F.col("border_style")).alias("visible")), f"{WITH} select doc_id, part, para, coalesce(border_style not in ('none', 'nil'), false) as visible from tok where kind = 'header' and tok = 0")
_add("check_header_text", lambda s, d: P.check_header_text(_docs(s, d), P.hf_rollup(_segs(s, d)), "某某大学 论文"), f"""{WITH}, {_SEG}, {_ROLL}, ht as (select doc_id, bool_or(contains({compact('left_text')}, '某某大学论文')) as ok, string_agg(case when left_text = '' then '(左侧无文字)' else left_text end, ' / ' order by part) as actual from roll where kind = 'header' group by doc_id)
select d.doc_id, 'header_text' as field, '某某大学 论文' as expected, coalesce(nullif(actual, ''), '(无页眉文字)') as actual, 'warn' as severity, '页眉应包含「某某大学 论文」' as message from documents d left join ht using (doc_id) where not coalesce(ok, false)""")


def _segsql(field, value, shown, ok, expected, header):
    severity, say = P.HF_CHECKS[field]
    cond = f"kind = 'header' and seg_kind = 'text' and {trim('text')} <> ''" if header else "seg_kind = 'pageNumber'"
    return f"""{WITH}, {_SEG}, s1 as (select *, {shown} as v, {value} as val, (case kind when 'header' then 1 else 0 end) as h from seg join kept using (doc_id, kind, part, para) where {cond}),
s2 as (select doc_id, v, min((h, part, para, tok, seg)) as f from s1 where v is not null group by doc_id, v), s3 as (select doc_id, string_agg(v, ' / ' order by f) as actual from s2 group by doc_id), s4 as (select doc_id, bool_and(coalesce({ok}, false)) as ok from s1 group by doc_id)
select d.doc_id, '{field}' as field, '{expected}' as expected, coalesce(actual, '(未设置)') as actual, '{severity}' as severity, '{say.format(expected)}' as message from documents d left join s4 using (doc_id) left join s3 using (doc_id) where not coalesce(ok, false)"""


_latin = lambda: F.coalesce("font_ascii", "font_hansi")
_SEGMENT_CHECKS = [
    ("check_header_fonts", "header_font_east_asia", lambda: F.col("font_east_asia"), "宋体", True, "font_east_asia", "val = '宋体'"),
    ("check_header_fonts_latin", "header_font_latin", _latin, "Times New Roman", True, "coalesce(font_ascii, font_hansi)", "val = 'Times New Roman'"),
    ("check_header_size", "header_size_pt", lambda: F.col("size_pt"), 9.0, True, "size_pt", "abs(val - 9) <= 0.1"),
    ("check_page_number_style", "page_number_alignment", lambda: F.col("alignment"), "right", False, "alignment", "val = 'right'"),
    ("check_page_number_font", "page_number_font_latin", _latin, "Times New Roman", False, "coalesce(font_ascii, font_hansi)", "val = 'Times New Roman'"),
    ("check_page_number_size", "page_number_size_pt", lambda: F.col("size_pt"), 9.0, False, "size_pt", "abs(val - 9) <= 0.1"),
]
for _n, _f, _c, _e, _h, _v, _ok in _SEGMENT_CHECKS:
    _num = isinstance(_e, float)
    _add(_n, lambda s, d, f=_f, c=_c, e=_e, h=_h: P.check_segments(_docs(s, d), P.hf_kept(_segs(s, d)), f, c(), e, h), _segsql(_f, _v, NUM.format(_v) if _num else _v, _ok, "9" if _num else _e, _h))
_HB = "hb as (select doc_id, count(*) as m, count(*) filter (where coalesce(border_style not in ('none', 'nil'), false)) as n from kept where kind = 'header' group by doc_id)"
_HBQ = "select d.doc_id, 'header_bottom_border' as field, 'true' as expected, coalesce(n, 0) || '/' || coalesce(m, 0) as actual, 'warn' as severity, '页眉下方应设置边框线' as message from documents d left join hb using (doc_id) where not (coalesce(m, 0) > 0 and coalesce(n, 0) = coalesce(m, 0))"
_add("check_header_border", lambda s, d: P.check_header_border(_docs(s, d), _segs(s, d), True), f"{WITH}, {_SEG}, {_HB} {_HBQ}")

HEADER_RULES = {"left_text": "某某大学 论文", "font_east_asia": "宋体", "font_latin": "Times New Roman", "size_pt": 9.0, "bottom_border": True, "number_alignment": "right", "number_font_latin": "Times New Roman", "number_size_pt": 9.0}
_HEADER_SQL = [_S[n] for n in ("check_header_text", "check_header_border", *[n for n, *_ in _SEGMENT_CHECKS])]
_LOW = "doc_id, {0} as check_seq, -1 as para_index, 'document' as role, field, {1} as severity, {2} as message"
#: All checks but those of paragraph fields, as al0.
CORPUS_SQL = f"""{_GR}, {_FIG}, {_TAB}, {HEADINGS[len(ROLES) + 1:]}, {_NOTES}, {_PAGE}, {_PN}, {_CNT[len(ROLES) + 1:]},
al0 as (select {_LOW.format(1, "'error'", 'message')} from pg union all select {_LOW.format(2, "'error'", 'message')} from pnn
 {" ".join(f"union all select {_LOW.format(3, 'severity', 'message')} from ({q})" for q in _HEADER_SQL)}
 union all select doc_id, 4, para_index, role, field, severity, message from hseq union all select doc_id, 5, para_index, role, field, severity, message from cfseq union all select doc_id, 6, para_index, role, field, severity, message from ctseq
 union all select doc_id, 7, para_index, role, field, severity, message from ({_RSQL}) union all select doc_id, 8, para_index, role, field, severity, message from nts
 union all select {_LOW.format(9, 'severity', 'message')} from (select doc_id, 'keywords_cn_count' as field, 'warn' as severity, '中文关键词数量应为 3-5 个，实际 ' || keywords_cn || ' 个' as message from cnt where keywords_cn < 3 or keywords_cn > 5)
 union all select {_LOW.format(9, 'severity', 'message')} from (select doc_id, 'abstract_en_words' as field, 'warn' as severity, '英文摘要词数应不超过 40 词，实际 ' || abstract_en || ' 词' as message from cnt where abstract_en > 40)
 union all select {_LOW.format(9, 'severity', 'message')} from (select doc_id, 'references_count' as field, 'error' as severity, '参考文献应不少于 3 条，实际 ' || refs || ' 条' as message from cnt where refs < 3)
 union all select {_LOW.format(9, 'severity', 'message')} from (select doc_id, 'references_foreign_fraction' as field, 'warn' as severity, '外文参考文献占比应不低于 60%，实际 ' || {_PC} || '（' || fgn || '/' || refs || '）' as message from cnt where refs > 0 and fgn < 0.6 * refs))"""


def queries() -> dict:
    from quire.plans import registry_more, registry_word

    registry_more.add(_add)
    registry_word.add(_add)
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_S)

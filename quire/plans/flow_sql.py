"""The comparison SQL of the shared stages, built on the overlay tables."""

from __future__ import annotations

from quire.functions.text import PATTERNS, WS, WS_BODY
from quire.plans.overlay import SQL as OVERLAY

W = WS.replace(r"\x0B", r"\v")
WB = WS_BODY.replace(r"\x0B", r"\v")
RX = {k: v.replace(r"\x0B", r"\v").replace("一-鿿", r"\x{4E00}-\x{9FFF}") for k, v in PATTERNS.items()}


def m(expr: str, pattern: str) -> str:
    """expr matches pattern, as SQL."""
    return f"regexp_matches({expr}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def compact(e: str) -> str:
    return f"regexp_replace({e}, '{W}+', '', 'g')"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^{W}+|{W}+\\z', '', 'g')"


def inline(e: str) -> str:
    return trim(f"regexp_replace({e}, '{W}+', ' ', 'g')")


def num(e: str) -> str:
    """Number of a heading text."""
    s = trim(e)
    cn, ar, mu, si, pa = r"^第?([一二三四五六七八九十]+)[章节条款]", rf"^第?{W}*(\d+){W}*[章节条款]", r"^(\d+(?:\.\d+)+)[^\d]", rf"^(\d+)(?:[.、]|{W}+[^{WB}])", r"^(?:\((\d+)\)|（(\d+)）)"
    x = lambda p, g=1: f"regexp_extract({s}, '{p}', {g})"
    return (
        f"case when {m(s, cn)} then nullif(case when length({x(cn)}) = 1 then position({x(cn)} in '一二三四五六七八九十') else 0 end, 0)"
        f" when {m(s, ar)} then try_cast({x(ar)} as int) when {m(s, mu)} then try_cast(list_extract(string_split({x(mu)}, '.'), -1) as int)"
        f" when {m(s, si)} then try_cast({x(si)} as int) when {m(s, pa)} then try_cast({x(pa)} || {x(pa, 2)} as int) end"
    )


def level(o="outline_level", n="style_name") -> str:
    return "case " + " ".join(f"when {o} = {i} or {m(f'lower(coalesce({n}, {chr(39)*2}))', rf'heading{W}*{i + 1}|标题{W}*{i + 1}')} then {i}" for i in range(3)) + " end"


WITH = f"with {OVERLAY}"
ROLES = rf"""{WITH},
r0 as (select *, {compact('text')} as t, {inline('text')} as il from par),
r1 as (select *, not in_table and t <> '' as act, {level()} as lvl,
  case when in_table or t = '' then null when t = '摘要' then 'abstract_title_cn' when {m('t', '(?i)^abstract$')} then 'abstract_title_en' when t = '目录' then 'toc_title' when t = '参考文献' then 'reference_heading'
    when {m('t', RX['acknowledgement'])} then 'acknowledgement_heading' when {m('t', RX['appendix'])} then 'appendix_heading' when {m('t', RX['achievement'])} then 'achievement_heading' end as head,
  lower(coalesce(style_id, '')) in ('toc1', 'toc2', 'toc3') as toc,
  case when {m('t', '^关键词')} then 'keywords_cn' when {m('t', '(?i)^keywords')} then 'keywords_en' end as kw,
  num_id is not null and ilvl is not null as numbered,
  lag(drawing_count) over (partition by doc_id order by para_index) as dp, lead(drawing_count) over (partition by doc_id order by para_index) as dn from r0),
r2 as (select *, case when lvl is not null and length(t) <= 80 then 'appendix_subheading' when numbered or {m('t', RX['list_marker'])} or {m('t', RX['material'])} then 'appendix_list_item'
    when length(t) <= 50 and ({m('t', RX['signature'])} or {m('t', RX['date'])}) then 'appendix_signature' end as app,
  sum(case when head is not null then 1 else 0 end) over (partition by doc_id order by para_index) as g from r1),
r3 as (select *, coalesce(case first_value(head) over (partition by doc_id, g order by para_index) when 'abstract_title_cn' then 'cn_abstract' when 'abstract_title_en' then 'en_abstract' when 'toc_title' then 'toc'
    when 'reference_heading' then 'references' when 'acknowledgement_heading' then 'acknowledgement' when 'appendix_heading' then 'appendix' when 'achievement_heading' then 'achievement' end, 'cover') as s0 from r2),
r4 as (select *, act and head is null and s0 <> 'cover' and not toc and kw is null and lvl is not null and not (s0 = 'appendix' and app is not null) as esc from r3),
r5 as (select *, case when coalesce(bool_or(esc) over (partition by doc_id, g order by para_index rows between unbounded preceding and 1 preceding), false) then 'body' else s0 end as sec,
  coalesce(dp, 0) > 0 or coalesce(dn, 0) > 0 as near, math_count > 0 or object_count > 0 as fs from r4),
r6 as (select *, case when near and {m('il', RX['figure_relaxed'])} and length(il) <= 80 and alignment in ('center', 'left', 'right') then 'figure_caption/high' when {m('il', RX['figure'])} and length(il) <= 80 then case when near then 'figure_caption/high' else 'figure_caption/low' end
    when {m('il', RX['table'])} and length(il) <= 80 then 'table_caption/low' when {m('il', RX['source'])} and length(il) <= 120 then 'source_note/low'
    when {m('il', RX['equation'])} and ({m('il', RX['operator'])} or fs) and len(regexp_extract_all(il, '[\x{{4E00}}-\x{{9FFF}}]')) <= 4 and (coalesce(alignment in ('center', 'right'), false) or length(il) <= 80) then case when fs then 'formula_line/high' else 'formula_line/low' end end as sp from r5),
rol as materialized (select *,
  case when in_table then 'table_cell' when t = '' then null when head is not null then head when sec = 'cover' then null when toc then lower(style_id) when kw is not null then kw when sec = 'appendix' and app is not null then app
    when lvl is not null then 'heading' || (lvl + 1) when sec = 'body' and sp is not null then split_part(sp, '/', 1)
    when sec <> 'body' then case sec when 'cn_abstract' then 'abstract_body_cn' when 'en_abstract' then 'abstract_body_en' when 'references' then 'reference_body' when 'acknowledgement' then 'acknowledgement_body' when 'appendix' then 'appendix_body' when 'achievement' then 'achievement_body' end
    when {m('t', RX['cover'])} and length(t) < 25 then null else 'body_text' end as role,
  case when in_table or t = '' or head is not null or sec = 'cover' or toc then 'high' when kw is not null then 'medium' when sec = 'appendix' and app is not null then case when app = 'appendix_subheading' or (app = 'appendix_list_item' and numbered) then 'high' else 'medium' end
    when lvl is not null then 'high' when sec = 'body' and sp is not null then split_part(sp, '/', 2) when sec <> 'body' then 'high' when {m('t', RX['cover'])} and length(t) < 25 then 'medium' else 'high' end as confidence,
  case when in_table then '表格单元格结构标记' when t = '' then '空段落' when head is not null then '明确章节标题关键词命中' when sec = 'cover' then '摘要前封面区跳过' when toc then '目录样式明确命中' when kw is not null then '关键词文本模式命中'
    when sec = 'appendix' and app is not null then case when app = 'appendix_subheading' then '附录上下文内由大纲级别或标题样式判断' when app = 'appendix_signature' then '附录上下文内由短落款或日期模式判断' when numbered then '附录上下文内由自动编号判断' else '附录上下文内由清单文本模式判断' end
    when lvl is not null then '大纲级别或标题样式明确命中'
    when sec = 'body' and sp is not null then case sp when 'figure_caption/high' then 'drawing 邻接结构信号支持图题注判断' when 'source_note/low' then '仅按资料来源文本模式判断' when 'formula_line/high' then 'OMML 或嵌入对象结构信号支持公式行判断' when 'formula_line/low' then '仅按文本公式编号模式判断' else '仅按文本题注模式判断' end
    when sec <> 'body' then '由明确章节上下文判断' when {m('t', RX['cover'])} and length(t) < 25 then '疑似封面字段，跳过正文规则' else '由正文标题上下文判断' end as reason,
  case when esc then 'body' else sec end as section from r6)"""

HEADINGS = rf"""{ROLES},
h0 as (select doc_id, para_index, role, outline_level as lv, {num('text')} as num from rol where role like 'heading%' and outline_level <= 8),
h1 as (select *, (select count(*) from h0 x where x.doc_id = h0.doc_id and x.para_index <= h0.para_index and x.lv < h0.lv) as seg from h0),
h2 as (select *, coalesce(last_value(num ignore nulls) over (partition by doc_id, lv, seg order by para_index rows between unbounded preceding and 1 preceding), 0) + 1 as expected from h1),
hseq as (select doc_id, para_index, role, 'heading_sequence' as field, cast(expected as varchar) as expected, cast(num as varchar) as actual, 'error' as severity,
  (lv + 1) || ' 级标题编号不连续：期望 ' || expected || '，实际 ' || num as message from h2 where num is not null and num <> expected)"""

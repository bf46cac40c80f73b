"""Queries over Word files and over whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import alignment as AL
from quire.operators import numbering as N
from quire.operators import page as P
from quire.operators import references as X
from quire.operators import report as RP
from quire.plans import files as FI
from quire.plans import incremental as IN
from quire.plans import overlay as O
from quire.plans import validate as V
from quire.plans.flow_sql import WITH, compact, inline, trim
from quire.plans.registry_more import _ISS, issues
from quire.sources import docx as D
from quire.sources import tables as TB
from quire.sources.word import tables_of, with_styles


# ---- blocks of another rendering --------------------------------------------------------------------


#: What the other rendering does to a paragraph: some are left out, some stand in longer blocks, some are cut short.
BLOCK_TEXT = "case when para_index % 5 = 1 then concat('- ', text, ' (more)') when para_index % 7 = 3 then concat(substring(text, 1, 40), ' …') else text end"


def found_blocks(spark, sf_dir):
    p = O.paragraphs(spark, sf_dir).select("doc_id", "para_index", "text")
    targets = X.numbered(X.neighbours(p))
    blocks = p.where("para_index % 4 <> 2").select("doc_id", (F.col("para_index") * 2).cast("long").alias("block_index"), F.expr(BLOCK_TEXT).alias("text"))
    return AL.find_blocks(targets, blocks)


_NEIGHBOUR = "{0}(case when norm <> '' then norm end ignore nulls) over (partition by doc_id order by {1} rows between {2})"
_SIDES = lambda order: f"coalesce({_NEIGHBOUR.format('last_value', order, 'unbounded preceding and 1 preceding')}, '') as prev, coalesce({_NEIGHBOUR.format('first_value', order, '1 following and unbounded following')}, '') as next"
FOUND_BLOCKS_SQL = f"""{WITH}, p as (select doc_id, para_index, text, {compact('text')} as norm, row_number() over (partition by doc_id, text order by para_index) - 1 as o from par),
t as (select *, left(norm, 18) as key, {_SIDES('para_index')} from p),
blk as (select doc_id, cast(para_index * 2 as bigint) as block_index, {compact(BLOCK_TEXT)} as norm from par where para_index % 4 <> 2),
b as (select *, {_SIDES('block_index')} from blk),
e as (select t.doc_id, t.para_index, b.block_index, b.prev, b.next from t join b on t.doc_id = b.doc_id and t.norm = b.norm where length(key) >= 3),
r as (select * from t where length(key) >= 3 and (doc_id, para_index) not in (select (doc_id, para_index) from e)),
c as (select *, 'exact' as step from e union all select r.doc_id, r.para_index, b.block_index, b.prev, b.next, 'part' from r join b on r.doc_id = b.doc_id and contains(b.norm, r.key)),
n as (select c.*, row_number() over (partition by doc_id, para_index order by block_index) - 1 as bo from c),
s as (select n.doc_id, n.para_index, block_index, step, row_number() over (partition by n.doc_id, n.para_index order by case when t.prev <> '' and t.prev = n.prev then 2 else 0 end + case when t.next <> '' and t.next = n.next then 2 else 0 end desc, abs(bo - o), block_index) as rn from n join t using (doc_id, para_index))
select t.doc_id, t.para_index, coalesce(block_index, -1) as block_index, step from t left join (select * from s where rn = 1) s using (doc_id, para_index)"""


# ---- reports ------------------------------------------------------------------------------------------


def grouped(by: str, sort_by: str):
    def run(spark, sf_dir):
        g = RP.ordered_groups(issues(spark, sf_dir), by, sort_by)
        return g.select("doc_id", F.col("position").cast("long").alias("position"), "key", "label", "n", F.array_join("messages", "|").alias("messages"))

    return run


def groups_sql(by: str, sort_by: str, issue_sql: str) -> str:
    severity = "case severity when 'error' then 0 when 'warn' then 1 else 2 end"
    para = "case when para_index < 0 then 2147483647 else para_index end"
    first = f"{para}, {severity}" if sort_by == "paragraph" else f"{severity}, {para}"
    if by == "severity":
        key, labels, place = "severity", RP.SEVERITY_LABELS, f"list_position([{', '.join(repr(x) for x in RP.SEVERITIES)}], key)"
    else:
        key, labels, place = "field", RP.FIELD_LABELS, "label collate zh, key"
    label = "case key " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + " else key end"
    return f"""{issue_sql}, g as (select doc_id, {key} as key, count(*) as n, string_agg(message, '|' order by {first}, role, field, message) as messages from iss group by doc_id, {key}),
h as (select *, {label} as label from g)
select doc_id, row_number() over (partition by doc_id order by {place}) as position, key, label, n, messages from h"""


SUMMARY_SQL = """{issues}, i as (select doc_id, severity, field from iss),
s as (select doc_id, severity, field, count(*) as n, grouping_id(doc_id, severity, field) as g from i group by grouping sets ((doc_id, severity), (doc_id, field), (severity), (field), ()))
select case g when 1 then 'document_severity' when 2 then 'document_field' when 5 then 'severity' when 6 then 'field' else 'all' end as level, doc_id, severity, field, n from s"""


def summary(spark, sf_dir):
    return TB.sink_summary(issues(spark, sf_dir), TB.folder(spark, "issue-summary"))[1]


# ---- Word files ---------------------------------------------------------------------------------------


def kept_files(spark, sf_dir, only=None):
    """The files made of the documents, a row each, stored; only: facts that are asked for."""
    return TB.stored(D.extract_documents(FI.MadeFiles(spark.read.parquet(f"{sf_dir}/documents.parquet")), only), "word-files")


def words(spark, sf_dir, only=None):
    """The files made of the documents as tables."""
    return tables_of(kept_files(spark, sf_dir, only))


#: Facts that effective properties come from, and those of numbering.
_INHERITED, _NUMBERS = {"style", "default"}, {"num_level", "num_instance", "num_override"}


def borders(spark, sf_dir):
    return P.hf_borders(words(spark, sf_dir, {"hf_token"} | _INHERITED).tokens).where("kind = 'header'")


BORDERS_SQL = """with l as (select doc_id, len(string_split(coalesce(text, ''), chr(10))) as m from documents)
select doc_id, 'header' as kind, 0 as part, 0 as para, 'single' as style, cast(case m % 4 when 3 then null when 2 then 0 else 4 + m % 6 end as double) as size,
  case when m % 2 = 1 then (m % 10) || '0FF00' end as color, case when m % 3 > 0 then m % 3 + 0.5 end as space, true as visible from l"""


#: The tables of the files, as the overlay's: par, fld, bkm, run, nref, ndef, sec, tok. A row a line (i from 0, of n characters, with the runs l and r; m lines), then the cell.
_CTRL = r"[\x00-\x1F\x{FFFE}\x{FFFF}]"
_SIZE = f"case when {trim('l')} = '' and {trim('r')} <> '' then (20 + n % 4) / 2.0 when i = 0 then (28 + m % 5) / 2.0 else 10.5 end"
_R2 = lambda e: f"floor({e} * 100 + 0.5) / 100"
WORD_SQL = f"""wl as (select doc_id, coalesce(text, '') as whole, string_split(coalesce(text, ''), chr(10)) as lines from documents),
w0 as (select doc_id, whole, len(lines) as m, unnest(lines) as line, unnest(range(0, len(lines))) as i from wl),
w1 as (select *, length(line) as n, regexp_replace(line[1:8], '{_CTRL}', '', 'g') as l, regexp_replace(line[9:], '{_CTRL}', '', 'g') as r, case when m % 2 = 1 then 'Arial' else 'Calibri' end as latin from w0),
w2 as (select *, {_SIZE} as sz from w1),
par as materialized (
  select doc_id, cast(i as int) as para_index, l || r as text, false as in_table, cast(case when i = 0 then m % 3 else 0 end as int) as drawing_count, 0 as math_count, 0 as object_count,
    case when i = 0 then 0 end as outline_level, case when i = 0 then 'H1' end as style_id, case when i = 0 then 'heading 1' end as style_name, '宋体' as font_east_asia, latin as font_ascii, cast(sz as double) as size_pt,
    case when {trim('l')} = '' and {trim('r')} <> '' then n % 2 = 1 when i = 0 then true end as bold, case when i = 0 then 'center' end as alignment, cast(case when i = 0 then 20.0 end as double) as line_pt,
    cast(case when i > 0 then (240 + n % 5 * 60) / 240.0 end as double) as line_multiple, cast(case when i > 0 then n % 7 end as double) as space_before_pt, cast(6.0 as double) as space_after_pt,
    cast(case when i = 0 then 0.0 else {_R2('21.0 / sz')} end as double) as first_line_chars, cast(case when i > 0 then (n % 3) * 50 / 100.0 end as double) as hanging_chars, cast(case when i > 0 then {_R2('(n % 50) / sz')} end as double) as left_chars,
    case when i = 0 then '1' end as num_id, case when i = 0 then 0 end as ilvl from w2
  union all select doc_id, cast(m as int), 'cell', true, 0, 0, 0, null, null, null, '宋体', latin, 10.5, null, null, 20.0, null, null, 6.0, 2.0, null, null, null, null from w2 where i = 0),
fld as (select doc_id, cast(m - 1 as int) as para_index, 0 as field_index, 'REF _Ref1' as instruction, '' as display_text, 0 as start_run, 0 as end_run from w1 where i = 0),
bkm as (select doc_id, 0 as para_index, '1' as id, '_Ref1' as name from w1 where i = 0),
run as (
  select doc_id, cast(i as int) as para_index, 0 as run_index, l as text, '宋体' as font_east_asia, latin as font_ascii, cast(case when i = 0 then (28 + m % 5) / 2.0 else 10.5 end as double) as size_pt, case when i = 0 then true end as bold from w1
  union all select doc_id, cast(i as int), 1, r, '宋体', latin, (20 + n % 4) / 2.0, n % 2 = 1 from w1
  union all select doc_id, cast(m as int), 0, 'cell', '宋体', latin, 10.5, null from w1 where i = 0),
nref as (select doc_id, 0 as para_index, 'footnote' as type, '2' as note_id, 1 as run_index from w1 where i = 0),
ndef as (select doc_id, 'footnote' as type, unnest([2, 3]) as seq from w1 where i = 0),
sec as (select doc_id, 1 as section_index, 11906.0 as page_width, 16838.0 as page_height, cast(1000 + length(whole) % 500 as double) as margin_top, 1440.0 as margin_bottom, 1701.0 as margin_left, 1417.0 as margin_right,
  cast(null as double) as header, cast(null as double) as footer, cast(null as double) as gutter, 'decimal' as number_format, 1 as number_start from w1 where i = 0),
tk as (select *, case when l = '' then 0 else 1 end as k from w1 where i = 0),
tok as (select doc_id, kind, 0 as part, 0 as para, cast(tok as int) as tok, tok_kind, text, para_alignment, '宋体' as font_east_asia, latin as font_ascii, latin as font_hansi, cast(10.5 as double) as size_pt, instruction, border_style from (
  select doc_id, latin, 'header' as kind, 0 as tok, 'text' as tok_kind, l as text, cast(null as varchar) as para_alignment, '' as instruction, 'single' as border_style from tk where l <> ''
  union all select doc_id, latin, 'header', k, 'tab', '', null, '', 'single' from tk union all select doc_id, latin, 'header', k + 1, 'text', '论文', null, '', 'single' from tk
  union all select doc_id, latin, 'footer', 0, 'pageNumber', '1', 'center', 'PAGE', null from tk))"""


#: Where rules come from, by role and by field; a blank text doesn't count.
SOURCES = ([("body_text", "a")], [("margin_top_cm", "b"), ("header_text", "c"), ("size_pt", "a")], [("a", " 第三章 "), ("b", "页面设置"), ("c", "  ")])


def sources(spark):
    roles, fields, texts = SOURCES
    return spark.createDataFrame(roles, "role string, key string"), spark.createDataFrame(fields, "field string, key string"), spark.createDataFrame(texts, "key string, text string")


def word_issues(spark, sf_dir, provenance=False):
    """All checks over the files made of the documents."""
    from quire.plans.registry import HEADER_RULES, NUMBER_RULES, PAGE_RULES
    from quire.plans.registry_more import rules

    stats = {"ranges": {"keywords_cn": (3, 5), "abstract_en": (None, 40)}, "min_references": 3, "min_foreign": 0.6}
    found = V.validate_corpus(words(spark, sf_dir), rules(spark), PAGE_RULES, NUMBER_RULES, HEADER_RULES, stats, sources=sources(spark) if provenance else None)
    return found.select("doc_id", "check_seq", "para_index", "role", "field", "severity", "message", "role_confidence", "fixability", *(["provenance"] if provenance else []))


def word_numbering(spark, sf_dir):
    w = words(spark, sf_dir, _NUMBERS)
    return N.resolve_numbering_level(w.instances, w.levels, w.overrides)


def word_lists(spark, sf_dir):
    w = words(spark, sf_dir, {"paragraph", "run"} | _INHERITED | _NUMBERS)
    return N.group_lists(N.recognize_list(w.paragraphs, w.instances, w.levels))


def word_styles(spark, sf_dir):
    """Styles with inherited values, from the style arrays of the files."""
    s = with_styles(kept_files(spark, sf_dir, _INHERITED).where("code = 'ok'")).select(F.col("id").alias("doc_id"), F.explode("_styles").alias("s"))
    return s.select("doc_id", "s.style_id", "s.name", "s.size_pt", "s.bold", "s.alignment", F.col("s.line.pt").alias("line_pt"), "s.outline_level", "s.first_twips", "s.first_chars")


def word_header_parts(spark, sf_dir):
    return P.hf_rollup(P.hf_align(words(spark, sf_dir, {"hf_token"} | _INHERITED).tokens))


LINES_SQL = "ln as (select doc_id, len(string_split(coalesce(text, ''), chr(10))) as m from documents)"
NUMBERING_SQL = f"with {LINES_SQL} select doc_id, '1' as num_id, '0' as abstract_num_id, 0 as ilvl, cast(1 + m % 9 as int) as start, 'decimal' as num_fmt, '%1.' as lvl_text from ln"
LISTS_SQL = "select doc_id, cast(1 as bigint) as list_no, '1' as num_id, 'ordered' as list_type, 0 as first_para, 0 as last_para, cast(1 as bigint) as n_items from documents"
STYLES_SQL = f"""with {LINES_SQL} select doc_id, 'Normal' as style_id, 'Normal' as name, cast(null as double) as size_pt, cast(null as boolean) as bold, cast(null as varchar) as alignment, 20.0 as line_pt, cast(null as int) as outline_level, 420.0 as first_twips, cast(null as double) as first_chars from ln
union all select doc_id, 'H1', 'heading 1', (28 + m % 5) / 2.0, true, 'center', 20.0, 0, 420.0, 0.0 from ln"""
HEADER_PARTS_SQL = f"""with {WORD_SQL} select doc_id, 'header' as kind, 0 as part, {inline('l')} as left_text, '' as center_text, '论文' as right_text, false as has_page_number from tk
union all select doc_id, 'footer', 0, '', '', '', true from tk"""


#: A second state of the documents: of every third one the text has grown.
GROWN = "case when doc_id % 3 = 0 then concat(coalesce(text, ''), ' more') else text end"
_ISSUE = "doc_id long, check_seq int, para_index int, role string, field string, actual string, severity string, message string"


def rerun_issues(spark, sf_dir):
    """Page setup after two runs over the files; the second one has the grown texts, and checks those alone."""
    from quire.plans.registry import PAGE_RULES

    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), TB.folder(spark, "runs")
    check = lambda word: V.issue_row(P.check_page_setup(word.sections, PAGE_RULES), 1, "error")
    IN.run_checks(FI.word_files(docs), root, 1, check)
    IN.run_checks(FI.word_files(docs.withColumn("text", F.expr(GROWN))), root, 2, check)
    return IN.current_issues(spark, root, _ISSUE).select("doc_id", "run_id", "field", "actual", "message")


def rerun_sql(page_sql: str) -> str:
    grown = WORD_SQL.replace("from documents", f"from (select doc_id, {GROWN} as text from documents)")
    return f"with {grown}, {page_sql} select doc_id, cast(case when doc_id % 3 = 0 then 2 else 1 end as bigint) as run_id, field, actual, message from pg"


def add(put) -> None:
    from quire.plans.registry import _PAGE, _S

    put("validate_word_files", word_issues, _S["validate_corpus"].replace(O.SQL, WORD_SQL))
    word_sql = _S["validate_word_files"].removesuffix("select * from al")
    source = "case when role = 'body_text' or field = 'size_pt' then '第三章' when field = 'margin_top_cm' then '页面设置' end"
    put("validate_with_sources", lambda s, d: word_issues(s, d, True), f"{word_sql} select *, {source} as provenance from al")
    put("rerun_issues", rerun_issues, rerun_sql(_PAGE))
    put("word_numbering", word_numbering, NUMBERING_SQL)
    put("word_lists", word_lists, LISTS_SQL)
    put("word_styles", word_styles, STYLES_SQL)
    put("word_header_parts", word_header_parts, HEADER_PARTS_SQL)
    put("find_blocks", found_blocks, FOUND_BLOCKS_SQL)
    put("hf_border_details", borders, BORDERS_SQL)
    put("sink_summary_sets", summary, SUMMARY_SQL.format(issues=_ISS))
    for by in ("severity", "field"):
        for sort_by in ("paragraph", "severity"):
            put(f"ordered_groups_{by}_by_{sort_by}", grouped(by, sort_by), groups_sql(by, sort_by, _ISS))

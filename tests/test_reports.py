"""Report order, summaries and clustered tables."""

from __future__ import annotations

ISSUES = "doc_id long, para_index int, role string, field string, severity string, message string"
ROWS = [
    (1, 3, "body_text", "size_pt", "error", "a"), (1, 1, "body_text", "bold", "warn", "b"), (1, 1, "body_text", "own_field", "error", "c"), (1, -1, "document", "paper_size", "error", "d"),
    (1, 1, "heading1", "font_latin", "warn", "e"), (1, 2, "body_text", "size_pt", "warn", "f"), (2, 0, "body_text", None, None, "g"),
]


def test_groups_by_label_in_chinese_order(spark):
    from quire.operators.report import ordered_groups

    g = ordered_groups(spark.createDataFrame(ROWS, ISSUES), "field").where("doc_id = 1").orderBy("position").collect()
    # jia cu, xi wen, zhi zhang, zi hao; Latin letters after all of them.
    assert [(r.position, r.label, list(r.messages)) for r in g] == [(1, "加粗", ["b"]), (2, "西文字体", ["e"]), (3, "纸张", ["d"]), (4, "字号", ["f", "a"]), (5, "own_field", ["c"])]


def test_groups_sorted_by_severity(spark):
    from quire.operators.report import ordered_groups

    d = spark.createDataFrame(ROWS, ISSUES)
    role = {r.key: list(r.messages) for r in ordered_groups(d, "role", "severity").where("doc_id = 1").collect()}
    assert role == {"heading1": ["e"], "body_text": ["c", "a", "b", "f"], "document": ["d"]}
    place = {r.key: r.position for r in ordered_groups(d, "severity").where("doc_id = 1").collect()}
    assert place == {"error": 1, "warn": 2}
    assert ordered_groups(d.limit(0), "section").collect() == []


def test_summary_in_the_writing_job(spark, tmp_path):
    from quire.sources.tables import sink_summary

    back, summary, totals = sink_summary(spark.createDataFrame(ROWS, ISSUES), f"file://{tmp_path}/out")
    assert totals == {"n": 7, "error": 3, "warn": 3, "info": 0, "other": 1}
    assert back.count() == 7
    got = {(r.level, r.doc_id, r.severity, r.field): r.n for r in summary.collect()}
    assert got["all", None, None, None] == 7 and got["severity", None, "error", None] == 3 and got["document_severity", 2, "unknown", None] == 1
    assert got["document_field", 1, None, "size_pt"] == 2 and got["field", None, None, "size_pt"] == 2 and sum(n for k, n in got.items() if k[0] == "field") == 7


def test_clustered_tables_need_no_exchange_for_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quire.sources.tables import clustered

    t = clustered(spark.range(100).select((F.col("id") % 7).alias("doc_id"), F.col("id").cast("int").alias("para_index")), "probe")
    w = t.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_index")))
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()
    assert w.agg(F.max("n")).first()[0] == 15


def test_header_checks_from_one_row_a_document(spark):
    from quire.operators import page as P

    schema = "doc_id long, kind string, part int, para int, tok int, tok_kind string, text string, instruction string, para_alignment string, border_style string, font_east_asia string, font_ascii string, font_hansi string, size_pt double"
    rows = [
        (1, "header", 0, 0, 0, "text", "某某大学", "", "left", "single", "宋体", "Times", None, 9.0), (1, "header", 0, 1, 0, "text", "某某大学", "", "left", "none", "黑体", "Times", None, 9.0),
        (1, "footer", 0, 0, 0, "pageNumber", "1", "PAGE", "center", None, None, None, "Arial", 9.05),
        (2, "header", 0, 0, 0, "text", "other", "", "center", None, None, None, None, None), (2, "header", 1, 0, 0, "text", "  ", "", "left", "single", "宋体", None, None, None),
    ]
    docs, tokens = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), spark.createDataFrame(rows, schema)
    rules = {"left_text": "某某 大学", "font_east_asia": "宋体", "font_latin": "Times", "size_pt": 9, "bottom_border": True, "number_alignment": "center", "number_font_latin": "Arial", "number_size_pt": 9}
    got = {(r.doc_id, r.field): r.actual for r in P.check_header_footer(docs, tokens, rules).collect()}
    unset = {"header_font_east_asia", "header_font_latin", "header_size_pt", "page_number_alignment", "page_number_font_latin", "page_number_size_pt"}
    want = {(d, f): "(未设置)" for d in (2, 3) for f in unset}
    want |= {(2, "header_text"): "(左侧无文字)", (3, "header_text"): "(无页眉文字)", (2, "header_bottom_border"): "0/1", (3, "header_bottom_border"): "0/0"}
    assert got == want  # the second header paragraph of document 1 repeats the first and goes
    kept = P.hf_kept(P.hf_align(tokens))
    one = [P.check_header_text(docs, P.hf_rollup(kept), rules["left_text"]), P.check_header_border(docs, kept, True)]
    for key, (field, value, header) in P.SEGMENT_RULES.items():
        one.append(P.check_segments(docs, kept, field, value(), float(rules[key]) if key.endswith("size_pt") else rules[key], header))
    assert {(r.doc_id, r.field, r.actual, r.message) for x in one for r in x.collect()} == {(r.doc_id, r.field, r.actual, r.message) for r in P.check_header_footer(docs, tokens, rules).collect()}


def test_border_details(spark):
    from quire.sources.word import js_number

    d = spark.createDataFrame([(x,) for x in ("4", " 4.5 ", "", "1e2", ".5", "thick", "1d", "NaN", None)], "x string")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(js_number(F.col("x"))).collect()] == [4.0, 4.5, 0.0, 100.0, 0.5, None, None, None, None]


def test_rules_come_before_the_join_with_runs(spark):
    from quire.operators.references import described
    from quire.operators.style_checks import RULE_SCHEMA, check_fields

    none = {"font_east_asia": None, "font_ascii": None, "bold": None, "alignment": None, "line_pt": None, "line_multiple": 1.5, "space_before_pt": None, "space_after_pt": None, "first_line_chars": None, "hanging_chars": None, "left_chars": None, "outline_level": None}
    schema = "doc_id long, para_index int, role string, text string, size_pt double, font_east_asia string, font_ascii string, bold boolean, alignment string, line_pt double, line_multiple double, space_before_pt double, space_after_pt double, first_line_chars double, hanging_chars double, left_chars double, outline_level int"
    roles = spark.createDataFrame([{"doc_id": 1, "para_index": i, "role": r, "text": "\u6587 a", "size_pt": 9.0} | none for i, r in enumerate(["body_text", "body_text", None])], schema)
    runs = spark.createDataFrame([(1, 0, 0, "\u6587", None, None, 12.0), (1, 0, 1, " a", None, None, 8.0), (1, 1, 0, "  ", None, None, 8.0), (1, 2, 0, "a", None, None, 8.0)], "doc_id long, para_index int, run_index int, text string, font_east_asia string, font_ascii string, size_pt double")
    rules = spark.createDataFrame([("body_text", "fontSizePt", True, "error", "exact", None, 12.0, None, None, None, None), ("body_text", "lineHeightPt", True, "warn", "exact", None, 20.0, None, None, None, None)], RULE_SCHEMA)
    found = check_fields(roles, runs, rules)
    # The run of the first paragraph decides on its size, the blank one of the second doesn't.
    want = [(0, "line_spacing_pt", "1.5 \u500d", None), (0, "size_pt", "8pt", 1), (1, "line_spacing_pt", "1.5 \u500d", None), (1, "size_pt", "9pt", None)]
    shown = lambda df: sorted((r.para_index, r.field, r.shown, r.start_run) for r in df.collect())
    assert shown(found) == want
    named = runs.join(roles.select("doc_id", "para_index", "role"), ["doc_id", "para_index"])
    assert shown(check_fields(roles, named, rules)) == want
    # An anti join would be taken to before the rules, where it moves every value.
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    seq = described(spark.createDataFrame([(1, 'SEQ "Fig" x'), (2, "REF 'a b'"), (3, None)], "k int, instruction string")).where("type <> 'PAGE'")
    assert [tuple(r)[2:] for r in seq.sort("k").collect()] == [("SEQ", None, "Fig"), ("REF", "a b", None), ("UNKNOWN", None, None)]
    assert seq._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_overlay_tables_need_no_exchange(spark):
    from quire.plans import overlay

    w = overlay.word(spark, "/root/testdata/sf0.001")
    assert "role" in w.paragraphs.columns and "role" in w.runs.columns
    counts = w.runs.groupBy("doc_id", "para_index").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert w.paragraphs.count() * 3 == w.runs.count() and w.documents.count() == 200

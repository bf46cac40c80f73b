"""What rule libraries say besides their rules."""

from __future__ import annotations

from quire.operators.rules import LIBRARY, SETTINGS, library_settings, scan_rules

TEXTS = [
    '{"id":"a","name":"A","version":"2.0","roles":[{"role":"body_text","fields":[{"key":"bold","value":{"exact":true,"min":1}}]}],"headers":{"size_pt":9}}',
    '{"roles":[]}',
    '{"meta":{"name":"Old One"},"styles":{"body_text":{"size_pt":12}},"document":{"margin_top_cm":2.5}}',
    '{"statistics":{}}',
    "no json",
    "{}",
    None,
]


def test_settings_need_no_fields_and_each_text_is_read_once(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k int, value string")
    wide, narrow = (library_settings(scan_rules(texts, x)) for x in (LIBRARY, SETTINGS))
    rows = {r.k: r for r in wide.collect()}
    assert rows == {r.k: r for r in narrow.collect()}
    assert {k: (r.id, r.name, r.version) for k, r in rows.items()} == {0: ("a", "A", "2.0"), 1: (None, None, None), 2: ("old-one", "Old One", "0.0.0"), 3: ("rule-library", "未命名规则库", "0.0.0")}
    assert "exact" in LIBRARY and "exact" not in SETTINGS
    assert narrow._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_rules_of_both_forms_are_read_once(spark):
    from quire.operators.rules import LEGACY, RULES, library_rules

    texts = [
        *enumerate(TEXTS),
        (7, '﻿{"roles":[{"role":"r","fields":[{"key":"align","enabled":true,"severity":"warn","value":{"mode":"oneOf","oneOf":["left",2,false]}},{"key":"fontSizePt","value":{"mode":"exact","exact":10.5}},{"key":"x","value":{"exact":"12"}}]},{"role":"none"}],"styles":{"not":{"bold":true}}}'),
        (8, '{"styles":{"old":{"bold":false,"alignment":"left","size_pt":12},"null":null}}'),
    ]
    libraries = scan_rules(spark.createDataFrame(texts, "k int, value string"), RULES)
    found = library_rules(libraries)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    rows = found.collect()
    wide = library_rules(scan_rules(spark.createDataFrame(texts, "k int, value string")))
    assert sorted(map(str, rows)) == sorted(map(str, wide.collect()))
    of = lambda k, role: [r for r in rows if (r.k, r.role) == (k, role)]
    assert {(r.k, r.role) for r in rows} == {(0, "body_text"), (2, "body_text"), (7, "r"), (8, "old"), (8, "null")}
    assert [(r.field_key, r.exact_bool, r.min) for r in of(0, "body_text")] == [("bold", True, 1.0)]
    align, size, x = of(7, "r")
    assert [tuple(v) for v in align.one_of] == [("left", None, None), (None, 2.0, None), (None, None, False)] and (align.mode, align.enabled) == ("oneOf", True)
    assert (size.exact_num, size.enabled, x.exact_str, x.exact_num) == (10.5, None, "12", None)
    old = {r.field_key: r for r in of(8, "old")}
    assert list(old) == list(LEGACY) and (old["bold"].exact_bool, old["align"].exact_str, old["fontSizePt"].exact_num, old["fontSizePt"].severity) == (False, "left", 12.0, "error")
    assert {r.field_key for r in old.values() if r.enabled} == {"bold", "align", "fontSizePt"} and all(r.mode == ("exact" if r.enabled else "unset") for r in old.values())
    assert len(of(8, "null")) == 12 and not any(r.enabled for r in of(8, "null"))

"""Facts of Word files: those that are asked for, in batches of bounded size."""

from __future__ import annotations

from quire.plans.files import BROKEN, broken_file, word_file
from quire.sources.docx import SCHEMAS, extract_documents, extract_facts, file_codes, open_parts, facts_of


def files(spark):
    rows = [(i, bytearray(word_file(t))) for i, t in enumerate(["one\ntwo", "", None, "第一行\nb\nc <&> \x01"])]
    return spark.createDataFrame(rows + [(-1 - i, bytearray(broken_file(c))) for i, c in BROKEN.items()], "id long, content binary")


def test_facts_asked_for_are_those_of_all(spark):
    f = files(spark)
    every = extract_facts(f).collect()
    for fact in SCHEMAS:
        want = {tuple(r) for r in every if r.fact in (fact, "file")}
        assert {tuple(r) for r in extract_facts(f, {fact}).collect()} == want, fact
        if fact not in ("run", "field", "bookmark", "note_ref"):
            assert {r.id: getattr(r, fact) for r in extract_documents(f, {fact}).select("id", fact).collect()}.keys() == {r.id for r in f.collect()}


def test_documents_with_facts_asked_for(spark):
    f = files(spark)
    every, some = ({r.id: r.asDict(True) for r in extract_documents(f, only).collect()} for only in (None, {"section", "style"}))
    for key, row in every.items():
        assert (some[key]["section"], some[key]["style"], some[key]["code"]) == (row["section"], row["style"], row["code"])
        assert not some[key]["hf_token"] and not some[key]["paragraph"]


def test_codes_without_facts(spark):
    f = files(spark)
    assert {tuple(r) for r in file_codes(f).collect()} == {(r.id, r.code) for r in extract_facts(f).collect()}


def test_batches_are_bounded(spark):
    # Many files in one incoming batch, and one file of many facts, leave in batches of some thousand facts.
    import pyarrow as pa

    raw = word_file("\n".join(f"line {i}" for i in range(30_000)))
    n = sum(1 for _ in facts_of(open_parts(raw)))
    sizes = []

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw], pa.binary())], names=["id", "content"])
            sizes.extend(b.num_rows for b in run(iter([batch])))

    extract_facts(Files())
    assert sum(sizes) == n > 90_000 and max(sizes) <= 20_000


def test_parts_not_asked_for_are_checked_but_not_built(spark):
    # A part that can't be read counts whatever is asked for; none that no fact asks for becomes a tree.
    import io
    import zipfile

    raw = word_file("one\ntwo")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    assert "document" not in open_parts(raw, {"theme"}) and "document" in open_parts(raw, {"run"})

    def code(**changed):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, xml in (parts | {f"word/{n}.xml": x for n, x in changed.items()}).items():
                z.writestr(name, xml)
        found = []
        for only in (None, set(), {"theme"}, {"run"}, {"style"}):
            try:
                open_parts(buf.getvalue(), only)
                found.append("ok")
            except Exception as e:
                found.append(str(e))
        assert len(set(found)) == 1, found
        return found[0]

    assert code() == "ok"
    assert code(styles=b"<a>") == code(document=b"<a>" + b" " * 99) == code(header1=b"<x:a/>") == "CORRUPT"
    assert code(document=b"<a><b><body/></b></a>") == "NOT_DOCX"
    assert code(document=b'<!DOCTYPE a [<!ENTITY e "x">]><a>&f;</a>') == "CORRUPT"


def test_files_are_made_and_read_in_one_worker(spark):
    # One Python step a task, with the rows of two.
    from quire.plans.files import MadeFiles, word_files

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one\ntwo", "", None, "第一行\nb\nc <&> \x01", "x"])], "doc_id long, text string")
    one, two = extract_facts(MadeFiles(docs)), extract_facts(word_files(docs))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert (plan(one), plan(two)) == (1, 2)


def test_facts_without_payloads(spark):
    """Counts need no payloads: they are neither written as JSON nor passed on, and all else is the same."""
    from quire.plans.files import MadeFiles

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one\ntwo", "", None, "第一行\nb\nc <&> \x01", "x"])], "doc_id long, text string")
    full, bare = extract_facts(MadeFiles(docs)).collect(), extract_facts(MadeFiles(docs), payloads=False, held=1).collect()
    assert sorted(tuple(r)[:4] for r in bare) == sorted(tuple(r)[:4] for r in full)
    assert not any(r.payload for r in bare) and all((r.payload is None) == (r.fact == "file") for r in full)


def test_measures_are_worked_out_once(spark):
    """Generated code for each copy of a measure took every task seconds."""
    from pyspark.sql import functions as F
    from quire.functions.units import line_spacing, measure_to_twips
    from quire.sources.word import para_columns

    said = "".join(str(c) for c in para_columns("p").values())
    assert said.count("regexp_extract(") <= 11 * 6  # of six measures; 187 before
    rows = spark.createDataFrame([("12pt", "exact"), (" 240 ", None), ("-0", "auto"), ("2.5cm", "atLeast"), ("x", "exact"), ("", None), (None, "exact"), ("1.2.3", "atLeast")], "s string, r string")
    got = rows.select(measure_to_twips(F.col("s")).alias("t"), line_spacing(F.col("s"), F.col("r")).alias("l")).collect()
    assert [r.t for r in got] == [240.0, 240.0, 0.0, 1417.0, None, None, None, None]
    assert [r.l and (r.l.value, r.l.rule, r.l.pt, r.l.multiple) for r in got] == [(240.0, "exact", 12.0, None), (240.0, "auto", None, 1.0), (0.0, "auto", None, 0.0), (1417.0, "atLeast", 70.85, None), None, None, None, None]

"""Runs over changing files check only what is new, and a repeated run adds nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import page as P
from quire.plans import incremental as IN
from quire.plans import validate as V
from quire.plans.files import word_file

ISSUE = "doc_id long, check_seq int, para_index int, role string, field string, actual string, severity string, message string"


class Check:
    def __init__(self):
        self.calls = []

    def __call__(self, word):
        self.calls.append(sorted(r[0] for r in word.documents.collect()))
        return V.issue_row(P.check_page_setup(word.sections, {"margin_top_cm": 2.0}), 1, "error")


def files(spark, rows):
    return spark.createDataFrame([(i, None if t is None else word_file(t)) for i, t in rows], "id long, content binary")


def now(spark, root):
    return {(r.doc_id, r.actual, r.run_id) for r in IN.current_issues(spark, root, ISSUE).collect()}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_only_changes_are_checked(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(IN, "MAX_BROADCAST_IDS", limit)
    root, check = f"file://{tmp_path}/runs", Check()
    first = [(1, "a"), (2, "b" * 134), (3, "c" * 200), (4, None)]  # 1000 twips and a character each; 1134 are 2 cm
    assert now(spark, root) == set()
    assert IN.run_checks(files(spark, first), root, 1, check) == 4
    assert check.calls == [[1, 2, 3]] and now(spark, root) == {(1, "1.77", 1), (3, "2.12", 1)}
    # The same files, and the same run again: nothing starts.
    assert IN.run_checks(files(spark, first), root, 2, check) == 0 and IN.run_checks(files(spark, [(9, "z")]), root, 1, check) == 0
    assert len(check.calls) == 1 and now(spark, root) == {(1, "1.77", 1), (3, "2.12", 1)}
    # 1 is mended, 2 breaks, 5 is new; 3 stays.
    assert IN.run_checks(files(spark, [(1, "x" * 134), (2, "b"), (3, "c" * 200), (5, "y")]), root, 3, check) == 3
    assert check.calls[1] == [1, 2, 5] and now(spark, root) == {(2, "1.77", 3), (3, "2.12", 1), (5, "1.77", 3)}
    # The whole corpus without 2 and 4.
    assert IN.run_checks(files(spark, [(1, "x" * 134), (3, "c" * 200), (5, "y")]), root, 4, check, whole=True) == 2
    assert now(spark, root) == {(3, "2.12", 1), (5, "1.77", 3)}
    # Another library knows none of them yet.
    assert IN.run_checks(files(spark, [(5, "y")]), root, 5, check, library_id="other") == 1
    assert {(r.doc_id, r.library_id) for r in IN.current_issues(spark, root, ISSUE).collect()} == {(3, "default"), (5, "default"), (5, "other")}


def test_a_run_that_died_before_its_commit_is_written_anew(spark, tmp_path):
    root, check = f"file://{tmp_path}/runs", Check()

    def dies(word):
        check(word).withColumn("library_id", F.lit("default")).write.parquet(f"{root}/issues/run_id=1/library=default")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        IN.run_checks(files(spark, [(1, "a"), (2, "b")]), root, 1, dies)
    assert now(spark, root) == set()
    assert IN.run_checks(files(spark, [(1, "a"), (2, "b")]), root, 1, check) == 2
    assert now(spark, root) == {(1, "1.77", 1), (2, "1.77", 1)}


def test_repeated_rows_and_no_rows(spark, tmp_path):
    root, check = f"file://{tmp_path}/runs", Check()
    assert IN.run_checks(files(spark, []) if False else spark.createDataFrame([], "id long, content binary"), root, 1, check) == 0 and not check.calls
    assert IN.run_checks(files(spark, [(1, "a"), (1, "a"), (1, "bb")]), root, 2, check) == 1
    assert check.calls == [[1]] and len(now(spark, root)) == 1


def test_arriving_files(spark, tmp_path):
    from quire.streaming.checks import check_folder

    folder, root, check = tmp_path / "in", f"file://{tmp_path}/runs", Check()
    folder.mkdir()

    def arrive(**names):
        for name, text in names.items():
            (folder / f"{name}.docx").write_bytes(word_file(text))
        q = check_folder(spark, str(folder), root, check, str(tmp_path / "ck"))
        q.awaitTermination()

    arrive(a="a", b="b" * 134)
    assert len(check.calls[0]) == 2 and len(now(spark, root)) == 1
    arrive(c="c")
    assert len(check.calls) == 2 and len(check.calls[1]) == 1 and len(now(spark, root)) == 2

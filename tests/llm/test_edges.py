"""Nulls, long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pandas as pd
import pytest

from tests.llm.test_operators import text

CLASH = "doc_id long, text string, TEXT string, _gone int, _n int, n_chars long, Doc_ID string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "other", 7, 8, len(t or ""), "z") for i, t in rows], CLASH)


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    from quire.llm.line_dedup import drop_lines

    a, b, c, d = (f"{x} line of some length that has no twin at all" for x in ("first", "second", "third other", "a fourth one"))
    rows = [(1, a), (5, f"{c}\n{a}"), (5, f"{d}\n{b}"), (5, f"{c}\n{a}")]
    got = Counter((r.doc_id, r.text, r.n_gone) for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, a, 0): 1, (5, c, 1): 2, (5, f"{d}\n{b}", 0): 1})


def test_line_dedup_keeps_other_columns(spark):
    from quire.llm.line_dedup import clean_lines

    line = "a line of some length that comes again and again"
    out = clean_lines(clashing(spark, [(1, line), (2, f"{line}\nkept"), (3, line), (4, None), (None, line), (6, "")]))
    assert out.columns == [x.split()[0] for x in CLASH.split(", ")]
    got = {r[0]: (r[1], r[2], r[3], r[4], r[5], r[6]) for r in out.collect()}
    assert got == {None: (line, "other", 7, 8, len(line), "z"), 2: ("kept", "other", 7, 8, 4, "z"), 4: (None, "other", 7, 8, None, "z"), 6: ("", "other", 7, 8, 0, "z")}


def test_one_of_each_of_rows_that_share_a_doc_id(spark):
    from quire.llm.ngram_join import one_of_each

    r = random.Random(2)
    x, y, z = text(r, 60), text(r, 60), text(r, 60)
    rows = [(1, x), (1, y), (1, y), (2, x), (3, y + " end"), (4, z), (5, None), (6, "..."), (6, "..."), (None, x), (None, z)]
    out = one_of_each(clashing(spark, rows))
    assert out.columns == [c.split()[0] for c in CLASH.split(", ")]
    got = Counter((row[0], row[1]) for row in out.collect())
    assert got == Counter([(1, x), (1, y), (4, z), (5, None), (6, "...")])


def test_quality_and_decontamination_keep_clashing_columns(spark):
    from quire.llm.decontaminate import clean_documents
    from quire.llm.quality_rules import DEFAULT, keep_good

    r = random.Random(5)
    x, y = text(r, 30), text(r, 30)
    bench = spark.createDataFrame([(1, " ".join(y.split()[5:16])), (None, None)], "item_id long, text string")
    d = clashing(spark, [(1, x), (2, y), (3, None)])
    assert sorted(row[0] for row in keep_good(d, DEFAULT).collect()) == [1, 2]
    for limit in (10**6, 0):
        out = clean_documents(d, bench, max_broadcast_chars=limit)
        assert out.columns == d.columns
        got = {row[0]: (row[1], row[2], row[5]) for row in out.collect()}
        assert got[1] == (x, "other", len(x)) and got[3] == (None, "other", None) and len(got[2][0].split()) == 19 and got[2][2] == len(got[2][0])


def long_rows():
    r = random.Random(9)
    words = [text(r, 1) for _ in range(400)]
    big = " ".join(r.choice(words) for _ in range(60_000))
    return big, [(1, big), (2, "x" * 200_000), (3, "\n" * 50_000), (4, big[:-30] + " another end of it")]


def test_very_long_texts(spark):
    from quire.llm import decontaminate, line_dedup, ngram_join, pieces, quality_rules, suffix_dedup

    big, rows = long_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(d, with_kept=False).collect()}
    assert got[3].n_removed == 50_000 and got[2].n_removed == 200_000 and got[1].n_removed >= len(big) - 300 and got[4].n_removed >= len(big) - 300
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(d).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (3, 0), 4: (1, 1)}
    bench = spark.createDataFrame([(7, " ".join(big.split()[59_000:59_012]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.scan_documents(d, bench).collect()}
    assert got[1][0] == 60_000 and got[1][1] >= 12 and got[4][1] >= 12 and got[2] == (1, 0)
    got = {r.doc_id: r for r in quality_rules.apply_rules(d, quality_rules.DEFAULT).collect()}
    assert got[1].n_words == 60_000 and got[3].base_failed and got[2].n_words == 1
    got = {r.doc_id: r for r in pieces.encode_documents(d).collect()}
    assert all(r.round_trip for r in got.values()) and got[2].n_pieces < 200_000
    got = {r.doc_id: r.n_gone for r in line_dedup.drop_lines(d).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}


def test_pipeline_stages_on_empty_tables_and_nulls(spark, tmp_path):
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "quality": pd.Series([], dtype="int64"), "toxic": pd.Series([], dtype="int64")}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="str")}).to_parquet(tmp_path / "benchmark.parquet")
    words = "so these are plain words of a line that is long enough to stay."
    for rows in ([], [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, words, "en", None, None), (3, words, "en", None, None)]):
        d = spark.createDataFrame(rows, cols)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns
            assert out.count() == (0 if not rows else 2 if name == "quality_rules" else 4 if name == "ngram_join" else 5), name
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("op", ["rotate", "archive", "extract", "cotrain", "pieces"])
def test_other_operators_ignore_clashing_columns(spark, op):
    r = random.Random(3)
    if op == "rotate":
        from quire.llm.chat import rotate

        rows = [(1, 0, "user", "hi", "TURN", 1), (1, 1, "bot", "yo", "x", 2), (1, 1, "bot", "yo", "x", 3)]
        out = rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, TEXT string, seg int"))
        assert out.count() == 6
    if op == "archive":
        from quire.llm.warc import archive_report, write_archive

        rows = [(1, "u", "<p>a", "x", 1), (2, None, "<p>a", "y", 2)]
        got = archive_report(write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, HTML string, payload int"))).collect()
        assert {(x.page_id, x.record_type) for x in got} == {(1, "revisit"), (2, "response")}
    if op == "extract":
        from quire.llm.html_extract import extract

        rows = [(i, "http://a.b/", f"<body><article><p>{text(r, 9)}</p></article></body>", "x", 1) for i in (1, 1, 2)] + [(None, None, None, None, None)]
        got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, HTML string, text int")).collect()
        assert len(got) == 4 and sum(x.n_chars > 0 for x in got) == 3
    if op == "cotrain":
        from quire.llm.cotrain import score, train

        docs = spark.createDataFrame([(i, text(r, 20), "en", "s", 99, "x", 1) for i in [*range(20), 3, None]] + [(90, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score int")
        labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(10)] + [(None, None, None, None)], "doc_id long, quality int, toxic int, QUALITY string")
        assert score(docs, train(docs, labels)).count() == 23
    if op == "pieces":
        from quire.llm.pieces import encode_documents

        d = clashing(spark, [(1, "a b"), (1, "a b"), (None, None)])
        got = [(x.n_pieces, tuple(x.nbest_sha256)) for x in encode_documents(d).collect()]
        assert len(got) == 3 and len(set(got)) == 2


def test_refused_vocabulary():
    from quire.llm.pieces import MARK, Segmenter

    with pytest.raises(ValueError, match="word's end"):
        Segmenter([("a", -1.0, "piece"), (f"a{MARK}b", -2.0, "piece")])
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(Segmenter([("a", -1.0, "piece")]).encode("", 3)[0][1]).hexdigest()


def test_ngram_join_recall_at_the_threshold():
    from quire.llm.ngram_join import RECALL, ROWS, MinHash, bands_for, shingles

    import numpy as np

    r = random.Random(6)
    maker, met, n = MinHash(ROWS, bands_for(0.8, ROWS, RECALL)), 0, 0
    for _ in range(400):
        words = text(r, 120).split()
        other = list(words)
        for i in r.sample(range(120), 2):
            other[i] = "changed" + str(r.random())
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if 0.8 <= share <= 0.9:
            n += 1
            met += bool((np.frombuffer(maker.band_hashes(a), np.uint64) == np.frombuffer(maker.band_hashes(b), np.uint64)).any())
    assert n > 100 and met >= 0.98 * n


def test_very_long_turns_and_pages(spark):
    from quire.llm import chat, html_extract, warc

    long = "word " * 200_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "hello")]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert rows.count() > 0
    pages = [(1, "http://a.x/1", f"<body><p>{long}</p></body>"), (2, "http://a.x/2", f"<body><p>{long}</p></body>"), (3, None, None)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    back = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_report(warc.write_archive(p)).collect()}
    size = len(pages[0][2])
    assert back == {1: (size, "revisit", 2), 2: (size, "response", None), 3: (0, "response", None)}
    assert {r.page_id: r.n_chars for r in html_extract.extract(p).collect()} == {1: len(long) - 1, 2: len(long) - 1, 3: 0}


def test_no_rows_and_ties(spark):
    from quire.llm import cotrain, ngram_join

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert ngram_join.one_of_each(none).collect() == [] and ngram_join.one_of_each(none).columns == none.columns
    same = [(i, "the same words in every text", "en", "s", 28) for i in range(12)] + [(50, "the same words " * 30_000, "en", "s", 450_000)]
    d = spark.createDataFrame(same, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = cotrain.score(d, cotrain.train(d, labels)).collect()
    assert len(got) == 13 and len({tuple(r)[1:] for r in got if r[0] < 12}) == 1

"""Token files, spelling variants and whitening against brute force."""

from __future__ import annotations

import math
import random
import uuid
import zlib

import numpy as np
import pytest

from tests.llm.test_edges import clashing


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


TEXTS = ["Plain words, and more: it's <b>here</b>.", "", None, "ÄÖÜ straße Ǆ J̌ Café CAFÉ é é É", "a b c\td\r\ne", "<|endoftext|> in <|ENDOFTEXT|> text", "x\x01y \x01", "數字 १२३ 😀👍🏽 '''s 's're", "ΑΣ Σ İI", "  \n\n ", "don't DON'T 1234 12,34"]


def test_ids_of_chunks_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    from quire.llm.token_files import TOKENIZER, Encoder

    whole, encoder = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER, 100)
    assert encoder.by_chunk
    r = random.Random(3)
    alphabet = "aAbB sS'.,<|>\n\t ́̌é ΣσİıßÄ1२\x01J"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(800)]
    for some in (texts, texts[::-1], [" ".join(t or "" for t in texts)]):
        got = encoder.encode(some)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in some]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from quire.llm.token_files import Encoder

    file = P.path("byte_bpe_50k.json")
    encoder, whole = Encoder(file), Tokenizer.from_file(file)
    assert not encoder.by_chunk
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(TEXTS)] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("high", [1, 2, 200, 50_000, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 200])
def test_blocks_round_trip(high, n):
    from quire.llm.token_files import Segment, segment_bytes

    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 40:
        ids[7], ids[40] = (1 << 32) - 1, 0  # exceptions
    raw = segment_bytes(3, 4, [5, None], [n, 0], ids, block=32) + b"\n"
    s = Segment(raw)
    assert (s.shard, s.number, s.docs, s.sizes.tolist(), s.size) == (3, 4, [5, None], [n, 0], len(raw) - 1)
    assert s.ids().tolist() == ids.tolist()
    for a in range(0, n, 13):
        for b in (a, a + 1, a + 31, n):
            assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_outliers_do_not_widen_a_block():
    from quire.llm.token_files import pack_blocks

    ids = np.arange(1000, 1000 + 128, dtype=np.uint32)
    one = ids.copy()
    one[5] = 1 << 31
    assert len(pack_blocks(one, 128, 90)[0]) == len(pack_blocks(ids, 128, 90)[0]) + 2 + 4


def test_a_cut_file_is_noticed():
    from quire.llm.token_files import segment_bytes, segments_of

    raw = segment_bytes(0, 0, [1], [3], np.array([1, 2, 3], np.uint32))
    with pytest.raises(ValueError):
        list(segments_of(raw[:-1]))
    with pytest.raises(ValueError):
        list(segments_of(raw + b"x"))


def test_op11_chunks_are_looked_up_once(monkeypatch):
    """Of texts that are encoded together each different chunk is sought once, and a task keeps to its core."""
    import os

    from quire.llm.token_files import TOKENIZER, Encoder, encoder

    class Counted(dict):
        n = 0

        def get(self, key):
            self.n += 1
            return super().get(key)

    e = Encoder(TOKENIZER)
    e.known = Counted({b"": b""})
    texts = ["one two, three\n" * 500, "two  three four.", "\n", "", None] * 3
    assert e.encode(texts) == [e.whole([t])[0] if t else b"" for t in texts]
    assert e.known.n < 30
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder.cache_clear()
    encoder(TOKENIZER)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_op11_files(spark, path):
    from tokenizers import Tokenizer

    from quire.llm.token_files import END, TOKENIZER, read_tokens, token_report, write_tokens

    r = random.Random(8)
    rows = [(r.randint(-5, 40), t) for t in TEXTS * 6] + [(None, "no id"), (None, "no id"), (7, "long " * 50_000), (7, "x" * 30_000)]
    write_tokens(clashing(spark, rows), path, segment=500)
    whole = Tokenizer.from_file(TOKENIZER)
    got = sorted(tuple(x) for x in token_report(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    ids = {s: i for s, i in read_tokens(spark, path).join(token_report(spark, path).selectExpr("start", "doc_id as d", "n_tokens", "ids_crc32"), on=None, how="cross").where("doc_id <=> d and size(ids) = n_tokens").select("start", "ids").collect()}
    assert len(got) == len(rows)
    want = sorted((d is not None, d or 0, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, END], "<u4").tobytes()), len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    assert sorted((d is not None, d or 0, c, n) for _, d, n, c in got) == want
    at = 0
    for (start, d, n, _), before in zip(got, [None, *got], strict=False):
        assert start == at and len(ids[start]) == n
        assert before is None or (before[1] is not None, before[1] or 0) <= (d is not None, d or 0)
        at += n


def test_op11_empty_table(spark, path):
    from quire.llm.token_files import token_report, write_tokens

    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_report(spark, path).collect() == []


# ---- spelling ------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(close))
    rows = set()
    for w, (form, many) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], many, None if form is None else n[form]))
    return rows


def test_suffix_array():
    from quire.llm.spelling import suffix_array

    r = random.Random(1)
    for _ in range(50):
        t = [r.randint(0, 2) for _ in range(r.randint(1, 40))]
        assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_searches_find_every_pair_once():
    from quire.llm.spelling import shard_pairs

    r = random.Random(2)
    for _ in range(150):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 60))})
        entries = [(w, side) for w in words for side in "LR"]
        got = sorted((entries[i][0], entries[j][0]) for i, j in shard_pairs([w for w, _ in entries], [True] * len(entries), [s for _, s in entries]))
        assert got == sorted((a, b) for a in words for b in words if len(a) <= len(b) and near(a, b))


def test_wide_intervals():
    from quire.llm.spelling import BidirectionalIndex

    words = [f"stem{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["stemak", "stemakk"][1:]
    index = BidirectionalIndex(words)
    a, b = index.near(np.arange(len(words)), "L")
    got = {(words[x], words[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(x, y) for x in words for y in words if near(x, y) and len(x) <= len(y) and x[: len(x) // 2] == y[: len(x) // 2]}


@pytest.mark.parametrize("hot", [3, 20_000])
def test_op12_brute_force(spark, hot):
    from quire.llm.spelling import group_variants

    r = random.Random(4)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(250)}
    words |= {f"commonbeginning{a}{b}{c}ending" for a in "aé" for b in "bcd" for c in "xyz"} | {"w" * k for k in range(295, 300)} | {"\U0001f600" * 4, "\U0001f600" * 5}
    n = {w: r.choice([1, 2, 3, 5, 8, 13, 40]) for w in words}
    v = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {tuple(x) for x in group_variants(v, hot=hot, shard=60).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_groups(n)


def test_hot_groups_are_split(spark):
    from pyspark.sql import functions as F

    from quire.llm.spelling import deal

    # All share the first half and the end; what differs stands between.
    v = spark.createDataFrame([(f"{'p' * 12}{a}{b}{c}{'s' * 4}", 1) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], "word string, n long")
    largest = lambda hot: deal(v, hot).groupBy("key").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    assert largest(20_000) == 512 and largest(100) <= 64


def test_op12_words(spark):
    from quire.llm.spelling import count_words

    rows = [(1, "Straße STRASSE straße123Straße"), (2, None), (3, ""), (None, "Ünder ünder under under under"), (None, "Ünder"), (5, "abcd abcd abcd " + "long" * 5000)]
    got = {r.word: r.n for r in count_words(clashing(spark, rows), damage=97, min_chars=5, min_count=1).collect()}
    import re

    want = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    assert got == want


def test_op12_damage(spark):
    from quire.llm.spelling import count_words

    rows = [(i, "wordlike") for i in range(2000)]
    got = {r.word: r.n for r in count_words(spark.createDataFrame(rows, "doc_id long, text string"), 97, 5, 1).collect()}
    want = {}
    for i, w in rows:
        h = zlib.crc32(f"{i}:{w}".encode())
        w = w if h % 97 else w[: h % 8] + w[h % 8 + 1 :]
        want[w] = want.get(w, 0) + 1
    assert got == want and len(got) > 3


def test_op12_without_words(spark):
    from quire.llm.spelling import count_words, group_variants

    assert group_variants(count_words(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"))).collect() == []


# ---- whitening -----------------------------------------------------------------------------------


@pytest.mark.parametrize("dims, n, rank", [(1, 9, 4), (6, 50, 8), (20, 300, 64), (12, 5, 64)])
def test_spectrum_equals_a_direct_one(dims, n, rank):
    from quire.llm.whitening import Spectrum

    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(n, dims)) * np.exp(rng.normal(size=dims) * 2) * 100) + 100_000
    x[n // 2 :: 3] = x[0]  # repeated
    parts = [Spectrum(dims, rank) for _ in range(3)]
    for i, v in enumerate(x):
        parts[i % 2].add(v)  # one stays empty
    parts[2].merge(parts[0])
    parts[2].merge(parts[1])
    got, y = parts[2], x - x.mean(axis=0)
    want = y.T @ y
    assert got.n == n and np.allclose(got.mean, x.mean(axis=0), rtol=1e-13)
    assert np.abs((got.basis * got.values) @ got.basis.T - want).max() <= 1e-11 * want.max()
    assert np.abs(got.basis.T @ got.basis - np.eye(len(got.values))).max() < 1e-12


def test_equal_eigenvalues_are_deflated():
    from quire.llm.whitening import rank_one

    rng = np.random.default_rng(0)
    d = np.array([0.0, 0, 0, 1, 1, 1, 1, 5, 5 + 1e-16, 9])
    basis = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    for z in (rng.normal(size=10), np.eye(10)[4], np.zeros(10), np.array([1.0, 1, 0, 2, 2, 0, 0, 1e-20, 3, 0])):
        got, turned = rank_one(d, basis, z, 0.7)
        want = basis @ (np.diag(d) + 0.7 * np.outer(z, z)) @ basis.T
        assert np.abs((turned * got) @ turned.T - want).max() < 1e-13 * max(9, np.abs(want).max())
        assert np.abs(turned.T @ turned - np.eye(10)).max() < 1e-13


def whole(rows):
    ok = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in ok])
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    return ok, n, s, values[::-1], y @ turn[:, ::-1]


@pytest.mark.parametrize("rank", [128, 9])
def test_op13_brute_force(spark, rank):
    from quire.llm.whitening import whiten

    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(14, 14)) * 0.7 ** np.arange(14)[:, None]
    rows = [(i, (rng.normal(size=14) @ mixed).astype(np.float32).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (1000, None), (1001, [None, *rows[0][1][1:]]), (1002, [math.nan, *rows[0][1][1:]]), (1003, [-math.inf, *rows[0][1][1:]])]
    d = spark.createDataFrame([(i, v, "x", [1.0]) for i, v in rows], "vec_id long, embedding array<float>, Vec_ID string, EMBEDDING array<float>").repartition(5)
    got = whiten(d, rank=rank).collect()
    ok, n, s, values, turned = whole(rows)
    assert len(got) == 8 * len(ok)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(1, 9):
        want = turned[:, k - 1] / math.sqrt(values[k - 1])
        sign = 1 if by[3, k][0].whitened * want[3] > 0 else -1
        for (i, x), w in zip(ok, want, strict=True):
            for r in by[i, k]:
                assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s.tolist(), strict=True))
                assert abs(r.whitened - sign * w) < 1e-8 and abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9
                assert r.identity_error < 1e-9


def test_op13_odd_tables(spark):
    from quire.llm.whitening import whiten

    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    line = whiten(spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(5)], schema)).collect()
    assert {r.component: (r.whitened is None, round(r.explained, 9)) for r in line} == {1: (False, 1.0), 2: (True, 0.0), 3: (True, 0.0)}
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).collect()


def test_deviations_beyond_a_long():
    from quire.llm.whitening import _deviations

    assert _deviations(np.array([[3, 4], [3_037_000_499, 0], [3_037_000_500, 0], [1 << 40, 1]])) == [25, 3_037_000_499**2, None, None]


def test_op13_many_tasks(spark):
    from quire.llm.whitening import whiten

    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "vec_id long, embedding array<double>").repartition(40)
    got = whiten(d).collect()
    assert len(got) == 800 and got[0].identity_error < 1e-12

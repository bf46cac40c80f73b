"""The numbered operators against brute force, on small tables with the odd cases."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "then aio river über mice Ωmega stone late ember quiet fold crane vivid north".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    long = text(r, 900)
    base = text(r, 120)
    near = base.split(" ")
    near[60] = "changed"
    shared = text(r, 60)
    out = [long, long, base, " ".join(near), base + " tail", text(r, 30) + " " + shared, shared + " " + text(r, 30), None, "", "   ", "one", "one two three", text(r, 40) + "\n" + text(r, 40), "x" * 450, "aé" * 300]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(out)] + [(2, base, "en", "s2", len(base)), (None, text(r, 20), None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    # Extra columns whose names clash with those that the operators make.
    return spark.createDataFrame(rows, DOC).withColumns({"key": F.lit(1), "n_words": F.lit("x"), "TEXT_": F.lit(2), "Hits": F.lit(3)})


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- 1 ----------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raws for i in range(len(x) - length + 1))
    out = []
    for x in raws:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(x)) if mark[i] and (not i or not mark[i - 1]))
        kept = bytes(c for c, m in zip(x, mark, strict=True) if not m)
        out.append((len(x), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 200])
@pytest.mark.parametrize("hot_at", [20_000, 2])
def test_op1_brute_force(spark, docs, rows, length, hot_at):
    from quire.llm.suffix_dedup import remove_repeats

    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length, hot_at=hot_at).collect())
    want = Counter((row[0], *x) for row, x in zip(rows, brute_repeats([r[1] for r in rows], length), strict=True))
    assert got == want
    assert remove_repeats(empty(spark), length).count() == 0


def test_op1_loser_tree():
    from quire.llm.suffix_dedup import decoded, front_code, merge_runs

    r = random.Random(5)
    runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randrange(12))), k) for _ in range(r.randrange(30))) for k in range(7)]
    got = list(merge_runs([decoded(front_code(x)) for x in runs]))
    flat = sorted(s for x in runs for s, _ in x)
    assert [g[0] for g in got] == flat
    for before, (s, h, _) in zip([b"", *flat], got, strict=False):
        n = 0
        while n < min(len(before), len(s)) and before[n] == s[n]:
            n += 1
        assert h == n
    assert Counter((s, e) for s, _, e in got) == Counter((s, e) for x in runs for s, e in x)


# ---- 2 ----------------------------------------------------------------------------------------


def test_op2_brute_force(spark, docs, rows):
    from quire.llm.decontaminate import words_of
    from quire.llm.ngram_join import ngram_join

    sets = {}
    for _, t, *_ in rows:
        w = words_of(t)
        k = min(5, len(w))
        sets[t] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    links = defaultdict(set)
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    group = {t: {t} for t in sets}
    for a in links:
        for b in links[a]:
            joint = group[a] | group[b]
            for x in joint:
                group[x] = joint
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[t].append(i)

    def want(i, t):
        if not sets[t]:
            return (i, i, 0, 1)
        known = [x for y in group[t] for x in ids[y] if x is not None]
        return (i, min(known) if known else i, len(links[t]), len(ids[t]))

    got = Counter(tuple(r) for r in ngram_join(docs, block=2).collect())
    assert got == Counter(want(i, t) for i, t, *_ in rows)
    assert any(len(v) for v in links.values())
    assert ngram_join(empty(spark)).count() == 0


def test_op2_recall_parameter():
    from quire.llm.ngram_join import bands_for

    b = bands_for(0.8, 5, 0.9999)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


# ---- 3 ----------------------------------------------------------------------------------------


def test_op3_held_out(spark):
    from quire.llm.cotrain import score, train

    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, text(r, 60) + (" scum ### $$$ scum" if bad else ""), "en", "s1" if bad else "s2", 100))
        if i % 2 == 0:
            labels.append((i, 0 if bad and i % 8 == 0 else 1, 1 if bad and i % 8 else 0))
    d = spark.createDataFrame([*rows, (None, None, None, None, None)], DOC)
    model = train(d, spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    got = {x.doc_id: x.good for x in score(d, model).collect()}
    assert len(got) == 401
    right = [got[i] == (i % 4 != 0) for i in range(400) if i % 2]
    assert sum(right) / len(right) > 0.95
    none = train(d, spark.createDataFrame([], "doc_id long, quality long, toxic long"))
    assert {x.p_good for x in score(d, none).collect()} == {1.0}
    assert score(empty(spark), model).count() == 0


def test_op3_all_unlabelled_take_part(spark, monkeypatch):
    from quire.llm import cotrain

    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, text(r, 40) + (" scum ### $$$ scum" if bad else ""), "en", "s1" if bad else "s2", 100))
        labels.append((i, 0 if bad else 1, 0))
    # A rare kind of bad page that no label covers, behind more plain documents than a sample holds.
    rows += [(i, f"then{i % 40} river{i % 7} crane", "en", "s2", 100) for i in range(1000, 7000)]
    rare = range(7000, 7003)
    rows += [(i, "scum ### $$$ scum " * 9, "de", "rare", 100) for i in rare]
    d = spark.createDataFrame(rows, DOC).repartition(8)
    handed = {}
    plain = cotrain._surest

    def spy(pool, *more):
        assert pool.count() == 6003
        ask = plain(pool, *more)

        def asked(models, taken, counts):
            out = ask(models, taken, counts)
            for x in out[0]:
                handed.setdefault(x[0], x[1])
            assert all(not taken[i] & {x[0] for x in found} and len(found) <= sum(counts[i]) for i, found in enumerate(out))
            return out

        return asked

    monkeypatch.setattr(cotrain, "_surest", spy)
    model = cotrain.train(d, spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), per_round=40)
    assert [handed.get(i) for i in rare] == [0, 0, 0]
    column = cotrain.meta_of("de", "rare", 100)[0]
    assert model["meta"].w[column] < -0.1  # the other view has learnt of the source
    style = np.array([cotrain.style_of(x[1])[0] for x in rows])
    assert np.allclose(model["mean"], style.mean(0), atol=1e-6) and np.allclose(model["sd"], style.std(0) + 1e-6, atol=1e-4)


def test_op3_long_words(spark):
    from quire.llm.cotrain import train

    r = random.Random(6)
    rows = [(i, text(r, 20) + (" " + "z" * 60 if i % 3 == 0 else ""), "en", "s", 100) for i in range(150)]
    model = train(spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality long, toxic long"))
    assert b"z" * 60 in model["vocab"]


# ---- 4 ----------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head {0}</h1><p>First&amp; <b>bold {0}</b> para<p>Second
 para &copy; {0}</article><aside>side</aside><div id="comments"><p>Nice!</p></div><form>mail</form><footer>foot</footer></body></html>"""


def test_op4_extract(spark):
    from quire.llm.html_extract import extract

    rows = [(i, f"http://h{i % 2}.x/{i}", PAGE.format(i)) for i in range(6)] + [(6, None, None), (7, "http://h9.x/", "<div class=post><p>only <br>text</p></div><div class=sidebar>no</div>"), (8, "http://h9.x/", "<p>broken <b")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**9, 0):  # broadcast wrappers, joined wrappers
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(p, max_broadcast_bytes=limit).collect()}
        for i in range(6):
            want = f"Head {i}\n\nFirst& bold {i} para\n\nSecond para © {i}"
            assert got[i] == (rows[i][1], want, len(want))
        assert got[6] == (None, "", 0)
        assert got[7][1] == "only text"
    assert extract(p.limit(0)).count() == 0


def test_op4_alignment():
    from quire.llm.html_extract import _sig, align, fold

    li, x = ["li"], lambda t: ["#", t]
    a = fold([["ul"], li, x("a"), li, x("b"), ["h1"], x("same")])
    b = fold([["ul"], li, x("c"), ["h2"], x("d"), ["h1"], x("same")])
    got = align(a, b)
    assert [_sig(n) for n in got] == ["ul", "+(li #)", "?(h2 #)", "h1", "#"]
    assert got[1][1][1] == ["#", None] and got[-1] == ["#", "same"]


def test_op4_neutral_names(spark):
    from quire.llm.html_extract import extract

    r = random.Random(11)
    rows, want = [], {}
    for i in range(12):
        head, paras, note = text(r, 5), [text(r, 60) for _ in range(1 + i % 4)], text(r, 40)
        menu = "".join(f"<p>{x}</p>" for x in ("Start here", "About us", "Our shop and all its many pages"))
        offer = "<div class=box><p>Buy our book now, it is cheap</p></div>" if i % 3 else ""
        # Menu and article have equal neutral names; parts of the article have names of furniture.
        body = f"<div class=box>{menu}</div>{offer}<div class=c2><div class=article-header><h1>{head}</h1></div><div class=share-story>{''.join(f'<p>{x}</p>' for x in paras)}</div><p class=notice>{note}</p><p>Read more on our site</p></div><div class=c3>All rights reserved by us {'' if i % 2 else 'and them'}</div>"
        rows.append((i, f"http://n.x/{i}", f"<html><body>{body}</body></html>"))
        want[i] = "\n\n".join([head, *paras, note])
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**9, 0):
        assert {x.page_id: x.text for x in extract(p, max_broadcast_bytes=limit).collect()} == want


def test_op4_same_beginning(spark):
    from quire.llm.html_extract import extract

    start = "These sixty characters are the same on every page of this host: "
    rows = [(i, f"http://n.x/{i}", f"<body><div class=c1>{start}menu</div><div class=c2><p>{start}{i} {'word ' * i}</p></div></body>") for i in range(5)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in extract(p).collect()} == {i: f"{start}{i} {'word ' * i}".strip() for i in range(5)}


# ---- 5 ----------------------------------------------------------------------------------------


def test_op5_brute_force(spark, docs, rows):
    from quire.llm.decontaminate import clean_documents, scan_documents, words_of

    texts = [r[1] for r in rows]
    w = words_of(texts[0])
    items = [(1, b" ".join(w[100:130]).decode()), (20, "One, TWO"), (3, None), (4, "!!"), (5, b" ".join(w[110:121]).decode()), (5, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = [(str(i), tuple(x[a : a + min(10, len(x))])) for i, t in items if (x := words_of(t)) for a in range(len(x) - min(10, len(x)) + 1)]
    want = Counter()
    for i, t, *_ in rows:
        x = words_of(t)
        hit, found = [False] * len(x), set()
        for item, win in wins:
            for a in range(len(x) - len(win) + 1):
                if tuple(x[a : a + len(win)]) == win:
                    hit[a : a + len(win)] = [True] * len(win)
                    found.add(item)
        want[i, len(x), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)] += 1
    for limit in (10**9, 0):  # broadcast set, shuffled join
        got = Counter(tuple(r) for r in scan_documents(docs, bench, max_broadcast_chars=limit).drop("cleaned").collect())
        assert got == want
    assert sum(v for k, v in want.items() if k[-1]) >= 3
    for limit in (10**9, 0):
        left = clean_documents(docs, bench, max_broadcast_chars=limit)
        assert left.columns == docs.columns
        again = scan_documents(left, bench)
        assert again.where("contaminated").count() == 0
        assert left.where("doc_id = 11").count() == 0 and left.where("doc_id = 2").count() == 2
    assert scan_documents(empty(spark), bench).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------


def test_op6_base_counts():
    import re

    from quire.llm.quality_rules import base_counts

    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice(["a", "bé", " ", "\n", "\t", "#", "|", "a b c d e", "\x0b", " "]) for _ in range(r.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count, mark = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                mark |= set(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(mark))
        assert base_counts(t.encode(), len(t))[0] == want


def test_op6_viterbi_is_best():
    from quire.llm.quality_rules import viterbi

    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        s, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(product((0, 1), repeat=n), key=lambda y: sum(s[i, y[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert viterbi(s, t).tolist() == list(best)


def test_op6_learns_boilerplate(spark):
    from quire.llm.quality_rules import RESULT, apply_rules, keep_good, train

    r = random.Random(7)
    rows, labels = [], []
    for i in range(120):
        junk = i % 3 == 0
        body = "\n".join((" ".join(w.upper() + "!!" for w in text(r, 12).split()) if junk else text(r, 12).capitalize() + ".") for _ in range(4))
        rows.append((i, body, "en", "s", len(body)))
        if i < 80:
            labels.append((i, 0 if junk else 1))
    d = spark.createDataFrame([*rows, (None, None, None, None, None), (500, " \n", "en", "s", 2)], DOC)
    model = train(d, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality long"))
    got = {x.doc_id: x for x in apply_rules(d, model).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in range(120))
    assert got[None].n_words == 0 and got[None].base_failed and not got[500].kept
    assert sorted(x.doc_id for x in keep_good(d, model).collect()) == [i for i in range(120) if i % 3]
    assert len(RESULT.split(", ")) == 8 and apply_rules(empty(spark), model).count() == 0
    other = train(d, spark.createDataFrame([], "doc_id long, quality long"))
    assert apply_rules(d, other).count() == 122


def test_op6_trains_on_whole_texts(spark):
    from quire.llm.quality_rules import judge, train

    r = random.Random(8)
    # Bad and good documents begin alike; the junk of the bad ones starts after line 70.
    plain = lambda n: [text(r, 8).capitalize() + "." for _ in range(n)]
    junk = lambda n: [" ".join("###" + w.upper() + "!!" for w in text(r, 8).split()) for _ in range(n)]
    rows = [(i, "\n".join(plain(70) + (junk(200) if i % 2 else plain(200))), "en", "s", 0) for i in range(16)]
    d = spark.createDataFrame(rows, DOC)
    model = train(d, spark.createDataFrame([(i, 1 - i % 2) for i in range(16)], "doc_id long, quality long"))
    assert judge("\n".join(plain(20)), model)[7] > 0.9 and judge("\n".join(junk(20)), model)[7] < 0.1


def test_op6_labels_lines_of_mixed_texts():
    from quire.llm.quality_rules import base_counts, fit, label_lines, line_features

    r = random.Random(18)
    plain = lambda: text(r, r.randint(6, 14)).capitalize() + "."
    junk = lambda: " ".join(w.upper() + r.choice(["###", "!!", "$$"]) for w in text(r, r.randint(5, 12)).split())
    lines = lambda xs: base_counts("\n".join(xs).encode(), 0)[1]
    # Bad documents have some prose, good ones some junk: no document is of one kind.
    docs = [([plain() for _ in range(9)] + [junk()] if i % 2 else [junk() for _ in range(7)] + [plain() for _ in range(3)], 1 - i % 2) for i in range(60)]
    model = fit([line_features(lines(x)) for x, _ in docs], [y for _, y in docs])
    right = n = 0
    for _ in range(40):
        kinds = [0] * r.randint(1, 6) + [1] * r.randint(1, 6) + [0] * r.randint(1, 6)
        got = label_lines(lines([junk() if k else plain() for k in kinds]), model)
        right, n = right + sum(int(a) == k for a, k in zip(got, kinds, strict=True)), n + len(kinds)
    assert right > 0.95 * n


def test_op6_expectations_and_constraint_by_enumeration():
    from quire.llm.quality_rules import FEATURES, _expected, _groups, constrained

    rng = np.random.default_rng(5)
    seqs = [rng.normal(size=(n, len(FEATURES))) for n in (1, 2, 3, 4, 5)]
    w, t = rng.normal(size=len(FEATURES)), rng.normal(size=(2, 2))
    want_w, want_t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    for x in seqs:
        every = [np.array(y) for y in product((0, 1), repeat=len(x))]
        score = np.array([(y * (x @ w)).sum() + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)) for y in every])
        p = np.exp(score - score.max())
        p /= p.sum()
        for y, q in zip(every, p, strict=True):
            want_w += q * (y[:, None] * x).sum(0)
            for a, b in zip(y, y[1:], strict=False):
                want_t[a, b] += q
    sums = [_expected(x, on, w, t) for _, x, on in _groups(seqs)]
    assert np.allclose(sum(a for a, _ in sums), want_w) and np.allclose(sum(b for _, b in sums), want_t)
    for label in (0, 1):
        for _ in range(20):
            s = np.concatenate((np.zeros((7, 1)), rng.normal(size=(7, 1)) * 3), axis=1)
            assert 2 * (constrained(s, t, label) == label).sum() >= 7


# ---- 7 ----------------------------------------------------------------------------------------


def test_op7_rotation(spark):
    from quire.llm.chat import rotate

    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "x"), (None, None, None, "lost"), (3, 5, "ann", "é")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in rotate(c, block=2).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
    for (conv, who), segs in got.items():
        segs.sort(key=lambda r: r.seg)
        assert [r.seg for r in segs] == list(range(len(segs))) and len(segs) == sum(1 for x in rows if x[0] == conv)
        at = 0
        for r in segs:
            assert (r.start, r.end) == (at, at + len(r.rendered))
            at = r.end
        whole = "".join(r.rendered for r in segs)
        for r in segs:
            learned = whole[r.mask_start : r.mask_end]
            assert learned.endswith("<|im_end|>") if r.role == who else learned == ""
            assert ("assistant" in r.rendered.split("\n")[0]) == (r.role == who)
    assert rotate(c.limit(0)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------


def test_op8_n_best(spark, docs, rows):
    import sentencepiece

    from quire.llm import pieces as P

    seg = P.Segmenter(P.read_pieces(P.MODEL))

    def every(w):
        if not w:
            yield 0
            return
        for e in range(1, len(w) + 1):
            hit = seg.known.get(w[:e])
            own = hit[1] if hit else seg.penalty if e == 1 else None
            if own is not None:
                for rest in every(w[e:]):
                    yield own + rest

    r = random.Random(1)
    for t in ["Thntblere of", "aaaa aa", "é ü", "  x", "字\U0001f600a", "hello\nwor"] + ["".join(r.choice("then aio\n") for _ in range(r.randint(1, 10))) for _ in range(40)]:
        want = sorted(every(P.MARK + t.replace(" ", P.MARK)), reverse=True)
        for n in (1, 2, 4):
            got = seg.encode(t, n)
            assert [s for s, _ in got] == want[:n] and len({x for _, x in got}) == len(got)
            assert seg.decode(np.frombuffer(got[0][1], "<u4").tolist()) == t
    for t in ["the then in a", "on no on no on"]:  # several words branch; equal scores
        want = sorted(every(P.MARK + t.replace(" ", P.MARK)), reverse=True)
        assert [s for s, _ in seg.encode(t, 40)] == want[:40]
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for x in P.encode_documents(docs).collect():
        t = next((r[1] for r in rows if r[0] == x.doc_id), None) or ""
        assert x.round_trip and x.n_pieces == len(x.ids) and x.nbest_scores == sorted(x.nbest_scores, reverse=True)
        if x.doc_id != 2:
            assert lib.decode(x.ids) == t
    assert P.encode_documents(empty(spark)).count() == 0


def test_op8_many_best_of_a_long_text():
    import time

    from quire.llm import pieces as P

    seg, rng = P.Segmenter(P.read_pieces(P.MODEL)), random.Random(2)
    t = text(rng, 1000)
    seg.encode(t, 20)
    began = time.perf_counter()
    got = seg.encode(t, 20)
    assert time.perf_counter() - began < 2
    scores = [s for s, _ in got]
    assert len({x for _, x in got}) == 20 and scores == sorted(scores, reverse=True)
    assert all(seg.decode(np.frombuffer(x, "<u4").tolist()) == t for _, x in got)
    score = {i: s for i, s in seg.known.values()}
    assert all(sum(score[i] for i in np.frombuffer(x, "<u4").tolist()) == s for s, x in got)
    assert [x for _, x in seg.encode(t, 8)] == [x for _, x in got[:8]]


def test_op8_queue_is_in_order():
    from itertools import islice, product

    from quire.llm.pieces import _best_first

    rng = random.Random(3)
    for _ in range(200):
        options = [[(s, b"") for s in sorted((rng.randint(-4, 0) for _ in range(rng.randint(1, 4))), reverse=True)] for _ in range(rng.randint(0, 4))]
        want = sorted((-(7 + sum(o[k][0] - o[0][0] for o, k in zip(options, c, strict=True))), c) for c in product(*(range(len(o)) for o in options)))
        assert list(islice(_best_first(7, options), 50)) == want[:50]


def test_op8_equal_fingerprints_are_compared(monkeypatch):
    from quire.llm import pieces as P

    words = ["alpha", "omega", "alpha", "beta", "omega", "gamma", "a"]
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    unique = np.unique
    monkeypatch.setattr(P.np, "unique", lambda x, **k: unique(np.where(x == x[-1], x, 5), **k))  # all words but the last collide
    of, which = P._distinct(chars, start, size)
    monkeypatch.undo()
    assert [words[of[k]] for k in which] == words


# ---- 9 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 5])
def test_op9_round_trip(spark, least):
    from quire.llm.warc import archive_report, read_archive, write_archive

    rows = [(1, "u1", "<p>é"), (2, "u2", "<p>é"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "a\r\n\r\nb"), (5, "u5", "a\r\n\r\nb"), (None, "u6", "z"), (7, "u7", "<p>é")]
    a = write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=least)
    assert a.payloads.count() == len({(h or "").encode() for *_, h in rows})
    got = Counter(tuple(r) for r in archive_report(a).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = len(raw) >= least and i != top
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    for r in read_archive(a).collect():
        assert bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: ") and bytes(r.record).endswith(b"\r\n\r\n")
    none = write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archive_report(none).count() == 0


# ---- 10 ---------------------------------------------------------------------------------------


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("tau", [1, 2])
@pytest.mark.parametrize("limit, hot", [(10**6, 128), (0, 3), (10**6, 2)])
def test_op10_brute_force(spark, tau, limit, hot):
    from quire.llm import line_dedup as L

    r = random.Random(4 + tau)

    def mutated(s):
        for _ in range(r.randint(0, 3)):
            i, o = r.randrange(len(s) + 1), r.random()
            s = s[:i] + r.choice("abé") + s[i:] if o < 0.4 else s[:i] + s[i + 1 :] if o < 0.7 else s[:i] + r.choice("abé") + s[i + 1 :]
        return s

    base = ["".join(r.choice("abé") for _ in range(r.randint(24, 34))) for _ in range(10)]
    lines = [mutated(b) for b in base for _ in range(8)] + ["short", "short", "", "", " ", " "]
    lines += ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(40)]
    r.shuffle(lines)
    docs = {i: lines[i * 4 : i * 4 + 4] for i in range((len(lines) + 3) // 4)}
    d = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()] + [(900, None), (901, "")], "doc_id long, text string")
    got = {(x.doc_id, p) for x in L.removed_lines(d, tau, max_broadcast_ids=limit, hot=hot).collect() for p in x.gone}
    flat = [(k, p, x) for k, v in sorted(docs.items()) for p, x in enumerate(v) if x.strip()]
    near = lambda x, y: x == y or min(len(x), len(y)) >= 2 * (tau + 1) and abs(len(x) - len(y)) <= tau and edit_distance(x, y) <= tau
    want = {(k, p) for i, (k, p, x) in enumerate(flat) if any(near(x, y) for _, _, y in flat[:i])}
    assert got == want and want
    out = {x.doc_id: x for x in L.drop_lines(d, tau).collect()}
    assert out[900].text is None and out[901].text == "" and out[900].n_gone == 0
    assert all(out[k].text == "\n".join(x for p, x in enumerate(v) if (k, p) not in want) for k, v in docs.items())
    assert L.drop_lines(d.limit(0)).count() == 0


def test_op10_template_lines_do_not_meet_in_all_pairs(spark):
    import hashlib

    from pyspark.sql import functions as F

    from quire.llm import line_dedup as L

    n = 3000
    lines = [f"{'x' * 20}{hashlib.md5(str(i).encode()).hexdigest()[:10]}{'y' * 10}" for i in range(n)]
    lines += [lines[5][:24] + "Q" + lines[5][25:], lines[9][:30] + lines[9][31:], lines[11] + "y"]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    seen = []
    keep = L.stored

    def watched(df, name, *a):
        out = keep(df, name, *a)
        if name == "line-pairs":
            seen.append(out.count())
        return out

    L.stored = watched
    try:
        got = sorted(r.doc_id for r in L.removed_lines(d).select("doc_id").collect())
    finally:
        L.stored = keep
    assert got == [n, n + 1, n + 2]
    assert seen[0] < 20 * n  # all pairs: n * n / 2
    cut = L._split(L._split(spark.createDataFrame([(1, 1, True, 0, "abcdefgh", 8)], "k long, s long, own boolean, less int, rest string, m int"), 1), 1)
    assert cut.agg(F.max("m")).first()[0] == 2 and cut.count() == 4


def test_components(spark):
    from quire.llm.components import components

    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(200, 240), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

"""Places in a wrapper, and the alignment that gives them, against plain versions."""

from __future__ import annotations

import random
import time

from quire.llm import html_extract as H
from tests.llm.test_operators import text


def plain_lcs(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return best


def test_pairs_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(800):
        x, y = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        for cells in (H.CELLS, 3):
            got = list(H._pairs([(c,) for c in x], [(c,) for c in y], cells))
            both = [(i, j) for i, j in got if i is not None and j is not None]
            assert all(x[i] == y[j] for i, j in both) and len(both) == plain_lcs(x, y)[0][0]
            assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))


def test_pairs_of_long_pages_need_little():
    x = [(f"a{i % 4999}",) for i in range(6000)]
    y = [(f"a{i * 7 % 4999}",) for i in range(6000)]
    began = time.perf_counter()
    assert len(list(H._pairs(x, y, 1 << 22))) >= 6000
    assert time.perf_counter() - began < 20


def covers(wrapper, tokens):
    """Whether a wrapper of tokens, optional and repeated groups matches the whole stream, by trying everything."""

    def ends(nodes, at):
        if not nodes:
            return {at}
        n, rest = nodes[0], nodes[1:]
        if n[0] in "?+" and len(n) > 1:
            once = ends(n[1], at)
            if n[0] == "+":
                found = set(once)
                while once:
                    once = {e for a in once for e in ends(n[1], a)} - found
                    found |= once
                once = found
            starts = once | ({at} if n[0] == "?" else set())
        else:
            starts = {at + 1} if at < len(tokens) and tokens[at] == n[0] else set()
        return {e for a in starts for e in ends(rest, a)}

    return len(tokens) in ends(wrapper, 0)


def test_wrappers_cover_all_streams_they_come_from():
    r = random.Random(5)
    for _ in range(400):
        streams = [[r.choice(["ul", "li", "h1", "p"]) for _ in range(r.randint(1, 7))] for _ in range(r.randint(2, 4))]
        w = H.fold([[t] for t in streams[0]])
        for s in streams[1:]:
            w = H.align(w, H.fold([[t] for t in s]))
        assert all(covers(w, s) for s in streams), (w, streams)


def read(pages):
    w = H.Wrapper.of(H.blocks_of(pages[0]))
    for p in pages[1:]:
        w.add(H.Wrapper.of(H.blocks_of(p)))
    reader = H.Reader(w)
    return [reader.text(H.blocks_of(p)) for p in pages]


def neutral(r, n=7):
    pages, want = [], []
    for i in range(n):
        head, paras = text(r, 5), [text(r, 50) for _ in range(2 + i % 3)]
        own = "".join(f"<p>{x}</p>" for x in paras)
        body = f"<div class=c1><p>Start here</p><p>All that we do</p></div><div class=c2><h1>{head}</h1><p class=zlead>By the editors of this site</p>{own}<h2>Conclusion</h2><p>{head} again</p><p class=zlast>More on our site</p></div><div class=c3><p>Rights reserved</p></div>"
        pages.append(f"<html><body>{body}</body></html>")
        want.append("\n\n".join([head, "By the editors of this site", *paras, "Conclusion", f"{head} again"]))
    return pages, want


def test_standing_texts_between_slots_are_content():
    pages, want = neutral(random.Random(3))
    assert read(pages) == want


def test_the_alignment_decides(monkeypatch):
    pages, want = neutral(random.Random(3))

    def bag(a, b):
        held = {H._sig(n): n for n in a}
        for n in b:
            held[H._sig(n)] = H._same(held[H._sig(n)], n) if H._sig(n) in held else n
        return [held[k] for k in sorted(held)]

    monkeypatch.setattr(H, "align", bag)
    assert read(pages) != want


def test_standing_texts_of_an_article_element_are_content():
    r = random.Random(4)
    pages, want = [], []
    for _ in range(6):
        head, para = text(r, 4), text(r, 40)
        pages.append(f"<body><nav><p>Menu</p></nav><article><p>A word before</p><h1>{head}</h1><h2>Introduction</h2><p>{para}</p><p>What stands at every end</p><div class=share><p>Share this</p></div></article><footer>foot</footer></body>")
        want.append("\n\n".join(["A word before", head, "Introduction", para, "What stands at every end"]))
    assert read(pages) == want


def test_a_very_long_page():
    r = random.Random(6)
    paras = [text(r, 30) for _ in range(4000)]
    long = "<body><div class=c1><p>Menu</p></div><div class=c2>" + "".join(f"<p class=k{i % 7}x{i % 5}>{x}</p>" for i, x in enumerate(paras)) + "</div></body>"
    short = [f"<body><div class=c1><p>Menu</p></div><div class=c2><p class=k0x0>{text(r, 30)}</p></div></body>" for _ in range(3)]
    began = time.perf_counter()
    assert read([long, *short])[0] == "\n\n".join(paras)
    assert time.perf_counter() - began < 60

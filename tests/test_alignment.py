"""Blocks of another rendering against a plain search."""

from __future__ import annotations

import random
import re

from quire.operators.alignment import find_blocks

TARGETS = "doc_id long, para_index int, text string, prev_text string, next_text string, occurrence long"


def plain(targets, blocks):
    norm = lambda t: re.sub(r"[\s﻿]+", "", t or "")
    out = {}
    for doc, no, text, prev, nxt, occurrence in targets:
        own = [(i, norm(t)) for d, i, t in sorted(blocks, key=lambda b: b[1]) if d == doc]
        n = norm(text)
        key, units = "", 0
        for c in n[:18]:
            units += 2 if ord(c) > 0xFFFF else 1
            if units > 18:
                break
            key += c
        found, step = [], None
        if sum(2 if ord(c) > 0xFFFF else 1 for c in key) >= 3:
            found, step = [k for k, (_, t) in enumerate(own) if t == n], "exact"
            if not found:
                found, step = [k for k, (_, t) in enumerate(own) if key in t], "part"

        def score(k):
            before = next((t for _, t in reversed(own[:k]) if t), "")
            after = next((t for _, t in own[k + 1 :] if t), "")
            return 2 * (bool(norm(prev)) and before == norm(prev)) + 2 * (bool(norm(nxt)) and after == norm(nxt))

        best = min(enumerate(found), key=lambda x: (-score(x[1]), abs(x[0] - (occurrence or 0)), x[1]), default=None)
        out[doc, no] = (-1, None) if best is None else (own[best[1]][0], step)
    return out


def test_find_blocks_brute_force(spark):
    r = random.Random(7)
    texts = ["alpha beta", " alpha  beta ", "ab", "abc", "", None, "a much longer line than any key can hold", "a much longer line than any other", "x a much longer line than any key can hold y", "aaaa", "aaa aaa aaa", "😀😁😂🤣😃😄😅😆😉😊", "😀😁", "中文　标题 一", "一二三"]
    targets, blocks = [], []
    for doc in range(25):
        p = [r.choice(texts) for _ in range(r.randint(0, 14))]
        seen: dict = {}
        for i, t in enumerate(p):
            k = seen.get(t, 0)
            seen[t] = k + 1
            near = lambda xs: next((x for x in xs if x and x.strip()), None)
            targets.append((doc, i, t, near(p[:i][::-1]), near(p[i + 1 :]), r.choice([k, k, None])))
        b = [x if r.random() < 0.6 else r.choice(texts) for x in p for _ in range(r.choice([0, 1, 1, 2]))]
        blocks += [(doc, 3 * i, f"- {x} end" if x and r.random() < 0.3 else x) for i, x in enumerate(b)]
    got = find_blocks(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(blocks, "doc_id long, block_index long, text string")).collect()
    assert len(got) == len(targets)
    assert {(x.doc_id, x.para_index): (x.block_index, x.step) for x in got} == plain(targets, blocks)


def test_find_blocks_of_one_template(spark):
    # Thousands of equal blocks and paragraphs: each paragraph takes the block of its own number.
    n = 4000
    targets = [(1, i, "the same long line of text", "same", "same", i) for i in range(n)]
    blocks = [(1, i, "* the same long line of text") for i in range(n)]
    got = find_blocks(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(blocks, "doc_id long, block_index long, text string"))
    assert {(x.para_index, x.block_index, x.step) for x in got.collect()} == {(i, i, "part") for i in range(n)}


def test_find_blocks_without_rows(spark):
    t, b = spark.createDataFrame([], TARGETS), spark.createDataFrame([], "doc_id long, block_index long, text string")
    assert find_blocks(t, b).collect() == []
    one = spark.createDataFrame([(1, 0, "some text here", None, None, None)], TARGETS)
    assert [tuple(x) for x in find_blocks(one, b).collect()] == [(1, 0, -1, None)]


def test_find_blocks_of_many_keys(spark):
    # More paragraphs cut short than keys are sought one by one, of several lengths, with characters beyond the basic plane.
    from quire.operators.alignment import FEW

    line = lambda i: f"{'😀' * (i % 3)}line number {i} of a text" if i % 4 else f"n{i}😀"
    n = 4 * FEW
    targets = [(1, i, line(i), line(i - 1) if i else None, line(i + 1) if i < n - 1 else None, 0) for i in range(n)]
    blocks = [(1, i, f"?{line(i)} …") for i in range(n)]
    got = find_blocks(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(blocks, "doc_id long, block_index long, text string")).collect()
    assert {(x.doc_id, x.para_index): (x.block_index, x.step) for x in got} == plain(targets, blocks)


def test_next_texts_are_not_sought_row_by_row(spark):
    # A frame up to the end of the document would take n * n / 2 steps.
    from quire.operators.references import neighbour_text

    n = 300_000
    p = spark.range(n).selectExpr("1L as doc_id", "cast(id as int) as para_index", "case when id in (0, 299999) then concat('t', id) else ' ' end as text")
    assert neighbour_text(p).groupBy("prev_text", "next_text").count().count() == 3

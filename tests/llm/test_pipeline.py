"""The corpus pipeline against a plain version on a small corpus."""

from __future__ import annotations

import random
from itertools import combinations

import pandas as pd

from tests.llm.test_operators import edit_distance, text


def plain(rows, model, items):
    """rows: (doc_id, text) in order → {doc_id: text before the last stage}."""
    from quire.llm.decontaminate import WindowSet, strip_spans, words_of
    from quire.llm.quality_rules import judge

    docs = {i: t for i, t in rows if judge(t, model)[6]}
    seen, out = [], {}
    for i, t in sorted(docs.items()):
        kept = []
        for line in t.split("\n"):
            if line.strip():
                near = any(line == x or min(len(line), len(x)) >= 4 and abs(len(line) - len(x)) <= 1 and edit_distance(line, x) <= 1 for x in seen)
                seen.append(line)
                if near:
                    continue
            kept.append(line)
        if kept == t.split("\n") or "\n".join(kept).strip():
            out[i] = "\n".join(kept)
    sets = {}
    for i, t in out.items():
        w = words_of(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    lead = {i: i for i in out}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(out, 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and lead[a] != lead[b]:
                lead[a] = lead[b] = min(lead[a], lead[b])
                changed = True
    known, clean = WindowSet(items, 10), {}
    for i, t in out.items():
        if lead[i] == i:
            hit, _ = known.scan(words_of(t))
            if hit.sum() <= 0.5 * len(hit):
                clean[i] = strip_spans(t, hit) if hit.any() else t
    return clean


def test_pipeline_against_plain_version(spark, tmp_path):
    import corpus_pipeline
    from quire.llm import pieces as P
    from quire.llm.common import table
    from quire.llm.quality_rules import train

    r = random.Random(11)
    lines = [text(r, 12) + "." for _ in range(90)]
    rows = []
    for i in range(60):
        if i % 6 == 5:
            rows.append((i, "\n".join(" ".join(w.upper() + "!!" for w in text(r, 10).split()) for _ in range(3))))
        else:
            own = [r.choice(lines) if r.random() < 0.2 else text(r, 25) + "." for _ in range(4)]
            rows.append((i, "\n".join(own)))
    rows[7] = (7, rows[6][1])  # a copy
    rows[8] = (8, rows[6][1].replace("river", "rivers", 1) + " " + "short end")  # near lines
    near = rows[9][1].split(" ")
    near[3] = "other"
    rows[10] = (10, " ".join(near))
    passage = " ".join(rows[12][1].split()[5:22])
    rows[13] = (13, passage)
    items = [(1, passage), (2, "never seen words of this kind at all in here now ok")]
    pd.DataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(i, 0 if i % 6 == 5 else 1, 0) for i in range(40)], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    d = str(tmp_path)
    model = train(table(spark, d, "documents"), table(spark, d, "labels"))
    want = plain(rows, model, items)
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(want) and 30 < len(want) < 55
    seg = P.Segmenter(P.read_pieces(P.MODEL))
    for i, t in want.items():
        assert got[i].round_trip and seg.decode(got[i].ids) == t
    docs = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

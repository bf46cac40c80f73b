"""Quality rules by line labelling (operator 6).

A linear-chain conditional random field over the lines of a text marks each
as content or boilerplate (Viterbi decoding); the share of words in content
lines decides whether the document is kept. Base counts reject first.

The field is fitted on a bounded sample of labelled documents (max_docs, the
smallest hashes of doc_id), all lines of each. Labels are of documents, the
field is about lines: it starts without transitions from lines that bear their
document's label, and then labels the lines anew with each fit, so that lines
of a bad document that look like other documents' prose become content, and
the other way round. A good document keeps at least half of its lines as
content, a bad one at least half as boilerplate. All documents are then judged
over their whole texts.

Defined cases: null and blank texts have no words and fail the base rule;
texts and lines of any length are judged whole; repeated rows are judged alike,
a doc_id that repeats counts once in the fit; equal scores mean content;
without labels of both kinds the built-in weights are used; an empty table
gives an empty result; other columns don't matter (see common.pick).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, pick, place_of, table

MAX_DOCS, MIN_SHARE = 4000, 0.5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FEATURES = ("bias", "symbols_per_word", "upper_share", "exclaims_per_word", "digit_share", "word_length", "same_as_before", "repeat_share", "long_line", "short_line", "ends_sentence", "first_line")
#: Log-odds of boilerplate where nothing can be learned.
DEFAULT = {"w": [-2.0, 4.0, 4.0, 3.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, -0.5, 0.0], "t": [[0.5, -0.5], [-0.5, 0.5]]}


def base_counts(raw: bytes, n_chars: int) -> tuple[tuple[int, int, int, int, int], list[tuple[bytes, list[bytes]]]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the lines that hold a word."""
    words = raw.split()
    spaces = sum(map(raw.count, (SPACES[i : i + 1] for i in range(6))))
    symbols = sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(8))))
    lines = [(x, w) for x in raw.split(b"\n") if (w := x.split())]
    dup = len(lines) - len({x for x, _ in lines})
    repeat = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        seen: set = set(grams)
        if len(seen) < len(grams):
            count: dict = {}
            for g in grams:
                count[g] = count.get(g, 0) + 1
            end = 0
            for i, g in enumerate(grams):
                if count[g] > 1:
                    repeat += i + 5 - max(end, i)
                    end = i + 5
    return (len(words), n_chars - spaces, symbols, dup, repeat), lines


_NOT_UPPER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_NOT_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)


def line_features(lines: list[tuple[bytes, list[bytes]]]) -> np.ndarray:
    """A row of FEATURES for each line; the line before is the only context."""
    out = np.zeros((len(lines), len(FEATURES)), np.float64)
    before = None
    for i, (line, words) in enumerate(lines):
        n, size = len(words), len(line)
        out[i] = (
            1.0,
            min(2.0, len(line.translate(None, _NOT_SYMBOL)) / n),
            len(line.translate(None, _NOT_UPPER)) / size,
            min(2.0, line.count(b"!") / n),
            len(line.translate(None, _NOT_DIGIT)) / size,
            min(2.0, size / n / 10),
            line == before,
            1 - len(set(map(bytes, words))) / n if n > 3 else 0.0,
            n > 60,
            n < 5,
            line.rstrip()[-1:] in b".?!\xbb",
            i == 0,
        )
        before = line
    return out


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence (0 content, 1 boilerplate) for score[i, label]; ties go to content."""
    n = len(score)
    t00, t01, t10, t11 = trans.ravel().tolist()
    rows = score.tolist()
    a, b = rows[0]
    back = []
    for s0, s1 in rows[1:]:
        x, y = a + t00, b + t10
        u, v = a + t01, b + t11
        back.append((x < y, u < v))
        a, b = max(x, y) + s0, max(u, v) + s1
    out = np.zeros(n, np.int8)
    state = int(b > a)
    out[-1] = state
    for i in range(n - 2, -1, -1):
        state = int(back[i][state])
        out[i] = state
    return out


def label_lines(lines, model: dict) -> np.ndarray:
    if not lines:
        return np.zeros(0, np.int8)
    w = np.asarray(model["w"])
    score = np.zeros((len(lines), 2))
    score[:, 1] = line_features(lines) @ w
    return viterbi(score, np.asarray(model["t"]))


def _expected(x: np.ndarray, on: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of features and of label pairs that the field expects over padded sequences."""
    n, most, both = len(x), x.shape[1], on[:, 1:]
    e = np.zeros((n, most, 2))
    e[..., 1] = x @ w
    alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    alpha[:, 0] = e[:, 0]
    for i in range(1, most):
        alpha[:, i] = np.logaddexp(alpha[:, i - 1, :1] + t[0], alpha[:, i - 1, 1:] + t[1]) + e[:, i]
        alpha[:, i] = np.where(on[:, i, None] > 0, alpha[:, i], alpha[:, i - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for i in range(most - 2, -1, -1):
        nxt = e[:, i + 1] + beta[:, i + 1]
        b = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
        beta[:, i] = np.where(on[:, i + 1, None] > 0, b, 0.0)
    # After a sequence's end alpha is carried on; beta there is 0 and masked out below.
    p1 = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - z[:, None])) * on
    pair = np.exp(np.minimum(0, alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])) * both[..., None, None]
    return np.einsum("nl,nlk->k", p1, x), pair.sum((0, 1))


def _groups(sequences: list[np.ndarray]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers, padded features, mask) of sequences of like lengths; padding at most doubles the lines."""
    alike: dict[int, list[int]] = {}
    for i, seq in enumerate(sequences):
        alike.setdefault((len(seq) - 1).bit_length(), []).append(i)
    out = []
    for _, some in sorted(alike.items()):
        most = max(len(sequences[i]) for i in some)
        x, on = np.zeros((len(some), most, len(FEATURES))), np.zeros((len(some), most))
        for row, i in enumerate(some):
            x[row, : len(sequences[i])], on[row, : len(sequences[i])] = sequences[i], 1
        out.append((some, x, on))
    return out


def _ascend(groups, marks: list[np.ndarray], w: np.ndarray, t: np.ndarray, steps: int, rate: float, decay: float, chain_decay: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on the conditional likelihood of the marks, from w and t; chain_decay: that of transitions, None to leave them."""
    k = len(FEATURES)
    total = sum(on.sum() for _, _, on in groups)
    seen_w, seen_t = np.zeros(k), np.zeros((2, 2))
    for some, x, on in groups:
        y = np.zeros_like(on)
        for row, i in enumerate(some):
            y[row, : len(marks[i])] = marks[i]
        seen_w += np.einsum("nl,nlk->k", y, x)
        both = on[:, 1:]  # a pair of lines ends here
        for p in (0, 1):
            for q in (0, 1):
                seen_t[p, q] += ((y[:, :-1] == p) * (y[:, 1:] == q) * both).sum()
    w, t = w.copy(), t.copy()
    m = [np.zeros(k), np.zeros((2, 2))], [np.zeros(k), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        sums = [_expected(x, on, w, t) for _, x, on in groups]
        grads = [(seen_w - sum(a for a, _ in sums)) / total - decay * w, (seen_t - sum(b for _, b in sums)) / total - (chain_decay or 0) * t]
        for j, (p, grad) in enumerate(((w, grads[0]), (t, grads[1]))):
            if j and chain_decay is None:
                continue
            m[0][j][...] = 0.9 * m[0][j] + 0.1 * grad
            m[1][j][...] = 0.99 * m[1][j] + 0.01 * grad * grad
            p += rate * (m[0][j] / (1 - 0.9**step)) / (np.sqrt(m[1][j] / (1 - 0.99**step)) + 1e-8)
    return w, t


def constrained(score: np.ndarray, trans: np.ndarray, label: int) -> np.ndarray:
    """Viterbi labels of which at least half are the document's: the least push towards it that gives them (halving steps)."""
    push = np.zeros_like(score)

    def with_push(by: float) -> np.ndarray:
        push[:, label] = by
        return viterbi(score + push, trans)

    enough = lambda y: 2 * int((y == label).sum()) >= len(y)
    y = with_push(0.0)
    if enough(y):
        return y
    low, high = 0.0, 1.0
    while not enough(y := with_push(high)):
        low, high = high, high * 2
    for _ in range(12):
        mid = (low + high) / 2
        if enough(found := with_push(mid)):
            high, y = mid, found
        else:
            low = mid
    return y


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 3, steps: int = 80, rate: float = 0.15, decay: float = 1e-3, chain_decay: float = 0.05) -> dict:
    """Weights of the field from feature sequences of documents and their labels (1: boilerplate).

    First single lines are told apart, each with its document's label; then,
    in rounds, constrained Viterbi gives lines labels of their own and the
    field, transitions included, is fitted to them.
    """
    if not sequences or len(set(labels)) < 2:
        return DEFAULT
    groups = _groups(sequences)
    marks = [np.full(len(x), y) for x, y in zip(sequences, labels, strict=True)]
    w, t = _ascend(groups, marks, np.zeros(len(FEATURES)), np.zeros((2, 2)), steps, rate, decay, None)
    for _ in range(rounds):
        marks = []
        for x, y in zip(sequences, labels, strict=True):
            score = np.zeros((len(x), 2))
            score[:, 1] = x @ w
            marks.append(constrained(score, t, y))
        w, t = _ascend(groups, marks, w, t, steps, rate, decay, chain_decay)
    return {"w": np.round(w, 5).tolist(), "t": np.round(t, 5).tolist()}


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    """The field fitted on at most max_docs labelled documents, chosen by the hash of doc_id."""
    lab = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    d = pick(docs, "doc_id", "text").join(F.broadcast(lab), "doc_id")  # at most max_docs rows

    def run(batches):
        for b in batches:
            ids, feats, ys = [], [], []
            for i, text, q in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                _, lines = base_counts((text or "").encode("utf-8", "surrogatepass"), 0)
                if lines:
                    ids.append(i)
                    feats.append(line_features(lines).astype(np.float32).tobytes())
                    ys.append(1 - q)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(feats, pa.binary()), pa.array(ys, pa.int64())], names=["doc_id", "x", "y"])

    rows = d.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, x binary, y long")
    # A doc_id that repeats counts once, so the bound holds.
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("s")).select("doc_id", "s.x", "s.y").collect())
    return fit([np.frombuffer(r[1], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows], [r[2] for r in rows])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(text: str | None, model: dict, min_share: float = MIN_SHARE) -> tuple:
    text = text or ""
    counts, lines = base_counts(text.encode("utf-8", "surrogatepass"), len(text))
    n, _, _, _, repeat = counts
    failed = n < 10 or 100 * repeat > 20 * n
    marks = label_lines(lines, model)
    content = sum(len(w) for (_, w), m in zip(lines, marks.tolist(), strict=True) if not m)
    share = content / n if n else 0.0
    return (*counts, failed, not failed and share >= min_share, share)


def apply_rules(docs: DataFrame, model: dict, min_share: float = MIN_SHARE) -> DataFrame:
    """docs(doc_id, text) → doc_id and RESULT."""

    def run(batches):
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in batches:
            cols = list(zip(*(judge(t, model, min_share) for t in b.column(1).to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    d = pick(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def keep_good(docs: DataFrame, model: dict, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, all columns, whose text is kept: one narrow pass."""
    at, plain = place_of(docs.columns, "text"), numbered(docs)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([judge(t, model, min_share)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))

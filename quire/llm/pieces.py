"""N-best piece segmentation and decoding (operator 8).

A text is a lattice of vocabulary pieces. Forward Viterbi scores of every
position are exact heuristics for a backward A-star search, which therefore
yields complete segmentations best first. No piece holds a space mark other
than in a run at its start, nor a line end next to anything else (checked on
load), so every path passes the starts of words: the lattice falls apart into
words. The forward pass keeps the two best scores of each position, so it
also tells what a word loses if it is not at its best; the N best of a text
differ from its best in at most N-1 words, those with the smallest loss, and
only in these does the backward search branch. Elsewhere it would follow the
best path, which is read off the forward pass. One queue serves a text: an
entry has the segmentations of some words replaced by later ones of their own
searches, all else at its best, and is what an exact heuristic makes it, a
complete segmentation with its score; N are taken out.

The forward pass takes all different words of a slice of texts at once, one
character at a time (numpy); words over LONG characters are done one by one.
Memory: a slice (SLICE bytes or one text), the vocabulary, and at most
REMEMBERED words' searches.

Scores are the model's, summed as exact integers if all are whole. Of a merge
vocabulary, as the given one, they are minus the merge rank and no
log-probabilities: "best" means the greatest sum of these, which is not the
segmentation that merging in order of rank gives. A character that no piece
covers is spelt in byte pieces for one penalty below every piece's score.

Defined cases: null and empty texts have no pieces, score 0 and one
segmentation; a space mark in the text is a space; texts with fewer than N
segmentations give what they have; equal scores: the same order on every run
(longest last piece first within a word, earlier word first); texts and words
of any length are segmented whole; repeated rows give equal rows; an empty
table gives no rows; other columns don't matter (see common.pick).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import count, islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]*|\n")
SLICE, LONG, REMEMBERED = 1_000_000, 64, 20_000


def read_pieces(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: piece, byte or other."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 … (size[0] of them), start[1] …"""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class Trie:
    """Characters of pieces as steps between nodes, in one open hash table, so that many words step at once."""

    def __init__(self, known: dict[str, tuple[int, float]]):
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for piece, own in known.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, ord(c)), len(steps) + 1)
            ends[node] = own
        self.mask = np.int64((1 << max(4, (4 * len(steps)).bit_length())) - 1)
        keys = np.array([n << 21 | c for n, c in steps], np.int64)
        to = np.fromiter(steps.values(), np.int32, len(steps))
        self.key = np.full(self.mask + 1, -1, np.int64)
        self.to = np.zeros(self.mask + 1, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.key[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]], self.to[slot[won]] = keys[won], to[won]
            left = np.setdiff1d(left, won)
            slot[left] = slot[left] + 1 & self.mask
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        self.score = np.zeros(len(steps) + 1)
        for node, (i, s) in ends.items():
            self.piece[node], self.score[node] = i, s

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(35)) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of each, 0 for none."""
        keys = node.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.to[slot], 0)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        keys, slot = keys[open_], slot[open_]
        while len(open_):
            slot = slot + 1 & self.mask
            found = self.key[slot]
            out[open_] = np.where(found == keys, self.to[slot], 0)
            more = (found != keys) & (found != -1)
            open_, keys, slot = open_[more], keys[more], slot[more]
        return out


class Segmenter:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        whole = all(float(s).is_integer() for _, s, _ in pieces)
        self.known = {p: (i, int(s) if whole else s) for i, (p, s, k) in enumerate(pieces) if k == "piece"}
        if odd := [p for p in self.known if _WORD.fullmatch(p) is None]:
            raise ValueError(f"pieces that reach over a word's end: {odd[:5]}")
        self.longest = max(map(len, self.known), default=1)
        self.trie = Trie(self.known)
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        worst = min((s for _, s in self.known.values() if s > -1e8), default=0)
        self.penalty = worst - 10
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "piece" else b"" for p, _, k in pieces]
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.top: dict = {}

    # ---- one word --------------------------------------------------------------------------------

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position, (start, score, ids) of the pieces that end there, longest first."""
        known, longest, out = self.known, self.longest, []
        for end in range(1, len(word) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                if (hit := known.get(word[start:end])) is not None:
                    here.append((start, hit[1], (hit[0],)))
            if not here or here[-1][0] != end - 1:
                spelt = word[end - 1].encode("utf-8", "surrogatepass")
                here.append((end - 1, self.penalty, tuple(self.byte.get(c, 0) for c in spelt)))
            out.append(here)
        return out

    @staticmethod
    def forward(edges) -> list[float]:
        best = [0]
        for here in edges:
            best.append(max(best[s] + w for s, w, _ in here))
        return best

    def search(self, word: str):
        """Complete segmentations (score, ids) of a word, best first: backward A-star."""
        edges = self.edges(word)
        best = self.forward(edges)
        no = count()
        # (-(score of the rest + what the prefix can reach), newest first, position, score of the rest, linked ids)
        heap = [(-best[-1], 0, len(word), 0, None)]
        while heap:
            _, _, at, gone, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                yield gone, ids
                continue
            for start, w, own in reversed(edges[at - 1]):
                heapq.heappush(heap, (-(gone + w + best[start]), -next(no), start, gone + w, (own, tail)))

    def best_of(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best of a word; words with a small loss come again and again."""
        if (found := self.top.get((word, n))) is None:
            found = [(s, pack(f"<{len(x)}I", *x)) for s, x in islice(self.search(word), n)]
            if len(word) <= LONG:
                if len(self.top) >= REMEMBERED:
                    self.top.clear()
                self.top[word, n] = found
        return found

    # ---- many words ------------------------------------------------------------------------------

    def words(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, loss of the second best or inf, number of ids, ids one word after the other) of words in an array of code points."""
        n = len(start)
        score, loss, many = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        spelt: dict[int, list[int]] = {}
        parts, low = [], 0
        for high in (8, 16, 32, LONG, None):
            mine = np.flatnonzero((size > low) & (size <= high) if high else size > low)
            low = high
            if not len(mine):
                continue
            if high is None:
                for i in mine.tolist():
                    two = list(islice(self.search(_str(chars[start[i] : start[i] + size[i]])), 2))
                    spelt[i], score[i] = two[0][1], two[0][0]
                    loss[i] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
                continue
            mine = mine[np.argsort(-size[mine], kind="stable")]
            score[mine], loss[mine], ids, own, odd = self._forward(chars, start[mine], size[mine])
            parts.append((mine[own], ids))
            for i in mine[odd].tolist():  # a character that no piece covers
                spelt[i] = next(self.search(_str(chars[start[i] : start[i] + size[i]])))[1]
        for i, ids in spelt.items():
            parts.append((np.full(len(ids), i), np.array(ids, np.int64)))
        own = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, np.int64)
        many = np.bincount(own, minlength=n)
        return score, loss, many, ids[np.argsort(own, kind="stable")].astype("<u4")

    def _forward(self, chars, start, size):
        """Viterbi with the two best scores of each position, over words sorted by falling length.

        → score, loss, ids and their words (in order within a word; without
        the words of the last), words with a character that is no piece.
        """
        n, most, trie = len(start), int(size[0]), self.trie
        at_least = np.searchsorted(-size, -np.arange(1, most + 1), "right")  # words of so many characters
        grid = np.zeros((most, n), np.int64)
        for i in range(most):
            grid[i, : at_least[i]] = chars[start[: at_least[i]] + i]
        best, second = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -np.inf)
        back, piece = np.zeros((most + 1, n), np.int8), np.full((most + 1, n), -1, np.int32)
        best[0] = 0

        def relax(s, e, w, score, own):
            one, two = best[s, w] + score, second[s, w] + score
            top, runner = best[e, w], second[e, w]
            second[e, w] = np.maximum(np.maximum(runner, np.minimum(top, one)), two)
            won = one > top  # longer pieces came first: of equal ones they stay
            w = w[won]
            best[e, w], back[e, w], piece[e, w] = one[won], s, own[won] if isinstance(own, np.ndarray) else own

        for s in range(most):
            w = np.arange(at_least[s])
            node = np.zeros(len(w), np.int64)
            for e in range(s + 1, min(most, s + self.longest) + 1):
                if e > s + 1:
                    on = w < at_least[e - 1]
                    w, node = w[on], node[on]
                node = trie.step(node, grid[e - 1, w])
                own = trie.piece[node]
                hit = own >= 0
                if e == s + 1 and not hit.all():
                    bare = w[~hit]
                    relax(s, e, bare, self.penalty, -1)
                if hit.any():
                    relax(s, e, w[hit], trie.score[node[hit]], own[hit])
                on = node > 0
                w, node = w[on], node[on]
                if not len(w):
                    break
        all_ = np.arange(n)
        score, at = best[size, all_], size.copy()
        loss = score - second[size, all_]
        ids, own, odd = [], [], np.zeros(n, bool)
        w = all_
        while len(w):
            i = piece[at[w], w]
            odd[w[i < 0]] = True
            ids.append(i)
            own.append(w)
            at[w] = back[at[w], w]
            w = w[at[w] > 0]
        ids, own = np.concatenate(ids[::-1]), np.concatenate(own[::-1])
        even = ~odd[own]
        return score, loss, ids[even], own[even], np.flatnonzero(odd)

    # ---- texts -----------------------------------------------------------------------------------

    def encode_all(self, texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, bytes]]]]:
        """(ids of the best segmentations one text after the other, their numbers, the n best (score, ids as little-endian 32-bit) of each text)."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        length = np.array([len(t) for t in marked], np.int64)
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(length) - length
        begin = np.zeros(len(chars) + 1, bool)
        line, mark = chars == 10, chars == ord(MARK)
        begin[1:-1] = line[1:] | line[:-1] | (mark[1:] & ~mark[:-1])
        begin[first] = True
        start = np.flatnonzero(begin[:-1])
        size = np.diff(start, append=len(chars))
        of, which = _distinct(chars, start, size)
        score, loss, many, ids = self.words(chars, start[of], size[of])
        at = np.cumsum(many) - many
        word_many = many[which]
        ids = ids[_ranges(at[which], word_many)]
        word_at = np.concatenate(([0], np.cumsum(word_many)))
        word_first = np.searchsorted(start, first)
        word_next = np.append(word_first[1:], len(start)) if len(first) else word_first
        word_next = np.where(length > 0, word_next, word_first)
        total = np.concatenate(([0.0], np.cumsum(score[which])))
        total = total[word_next] - total[word_first] if self._whole(total) else np.array([score[which[a:b]].sum() for a, b in zip(word_first.tolist(), word_next.tolist(), strict=True)])
        number = word_at[word_next] - word_at[word_first]
        branching = self._least(loss[which], word_first, word_next, n - 1)
        out, lows, highs = [], word_at[word_first].tolist(), word_at[word_next].tolist()
        for t, sum_, a, b, some in zip(marked, total.tolist(), lows, highs, branching, strict=True):
            best = ids[a:b].tobytes()
            if not some:
                out.append([(sum_, best)])
                continue
            places = [(4 * int(word_at[i] - a), 4 * int(word_at[i + 1] - a)) for i in some]
            options = [self.best_of(_str(chars[start[i] : start[i] + size[i]]), n) for i in some]
            found = []
            for minus, turned in islice(_best_first(sum_, options[::-1]), n):
                own, done = [], 0
                for (x, y), o, c in zip(places, options, turned[::-1], strict=True):
                    own += [best[done:x], o[c][1]]
                    done = y
                found.append((-minus, b"".join([*own, best[done:]])))
            out.append(found)
        return ids, number, out

    @staticmethod
    def _whole(total: np.ndarray) -> bool:
        return bool(abs(total[-1]) < 2**52 and (total == np.trunc(total)).all())

    @staticmethod
    def _least(loss, first, past, most: int) -> list[list[int]]:
        """The `most` words of least loss of each text, the first of equal ones, in text order."""
        out: list[list[int]] = [[] for _ in range(len(first))]
        has = np.flatnonzero(past > first)
        if not len(has):
            return out
        loss = loss.copy()
        text = np.repeat(np.arange(len(has)), (past - first)[has])
        for _ in range(most):
            low = np.minimum.reduceat(loss, first[has])
            at = np.flatnonzero((loss == low[text]) & np.isfinite(loss))
            if not len(at):
                break
            where, i = np.unique(text[at], return_index=True)
            at = at[i]
            loss[at] = np.inf
            for k, w in zip(has[where].tolist(), at.tolist(), strict=True):
                out[k].append(w)
        return [sorted(x) for x in out]

    def encode(self, text: str | None, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids as little-endian 32-bit), best first."""
        return self.encode_all([text], n)[2][0]

    def decode_all(self, ids: np.ndarray, number: np.ndarray) -> list[bytes]:
        """UTF-8 of texts whose ids stand one after the other, number[i] of each."""
        size = self.raw_size[ids]
        raw = self.raw_bytes[_ranges(self.raw_start[ids], size)].tobytes()
        at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(number)))].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "surrogatepass")


def _best_first(total: float, options: list[list[tuple[float, bytes]]]):
    """(minus the score, rank of each word's segmentation), best first, for words (the last of the text first) with their segmentations best first; the others are at their best, all together `total`.

    Of equal scores the smaller ranks come first. Each entry comes from the one
    with its last changed word one rank better, which is not worse, so it is
    pushed once and never too late.
    """

    def entry(ranks: tuple[int, ...], free: int):
        return -(total + sum(o[k][0] - o[0][0] for o, k in zip(options, ranks, strict=True))), ranks, free

    heap = [entry((0,) * len(options), 0)]
    while heap:
        minus, ranks, free = heapq.heappop(heap)
        yield minus, ranks
        for i in range(free, len(options)):
            if ranks[i] + 1 < len(options[i]):
                heapq.heappush(heap, entry((*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]), i))


def _str(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def _distinct(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different word, the number of its word for each place): words of equal 64-bit fingerprints are compared, such as differ stay apart, and so do words over LONG."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        order = np.argsort(-size, kind="stable")
        key = np.zeros(len(start), np.uint64)
        begin, sizes = start[order], -size[order]
        mixed = (chars + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD1342543DE82EF95)
        mixed ^= mixed >> np.uint64(29)
        for i in range(LONG):
            n = int(np.searchsorted(sizes, -i, "left"))  # words of more than i characters
            if not n:
                break
            key[:n] += mixed[begin[:n] + i] * up[i]
        key[: int(np.searchsorted(sizes, -LONG, "left"))] = 0
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) ^ (-sizes).astype(np.uint64)
    back = np.empty_like(key)
    back[order] = key
    long_ = np.flatnonzero(size > LONG)
    back[long_] = np.arange(len(long_), dtype=np.uint64)
    _, of, which = np.unique(back, return_index=True, return_inverse=True)
    same = chars[np.minimum(_ranges(start[of[which]], size), len(chars) - 1)] == chars[_ranges(start, size)]
    odd = np.flatnonzero((size[of[which]] != size) | (np.add.reduceat(~same, np.cumsum(size) - size) > 0)) if not same.all() or (size[of[which]] != size).any() else size[:0]
    if len(odd):
        of, which = np.concatenate((of, odd)), which.copy()
        which[odd] = np.arange(len(of) - len(odd), len(of))
    return of, which


def _slices(sizes: list[int | None], most: int = SLICE):
    """(from, to) of runs of texts that have `most` bytes together, or of one text."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + (n or 0) > most:
            yield at, i
            at, held = i, 0
        held += n or 0
    if at < len(sizes):
        yield at, len(sizes)


#: One a worker process and model file.
_BUILT: dict[str, Segmenter] = {}
NAMES = ["doc_id", "ids", "n_pieces", "score", "nbest_scores", "nbest_sha256", "round_trip"]


def encode_documents(docs: DataFrame, n: int = 3, model_file: str = MODEL, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) → doc_id, ids (best; null unless with_ids), n_pieces, score, nbest_scores, nbest_sha256, round_trip.

    nbest_sha256: of each segmentation's ids as little-endian 32-bit words.
    round_trip: decoding the best gives the text again (marks as spaces).
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_pieces(model_file))  # a vocabulary file: bounded
    key = hashlib.sha256(model_file.encode()).hexdigest()

    def run(batches):
        seg = _BUILT.get(key)
        if seg is None:
            _BUILT.clear()
            seg = _BUILT[key] = Segmenter(sent.value)
        for b in batches:
            for low, high in _slices(pc.binary_length(b.column(1)).to_pylist()):
                part = b.slice(low, high - low)
                texts = part.column(1).to_pylist()
                ids, number, found = seg.encode_all(texts, n)
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4")))
                else:
                    lists = pa.nulls(len(texts), pa.list_(pa.int32()))
                again = [raw == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass") for raw, t in zip(seg.decode_all(ids, number), texts, strict=True)]
                cols = [
                    pa.array(number, pa.int64()),
                    pa.array([f[0][0] for f in found], pa.float64()),
                    pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                    pa.array([[hashlib.sha256(x).hexdigest() for _, x in f] for f in found], pa.list_(pa.string())),
                    pa.array(again, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *cols], names=NAMES)

    d = pick(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long, score double, nbest_scores array<double>, nbest_sha256 array<string>, round_trip boolean")


def op8_pieces(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), n=3, with_ids=False).drop("ids")

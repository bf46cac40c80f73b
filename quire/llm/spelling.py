"""Spelling variants by search schemes over a bidirectional FM-index (operator 12).

Two words are near if one edit parts them. With m characters in the shorter,
either the first m // 2 characters of both are equal or the last m - m // 2
are. So words that share a half are dealt to the same shard. A shard's
delimited words (``$one$two$``) get an FM-index in both directions. Every word
is matched from the delimiter over one exact half, which gives an interval of
suffix ranks in both directions; then the direction turns and the other half
is extended with at most one character replaced or inserted. (What is one
deletion away is found from the shorter word, by an insertion.)

A half shared by more than HOT words is split: of two such words, the rests
share a half in turn, and so on, until groups are small or one character is
left. Each pair is given once, by the first of its shared halves. No group,
and so no task, grows with the number of words that share a beginning.

A word has at most (2 * length + 1) * alphabet near words, so pairs grow with
the vocabulary. A form has at least twice the count of its word, so chains
have at most 63 steps and roots come from at most 6 rounds of doubling.

Defined cases: null and empty texts have no words; a null doc_id is written
``null``; repeated rows count again; words and texts of any length are taken
whole; of near words with equal counts the smallest in code-point order is the
form; without words the result is empty; other columns don't matter (see
common.pick).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, shuffle_partitions, stored, table

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, DAMAGE, RATIO = 5, 3, 97, 2
#: Words of a group beyond which its key is split; words of a shard, on average.
HOT, SHARD = 20_000, 40_000


# ---- the vocabulary ------------------------------------------------------------------------------


def count_words(docs: DataFrame, damage: int | None = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of docs(doc_id, text): runs of letters, A-Z made small; with `damage`, a run whose checksum that number divides loses one code point."""
    d = pick(docs, "doc_id", "text").where("text is not null")
    runs = d.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    low = F.when(plain, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = runs.select("doc_id", low.alias("run"))
    word = F.col("run")
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    # The length is tested before the count: short words, the commonest, take no part in the exchange.
    return runs.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- groups of words that share a half -----------------------------------------------------------


def _halves(rest: Column, m: Column) -> list[tuple[str, Column, Column, Column]]:
    """(side, the shared part, the rest without it, characters of the shorter rest) for rests of m or m + 1 characters."""
    h = F.floor(m / 2).cast("int")
    n = F.length(rest)
    return [
        ("L", F.substring(rest, F.lit(1), h), F.substring(rest, h + 1, n), m - h),
        ("R", F.substring(rest, n - (m - h) + 1, m - h), F.substring(rest, F.lit(1), n - (m - h)), h),
    ]


def _split(rows: DataFrame) -> DataFrame:
    """Each row of rows(word, n, asks, path, key, rest, m) by the two halves of its rest."""
    made = [F.struct("word", "n", "asks", F.concat("path", F.lit(side)).alias("path"), F.xxhash64("key", F.lit(side), "m", part).alias("key"), left.alias("rest"), m.cast("int").alias("m")) for side, part, left, m in _halves(F.col("rest"), F.col("m"))]
    return rows.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def deal(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, asks, path, key): each word with the keys of its groups; asks: whether it searches there, as the shorter or equal word."""
    as_short = vocabulary.select("word", "n", F.lit(True).alias("asks"), F.lit("").alias("path"), F.lit(0).cast("long").alias("key"), F.col("word").alias("rest"), F.length("word").alias("m"))
    as_long = as_short.withColumn("asks", F.lit(False)).withColumn("m", F.col("m") - 1)
    open_, done = stored(_split(as_short.unionByName(as_long).where("m >= 1")), "spelling-groups"), []
    while True:
        large = open_.groupBy("key").agg(F.count("*").alias("c"), F.max("m").alias("m")).where((F.col("c") > hot) & (F.col("m") >= 2)).select("key")
        large = stored(large, "spelling-large")
        if large.isEmpty():
            done.append(open_)
            break
        # There are at most rows / hot such keys: few beside the rows, and no key repeats.
        done.append(open_.join(large.hint("shuffle_hash"), "key", "left_anti").select(*open_.columns))
        open_ = stored(_split(open_.join(large.hint("shuffle_hash"), "key", "left_semi").select(*open_.columns)), "spelling-groups")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("word", "n", "asks", "path", "key")


def first_shared(a: str, b: str, path: str) -> bool:
    """Whether `path` is the first of the paths of shared halves of two near words, a not longer than b."""
    m = len(a)
    for side in path:
        h = m // 2
        if (a[:h] == b[:h]) != (side == "L"):
            return False
        if side == "L":
            a, b, m = a[h:], b[h:], m - h
        else:
            a, b, m = a[: len(a) - (m - h)], b[: len(b) - (m - h)], h
    return True


# ---- the index -----------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes (prefix doubling)."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        pair = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(pair, kind="stable")
        step = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if n == 0 or step[-1] == n - 1:
            return order
        k *= 2


class Ranks:
    """Burrows-Wheeler transform of a text and its end (symbol 0), with counts of smaller symbols at the starts of blocks."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        self.suffixes = suffix_array(text)
        bwt = text[self.suffixes - 1]
        n, self.symbols = len(text), symbols
        self.block = 32
        while n // self.block * symbols > 1 << 23:
            self.block *= 2
        rows = -(-n // self.block) + 1
        self.padded = np.full(rows * self.block, symbols, bwt.dtype)
        self.padded[:n] = bwt
        grid = self.padded.reshape(rows, self.block)
        counts = np.zeros((rows + 1, symbols + 1), np.int32)
        cell = np.repeat(np.arange(rows), self.block) * (symbols + 1) + self.padded
        counts[1:] = np.bincount(cell, minlength=rows * (symbols + 1)).reshape(rows, symbols + 1)
        # smaller[r, c]: symbols below c before block r
        self.smaller = np.zeros((rows + 1, symbols + 2), np.int32)
        self.smaller[:, 1:] = np.cumsum(np.cumsum(counts, axis=0), axis=1)
        self.grid = grid
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int64)
        self.places = np.arange(self.block)

    def below(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols below c, and equal to c, in the transform before each place."""
        row, inside = at // self.block, at % self.block
        block = self.grid[row]
        mine = self.places < inside[:, None]
        less = ((block < c[:, None]) & mine).sum(axis=1)
        same = ((block == c[:, None]) & mine).sum(axis=1)
        low = self.smaller[row, c]
        return low + less, self.smaller[row, c + 1] - low + same

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval extended by c, and how many of the old one's extensions are smaller."""
        less, a = self.below(lo, c)
        more, b = self.below(hi, c)
        return self.first[c] + a, self.first[c] + b, more - less

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, symbol) of all characters that extend each interval."""
        size = hi - lo
        wide = np.flatnonzero(size > 2 * self.symbols)
        slim = np.flatnonzero((size <= 2 * self.symbols) & (size > 0))
        end = np.cumsum(size[slim])
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(lo[slim] - (end - size[slim]), size[slim])
        pair = np.unique(np.repeat(slim, size[slim]) * (self.symbols + 1) + self.padded[at])
        which, c = pair // (self.symbols + 1), pair % (self.symbols + 1)
        which = np.concatenate((which, np.repeat(wide, self.symbols)))
        c = np.concatenate((c, np.tile(np.arange(self.symbols), len(wide))))
        return which[c > 1], c[c > 1]


class BidirectionalIndex:
    """Words (different ones) between delimiters, searchable to the left and to the right."""

    def __init__(self, words: list[str]):
        self.words = words
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet, coded = np.unique(raw, return_inverse=True)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size  # in the delimited text
        n = int(self.size.sum()) + len(words) + 1
        self.text = np.ones(n, np.int32)
        own = np.ones(n, bool)
        own[np.concatenate(([0], self.start + self.size))] = False
        self.text[own] = coded + 2
        self.word_at = np.zeros(n, np.int64)
        self.word_at[self.start - 1] = np.arange(len(words))
        symbols = len(self.alphabet) + 2
        self.left = Ranks(self.text, symbols)
        self.right = Ranks(self.text[::-1], symbols)

    def _exact(self, ranks: Ranks, first: np.ndarray, many: np.ndarray, way: int):
        """Intervals of `many` symbols of the text from `first` on, read in direction `way`, then a delimiter: in `ranks` and, kept in step, in the other direction."""
        k = len(first)
        n = len(self.text)
        lo, hi, other = np.zeros(k, np.int64), np.full(k, n + 1, np.int64), np.zeros(k, np.int64)
        for i in range(int(many.max(initial=0)) + 1):
            on = np.flatnonzero(i <= many)
            c = np.where(i < many[on], self.text[np.clip(first[on] + way * i, 0, n - 1)], 1)
            lo[on], hi[on], skipped = ranks.step(lo[on], hi[on], c)
            other[on] += skipped
        return other, other + (hi - lo)

    def near(self, asked: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        """(word, other word) with the asked words' first halves (side L) or last halves (R) equal and the rest one replaced or inserted character apart."""
        size, start = self.size[asked], self.start[asked]
        h = size // 2
        if side == "L":  # match $ and the first half to the left, then go on to the right
            lo, hi = self._exact(self.left, start + h - 1, h, -1)
            ranks, at, many, way = self.right, start + h, size - h, 1
        else:
            lo, hi = self._exact(self.right, start + h, size - h, 1)
            ranks, at, many, way = self.left, start + h - 1, h, -1
        found = []
        q, i = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        wrong = (q[:0], i[:0], lo[:0], hi[:0])  # states with their error made
        n = len(self.text)
        while len(q) or len(wrong[0]):
            # Only the asked word itself is left in an interval of one: no error can lead away from it.
            on = hi - lo > 1
            q, i, lo, hi = q[on], i[on], lo[on], hi[on]
            which, c = ranks.choices(lo, hi)
            a, b, _ = ranks.step(lo[which], hi[which], c)
            real = a < b
            which, c, a, b = which[real], c[real], a[real], b[real]
            inside = i[which] < many[q[which]]
            want = np.where(inside, self.text[np.clip(at[q[which]] + way * i[which], 0, n - 1)], -1)
            other = c != want  # an inserted character before an equal one is the same as after it
            ins = np.flatnonzero(other)
            sub = np.flatnonzero(other & inside)
            match = np.flatnonzero(~other)
            # States that made their error before: the next character, or the delimiter at the end.
            wq, wi, wlo, whi = wrong
            ended = wi == many[wq]
            wc = np.where(ended, 1, self.text[np.clip(at[wq] + way * wi, 0, n - 1)])
            wa, wb, _ = ranks.step(wlo, whi, wc)
            won = wa < wb
            over = np.flatnonzero(won & ended)
            if len(over):
                place = ranks.suffixes[wa[over]]
                # The last symbol matched, a delimiter, stands before the word in the direction of `ranks`.
                place = place if way == -1 else n - 1 - place
                word = self.word_at[place] if way == -1 else np.searchsorted(self.start, place, "left") - 1
                found.append((asked[wq[over]], word))
            go = np.flatnonzero(won & ~ended)
            join = lambda *x: np.concatenate(x)
            wrong = (
                join(wq[go], q[which[ins]], q[which[sub]]),
                join(wi[go] + 1, i[which[ins]], i[which[sub]] + 1),
                join(wa[go], a[ins], a[sub]),
                join(wb[go], b[ins], b[sub]),
            )
            q, i, lo, hi = q[which[match]], i[which[match]] + 1, a[match], b[match]
        if not found:
            return asked[:0], asked[:0]
        pair = np.unique(np.concatenate([x for x, _ in found]) * len(self.words) + np.concatenate([y for _, y in found]))
        return pair // len(self.words), pair % len(self.words)


def shard_pairs(words: list[str], asks: list[bool], paths: list[str]) -> list[tuple[int, int]]:
    """(place, place) of entries of a shard: the asking one and a near one, not shorter, of which its path is the first shared."""
    number: dict[str, int] = {}
    of = [number.setdefault(w, len(number)) for w in words]
    entry = {}
    for k, i in enumerate(of):
        entry.setdefault(i, k)
    index, out = BidirectionalIndex(list(number)), []
    by_path: dict[str, list[int]] = {}
    for k, ask in enumerate(asks):
        if ask:
            by_path.setdefault(paths[k], []).append(k)
    for path, mine in by_path.items():
        a, b = index.near(np.array([of[k] for k in mine], np.int64), path[0])
        back = {of[k]: k for k in mine}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if first_shared(index.words[x], index.words[y], path):
                out.append((back[x], entry[y]))
    return out


PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def near_words(vocabulary: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """vocabulary(word, n), different words → (word, near, near_n): every ordered pair of near words once."""
    spark = vocabulary.sparkSession
    entries = stored(deal(vocabulary, hot), "spelling-entries")
    rows = entries.count()
    shards = max(1, -(-rows // shard), min(shuffle_partitions(spark), -(-rows // 4000)))

    def run(batches):
        words, counts, asks, paths = [], [], [], []
        for b in batches:
            for into, column in zip((words, counts, asks, paths), b.columns, strict=True):
                into += column.to_pylist()
        if not words:
            return
        out = ([], [], [])
        for i, j in shard_pairs(words, asks, paths):
            a, b = words[i], words[j]
            some = [(a, b, counts[j])]
            if len(a) < len(b):  # of equally long words each finds the other
                some.append((b, a, counts[i]))
            for row in some:
                for into, x in zip(out, row, strict=True):
                    into.append(x)
            if len(out[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)

    # A group of at most `hot` words stays together; a partition holds the groups of `shard` words on average.
    return entries.repartition(shards, "key").select("word", "n", "asks", "path").mapInArrow(run, "word string, near string, near_n long")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """vocabulary(word, n) → (word, form, root, n, n_near, form_n)."""
    near = near_words(vocabulary, hot, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    best = vocabulary.join(near.hint("shuffle_hash"), "word", "left")
    form = -F.col("best.minus") >= ratio * F.col("n")
    words = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.minus")).alias("form_n"))
    words = stored(words, "spelling-words")
    roots = stored(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        roots = stored(roots.join(up.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return words.join(roots.select("word", "root").hint("shuffle_hash"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    return group_variants(stored(count_words(table(spark, sf_dir, "documents")), "spelling-vocabulary"))


# The table of checksums is made by its rule; of two near words, the longer less one character is the shorter, or both less the same character are equal.
OP12_SQL = r"""
with tab as (select list_transform(range(256), lambda b: list_reduce(list_prepend(cast(b as bigint), [cast(k as bigint) for k in range(8)]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents where text is not null),
low as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
keyed as (select run, n, hex(encode(coalesce(cast(doc_id as varchar), 'null') || ':' || run)) as x from low),
summed as (select run, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as int), 2) as bigint))), lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 as int) + 1])), 4294967295) as h from keyed, tab),
made as (select case when h % 97 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from summed),
v as (select word, cast(sum(n) as bigint) as n from made where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, unnest(range(0, length(word))) as p from v),
d as (select word, n, cast(p as int) as p, left(word, cast(p as int)) || substr(word, cast(p as int) + 2) as rest from cut),
pair as (
  select a.word, b.word as near, b.n as near_n from d a join d b on a.p = b.p and a.rest = b.rest and a.word <> b.word and length(a.word) = length(b.word)
  union select d.word, v.word, v.n from d join v on d.rest = v.word
  union select v.word, d.word, d.n from d join v on d.rest = v.word),
best as (select word, count(*) as n_near, max(near_n) as top from pair group by word),
one as (select p.word, min(near) as near, any_value(n_near) as n_near, any_value(top) as top from pair p join best b on p.word = b.word and p.near_n = b.top group by p.word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 2 * v.n then near end as form, case when top >= 2 * v.n then top end as form_n from v left join one on v.word = one.word),
r as (with recursive up(word, root) as (select word, coalesce(form, word) from f union all select up.word, f.form from up join f on f.word = up.root where f.form is not null)
  select up.word, up.root from up join f on f.word = up.root where f.form is null)
select f.word, form, r.root, n, n_near, form_n from f join r on f.word = r.word
"""

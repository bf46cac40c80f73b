"""N-gram Jaccard join (operator 2).

MinHash signatures of word n-gram sets are cut into bands; texts meet in a
shuffle on band hashes, and every pair that meets is verified once, in its
first shared band, on the full n-gram sets (64-bit fingerprints of them).

Rows and bands follow from the target recall at the threshold. Equal texts
are one text throughout. A bucket of many texts is dealt over pairs of
blocks, so no task holds more than two blocks; only counts and a spanning
forest of the links leave a task, never all pairs.

Defined cases: a text of 1 to n-1 words has one n-gram, all its words; null
and wordless texts have none and stay alone, one class a row, with class_id
= doc_id and no links; equal texts are copies of each other; a null doc_id
counts as above all others for class_id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, pick, place_of, shuffle_partitions, stored, table
from quire.llm.components import components
from quire.llm.decontaminate import _FOLD

N, THRESHOLD, ROWS, RECALL, BLOCK = 5, 0.8, 5, 0.9999, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands by which a pair at the threshold meets with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE)
        up[0] = 1
        inv = pow(int(_BASE), -1, 1 << 64)
        down = np.full(n, np.uint64(inv))
        down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POW = _powers(1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW
    if len(_POW[0]) < n:
        _POW = _powers(1 << (n - 1).bit_length())
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted fingerprints of the text's set of word n-grams."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)
    gap = raw == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[:-1], dtype=np.uint64)))
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(n, len(word))
    gram = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        gram = (gram + word[i : len(word) - k + 1 + i]) * np.uint64(0xD1342543DE82EF95)
    return np.unique(mix(gram))


class MinHash:
    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(20)
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + _ONE

    def band_hashes(self, grams: np.ndarray) -> bytes:
        low = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(grams), 2048):
            np.minimum(low, (grams[i : i + 2048, None] * self.a).min(0), out=low)
        low = mix(low).reshape(self.bands, self.rows)
        out = np.zeros(self.bands, np.uint64)
        for r in range(self.rows):
            out = mix(out + low[:, r])
        return out.tobytes()


def signatures(keyed: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """(key, text) → (key, bands): 8 bytes a band; texts without n-grams are left out."""

    def run(batches):
        maker = MinHash(rows, bands)
        for b in batches:
            keys, sigs = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(grams := shingles(text, n)):
                    keys.append(key)
                    sigs.append(maker.band_hashes(grams))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["key", "bands"])

    return keyed.select("key", "text").mapInArrow(run, "key binary, bands binary")


def _units(batches, width: int):
    """Rows of sorted batches by their first `width` columns, across batch borders."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for key, group in groupby(rows(), key=itemgetter(*range(width))):
        yield key, list(group)


def _meeting(prefixes: list[bytes]) -> np.ndarray:
    """[i, j]: these two share no earlier band, so here they meet first."""
    m = len(prefixes)
    p = np.frombuffer(b"".join(prefixes), np.uint64).reshape(m, -1)
    shared = np.zeros((m, m), bool)
    for t in range(p.shape[1]):
        shared |= p[:, t, None] == p[None, :, t]
    return ~shared


def _to_compare(unit, rows, at_block: int, at_prefix: int) -> np.ndarray:
    """Upper triangle of the pairs that this unit has to verify."""
    pairs = np.triu(_meeting([r[at_prefix] for r in rows]), 1)
    if unit[2] != unit[3]:
        block = np.array([r[at_block] for r in rows])
        pairs &= block[:, None] != block[None, :]
    return pairs


def jaccard_links(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Of the asked pairs, those with Jaccard similarity of at least the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    ask = pairs & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9)
    out = np.zeros_like(pairs)
    i, j = np.nonzero(ask)
    if len(i) <= 8:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        used = np.unique(np.concatenate((i, j)))
        grams, col, count = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), size[used])
        keep = (count > 1)[col]  # an n-gram of one text is in no intersection
        new = np.cumsum(count > 1) - 1
        row, col = row[keep], new[col[keep]]
        inter = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int((count > 1).sum()), 4096):
            here = (col >= at) & (col < at + 4096)
            m = np.zeros((len(used), 4096), np.float32)
            m[row[here], col[here] - at] = 1
            inter += m @ m.T
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        both = inter[place[i], place[j]].astype(np.int64)
    out[i, j] = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return out


def _forest(links: np.ndarray) -> list[int]:
    root = list(range(len(links)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*(x.tolist() for x in np.nonzero(links)), strict=True):
        if (p := find(a)) != (q := find(b)):
            root[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(links))]


UNIT = ["t", "h", "bi", "bj"]


def similar_texts(keyed: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, text), key one to one with text → links (key, n_links) and forest edges (u, v)."""
    spark, bands = keyed.sparkSession, bands_for(threshold, rows, recall)
    sig = stored(signatures(keyed, n, rows, bands).dropDuplicates(["key"]), "signatures")
    t = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    buckets = sig.select("key", t.alias("t"), "bands").select("key", "t", F.xxhash64(F.substring("bands", F.col("t") * 8 + 1, F.lit(8))).alias("h"))
    full = buckets.groupBy("t", "h").agg(F.count("*").alias("n")).where("n > 1")
    here = buckets.join(full.hint("merge"), ["t", "h"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    here = here.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("key", F.lit(7)), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    here = here.select("t", "h", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "key")
    here = here.join(sig.hint("shuffle_hash"), "key").select(*UNIT, "blk", "key", F.substring("bands", F.lit(1), F.col("t") * 8).alias("prefix"))
    parts = shuffle_partitions(spark)
    here = here.repartition(parts, *UNIT).sortWithinPartitions(*UNIT)

    def needed(batches):
        out: list[tuple] = []
        for unit, group in _units(batches, 4):
            if len(group) > 1:
                pairs = _to_compare(unit, group, 4, 6)
                on = pairs.any(0) | pairs.any(1)
                out += [r for r, o in zip(group, on.tolist(), strict=True) if o]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out):
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=[*UNIT, "blk", "key", "prefix"])

    wanted = stored(here.mapInArrow(needed, "t int, h long, bi int, bj int, blk int, key binary, prefix binary"), "to-verify")
    once = wanted.select("key").distinct()
    texts = keyed.select("key", "text").join(once.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"])
    met = wanted.join(texts.hint("shuffle_hash"), "key").select(*UNIT, "blk", "key", "prefix", "text").repartition(parts, *UNIT).sortWithinPartitions(*UNIT)

    def verify(batches):
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["key", "root", "n"])

        for unit, group in _units(batches, 4):
            pairs = _to_compare(unit, group, 4, 6)
            if pairs.any():
                links = jaccard_links([shingles(r[7], n) for r in group], pairs, threshold)
                degree = links.sum(0) + links.sum(1)
                for r, root, d in zip(group, _forest(links), degree.tolist(), strict=True):
                    if d:
                        out.append((r[5], group[root][5], d))
            if len(out) > 20_000:
                yield flush()
                out.clear()
        yield flush()

    found = stored(met.mapInArrow(verify, "key binary, root binary, n long"), "links")
    return found.groupBy("key").agg(F.sum("n").alias("n_links")), found.select(F.col("key").alias("u"), F.col("root").alias("v")).where("u <> v")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): 16 bytes of the text's SHA-256."""
    return pick(docs, "doc_id", "text").withColumn("key", F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 16))


def _worded(text) -> Column:
    """Without a word there is nothing to compare: such rows stay alone."""
    return F.coalesce(text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))


def _classes(keyed: DataFrame, n: int, threshold: float, rows: int, recall: float, block: int) -> DataFrame:
    """(doc_id, text, key) → (key, label, low, n_copies, n_links, class_id, lead): a row for each different text with a word.

    low: the least doc_id with this text; lead: the text of class_id, the
    least key if it has several of the class.
    """
    d = keyed.where(_worded(F.col("text")))
    links, edges = similar_texts(d.select("key", "text"), n, threshold, rows, recall, block)
    label = components(edges)
    count = d.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"))
    texts = count.join(links.hint("shuffle_hash"), "key", "left").join(label.withColumnRenamed("node", "key").hint("shuffle_hash"), "key", "left")
    texts = stored(texts.withColumn("label", F.coalesce("label", "key")), "texts")
    # Null sorts first in a struct: a text without any doc_id leads only where no other has one.
    least = texts.groupBy("label").agg(F.min(F.struct(F.col("low").isNull(), "low", "key")).alias("first"))
    return texts.join(least.select("label", F.col("first.low").alias("class_id"), F.col("first.key").alias("lead")).hint("shuffle_hash"), "label")


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) → doc_id, class_id, n_links, n_copies: one row a row.

    class_id: the least doc_id of the class; n_links: other texts that are
    similar to this one; n_copies: rows with this very text, itself included.
    """
    keyed = _keyed(docs)
    slim = keyed.select("doc_id", F.when(_worded(F.col("text")), F.col("key")).alias("key"))
    texts = _classes(keyed, n, threshold, rows, recall, block).select("key", "class_id", "n_links", "n_copies")
    done = slim.join(texts.hint("shuffle_hash"), "key", "left")
    return done.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one row of each class: that of the least doc_id (of several texts of it, the one with the least digest).

    Rows without a word stay, but of rows that repeat a doc_id and text one.
    """
    names = docs.columns
    at, text = (F.col(f"_c{place_of(names, k)}") for k in ("doc_id", "text"))
    # One digest of doc_id and text names a row: the semi-join and the removal of repeats deal rows by it alike.
    row = lambda i, key: F.md5(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.coalesce(F.hex(key), F.lit("null"))))
    own = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    d = numbered(docs).withColumn("_row", row(at, own))
    found = _classes(_keyed(docs), n, threshold, rows, recall, block)
    leads = found.where(F.col("key") == F.col("lead")).select(row(F.col("class_id"), F.col("key")).alias("_row"))
    kept = d.where(_worded(text)).join(leads.hint("shuffle_hash"), "_row", "left_semi").dropDuplicates(["_row"])
    return kept.unionByName(d.where(~_worded(text)).dropDuplicates(["_row"])).drop("_row").toDF(*names)


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))

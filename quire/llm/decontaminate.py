"""Benchmark decontamination (operator 5).

A hash set of the benchmark's normalised word windows goes to every task; the
tasks scan the windows of each text, check hits exactly and mark their words.

A benchmark of more than MAX_BROADCAST_CHARS characters is joined by window
instead. A bit map of its windows' checksums, of fixed size, goes to the tasks
first, so that only document windows that may hit are shuffled.

Defined cases: null text has no words; items without words have no window;
an item of fewer words than the window is one window of its own length;
repeated item_ids are one item; a null item_id counts as ``null``. Repeated
documents are judged alike; texts of any length are scanned whole; other
columns stay, also ones whose names clash (see common.pick). An empty
benchmark hits nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, pick, place_of, stored, table

#: ASCII letters become lower case, digits and all bytes from 0x80 stay, the rest parts words.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

WINDOW = 10
#: A character of benchmark text becomes some 150 bytes of Python windows at most, in the driver and in each worker.
MAX_BROADCAST_CHARS = 1_000_000
#: Bits of the map of windows: 16 MB.
FILTER_BITS = 1 << 27


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte ranges of words_of(text)."""
    import re

    return [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8", "surrogatepass").translate(_FOLD))]


class WindowSet:
    """Vocabulary and windows of the benchmark; windows are exact word-number sequences."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, tuple[str, ...]]] = {}
        built: dict[int, dict[bytes, set[str]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                n = min(size, len(ids))
                for i in range(len(ids) - n + 1):
                    built.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), set()).add("null" if item_id is None else str(item_id))
        self.windows = {n: {k: tuple(v) for k, v in d.items()} for n, d in built.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the items with a window here, sorted as strings."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        hit, found = np.zeros(len(ids), bool), set()
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, known in self.windows.items():
            if n <= len(ids):
                for i in np.flatnonzero(gaps[n:] == gaps[:-n]).tolist():
                    if (items := known.get(ids[i : i + n].tobytes())) is not None:
                        hit[i : i + n] = True
                        found.update(items)
        return hit, sorted(found)


def strip_spans(text: str, hit: np.ndarray) -> str:
    """text without the bytes from the first to the last word of each run of hit words."""
    raw, spans = text.encode("utf-8", "surrogatepass"), word_spans(text)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, cleaned string"


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False, max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """docs(doc_id, text) with hit counts, and with clean the text without hit spans.

    The benchmark is broadcast only if its texts hold at most
    max_broadcast_chars; a larger one is joined by window hashes.
    """
    spark = docs.sparkSession
    bench = pick(benchmark, "item_id", "text")
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > max_broadcast_chars:
        return _scan_by_join(docs, bench, window, clean)
    sent = spark.sparkContext.broadcast(WindowSet([(r[0], r[1]) for r in bench.collect()], window))

    def run(batches):
        known = sent.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows = []
            for text in texts:
                words = words_of(text)
                hit, items = known.scan(words)
                n = int(hit.sum())
                rows.append((len(words), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0, (strip_spans(text, hit) if n else text) if clean else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "cleaned"],
            )

    d = pick(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def _window_map(items: DataFrame) -> np.ndarray:
    """A bit for each checksum of a window, as bytes: built by Spark's bitmap aggregate, FILTER_BITS long whatever the benchmark."""
    place = F.pmod(F.crc32("gram"), F.lit(FILTER_BITS)) + 1
    rows = items.select(F.bitmap_bucket_number(place).alias("n"), F.bitmap_bit_position(place).alias("at")).groupBy("n").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for n, bits in rows:
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _windows(df: DataFrame, key: str, sizes: list[int], whole_if_short: bool, window: int, known=None) -> DataFrame:
    """(key, at, size, gram) of all windows; for items, one window if shorter than `window`; known: broadcast bit map of the windows that matter."""

    def run(batches):
        bits = known.value if known is not None else None
        for b in batches:
            out = ([], [], [], [])
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for n in [min(window, len(words))] if whole_if_short else sizes:
                    if n:
                        for i in range(len(words) - n + 1):
                            gram = b" ".join(words[i : i + n])
                            if bits is not None:
                                place = zlib.crc32(gram) % FILTER_BITS
                                if not bits[place >> 3] >> (place & 7) & 1:
                                    continue
                            for c, v in zip(out, (k, i, n, gram), strict=True):
                                c.append(v)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=[key, "at", "size", "gram"])
                    out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=[key, "at", "size", "gram"])

    return df.mapInArrow(run, f"{key} {df.schema[0].dataType.simpleString()}, at long, size int, gram binary")


def _hits_by_join(texts: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """texts(_k, text) → (_k, hits, items) of hit texts, for a benchmark too large to broadcast: windows meet by value in a shuffled join."""
    items = _windows(bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text"), "item_id", [], True, window)
    items = stored(items.select("item_id", "size", "gram").distinct(), "benchmark-windows")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most `window` values
    known = texts.sparkSession.sparkContext.broadcast(_window_map(items))
    grams = _windows(texts.dropDuplicates(["_k"]), "_k", sizes, False, window, known)
    met = grams.join(items.hint("merge"), ["size", "gram"])
    return met.groupBy("_k").agg(F.collect_set(F.struct("at", "size")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))


def _marked(n_words: int, hits) -> np.ndarray:
    out = np.zeros(n_words, bool)
    for h in hits or []:
        out[h["at"] : h["at"] + h["size"]] = True
    return out


def _scan_by_join(docs: DataFrame, bench: DataFrame, window: int, clean: bool) -> DataFrame:
    d = pick(docs, "doc_id", "text").withColumn("_k", F.sha2(F.coalesce("text", F.lit("")), 256))
    met = _hits_by_join(d.select("_k", "text"), bench, window)

    def run(batches):
        for b in batches:
            rows = []
            for text, hits, items_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n_words = len(words_of(text))
                hit = _marked(n_words, hits)
                n, items_ = int(hit.sum()), sorted(items_ or [])
                rows.append((n_words, n, len(items_), hashlib.sha256(",".join(items_).encode()).hexdigest(), n > 0, (strip_spans(text, hit) if n else text) if clean else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "cleaned"],
            )

    both = d.join(met.hint("shuffle_hash"), "_k", "left").select("doc_id", "text", "hits", "items")
    return both.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_hit_share: float = 0.5, max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """docs, all columns, without hit spans; a document of which more than max_hit_share is hit goes."""
    names, plain = docs.columns, numbered(docs)
    i_text, i_size = place_of(names, "text"), place_of(names, "n_chars", None)
    bench = pick(benchmark, "item_id", "text")
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > max_broadcast_chars:
        text = F.col(f"_c{i_text}")
        key = F.sha2(F.coalesce(text, F.lit("")), 256)
        hits = _hits_by_join(plain.select(key.alias("_k"), text.alias("text")), bench, window).select("_k", "hits")
        source = plain.withColumn("_k", key).join(hits.hint("shuffle_hash"), "_k", "left").select(*plain.columns, "hits")
        find = None
    else:
        source, find = plain, docs.sparkSession.sparkContext.broadcast(WindowSet([(r[0], r[1]) for r in bench.collect()], window))

    n_cols = len(names)

    def run(batches):
        for b in batches:
            keep, texts = [], []
            found = b.column(n_cols).to_pylist() if find is None else [None] * b.num_rows
            for t, hits in zip(b.column(i_text).to_pylist(), found, strict=True):
                words = words_of(t)
                hit = _marked(len(words), hits) if find is None else find.value.scan(words)[0]
                n = int(hit.sum())
                keep.append(n <= max_hit_share * len(hit))
                texts.append(strip_spans(t, hit) if n else t)
            cols = list(b.columns)[:n_cols]
            cols[i_text] = pa.array(texts, b.schema.field(i_text).type)
            if i_size is not None:
                cols[i_size] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(i_size).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:n_cols]).filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(run, plain.schema).toDF(*names)


def op5_decontaminate(spark, sf_dir):
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("cleaned")


OP5_SQL = r"""
with dw as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bx as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)),
sizes as (select distinct n from bx),
dx as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
m as (select rid, i, dx.n, item_id from dx join bx on dx.g = bx.g and dx.n = bx.n),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from m)) group by rid),
it as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct rid, cast(item_id as varchar) as s from m) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join h using (rid) left join it using (rid)
"""

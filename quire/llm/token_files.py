"""Token ids in files of patched frame-of-reference blocks (operator 11).

Documents are range-partitioned by doc_id and sorted; each task tokenises its
texts in order and writes one file: a row of Spark's text sink is a segment,
so files go through Spark's own commit protocol to any store that Spark can
write to, and a lost executor's file is simply written again.

A segment holds whole documents, SEGMENT ids or a few more (or one longer
document), and ends with a line feed::

    header   magic, shard, number in the shard, documents, ids, blocks, ids a block, bytes of blocks
    tables   doc_ids (8 bytes), whether each is null, ids of each document (8 bytes)
    index    where each block starts (8 bytes), and the end of the last
    blocks   minimum (4), width (1), exceptions (2), the ids' low bits, places (2) and high bits (4) of exceptions

A block subtracts its minimum and packs at the least width that holds PERCENT
of its ids; the bits above that width of the others stand in its exception
list. The index of block starts gives any run of ids without the rest
(Segment.ids).

A tokenizer that drops white space and joins nothing over it (checked by its
own description, see `parts_at_space`) gives the same ids for a text as for
its space-separated chunks one after the other, so each worker remembers the
ids of chunks: up to REMEMBERED new ones, and those of as many before that come
again. Of the texts that are encoded together, each different chunk is looked
up once; Arrow parts them. Other tokenizers get whole texts.

Defined cases: null and empty texts have only the end id; null doc_ids come
first; rows that repeat a doc_id are ordered by a hash of their text, equal
rows follow each other; texts of any length are encoded whole; other columns
don't matter (see common.pick); an empty table gives files without segments
and no rows. doc_id must be of an integer type.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import pick, shared_folder, shuffle_partitions, stored, table

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END = 1
BLOCK, PERCENT = 1024, 90
#: Ids of a segment, the unit that is held in memory; segments of a file; bytes of text that make one more file.
SEGMENT, SEGMENTS, FILE_BYTES = 1 << 18, 256, 1 << 28
REMEMBERED = 1 << 18
#: Parts chunks that are encoded together; texts that hold it are encoded whole.
MARK = "\x01"
#: Texts that are encoded together.
TEXTS = 1024
TAILS = (b".", b",", b";", b":", b"!", b"?")

MAGIC = b"QTB1"
_HEAD, _BLOCK = struct.Struct("<4sIIIQIIQ"), struct.Struct("<IBH")


# ---- tokenizers ----------------------------------------------------------------------------------


def parts_at_space(description: dict) -> bool:
    """Whether ids of a text are those of its space-separated chunks, by the tokenizer's description.

    So it is if white space never reaches the model (only matches of a pattern
    without white space are kept), the model takes each match by itself, and
    normalising looks at single characters or composes (which never spans a space).
    """
    norm, pre = description.get("normalizer") or {}, description.get("pre_tokenizer") or {}
    steps = lambda x, k: x.get(k, []) if x.get("type") == "Sequence" else [x] if x else []
    norms, pres = steps(norm, "normalizers"), steps(pre, "pretokenizers")
    plain = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in norms)
    split = pres[0] if pres else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    kept = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern and "?!" not in pattern and "?<" not in pattern
    bytes_ = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in pres[1:])
    tokens = all(" " not in t["content"] and "\n" not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") for t in description.get("added_tokens", []))
    return bool(plain and kept and bytes_ and tokens and not description.get("post_processor"))


def _letters_whole(description: dict) -> bool:
    """Whether the pattern is contractions (which begin with an apostrophe), runs of letters, digits, and runs of all else."""
    pre = description["pre_tokenizer"]
    pattern = (pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre)["pattern"]["Regex"].split("|")
    return all(p.startswith("'") or p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") for p in pattern) and r"[\p{L}]+" in pattern


#: Small letters that are normal as they are: ASCII and Latin-1.
_LATIN = re.compile("[a-zß-öø-ÿ]+")


class Encoder:
    """Ids of texts as little-endian 32-bit integers."""

    def __init__(self, file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(file, encoding="utf-8") as f:
            description = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0]
        self.by_chunk = len(mark) == 1 and parts_at_space(description)
        # ASCII chunks of small letters are normal as they are.
        self.plain = Tokenizer.from_file(file)
        self.plain.normalizer = normalizers.Sequence([])
        # Chunks of letters alone are single matches of the pattern, if it has the usual parts.
        self.letters_whole = self.by_chunk and _letters_whole(description)
        self.ascii_words, self.other_words = Tokenizer.from_file(file), Tokenizer.from_file(file)
        for t, steps in ((self.ascii_words, []), (self.other_words, [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])):
            t.normalizer = normalizers.Sequence([])
            t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *steps])
        suffix = description.get("model", {}).get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # Letters may be made small before chunks are looked up if the tokenizer does so anyway.
        self.small = "Lowercase" in json.dumps(description.get("normalizer"))
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.remembered = remembered

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, chunks: list[bytes], tokenizer) -> None:
        """Encodes chunks in few texts, parted by a mark that is one id of its own."""
        groups = [chunks[at : at + 100] for at in range(0, len(chunks), 100)]
        texts = [f" {MARK} ".join(c.decode("utf-8", "surrogatepass") for c in g) for g in groups]
        for group, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(group) - 1:
                raise RuntimeError("chunks of a text could not be told apart")
            self._keep(group, ids.tobytes(), cut, cut + 1)

    def _letters(self, chunks: list[bytes], tokenizer) -> None:
        """Encodes chunks of small letters, each of which is one word for the model: its last id is one that ends words."""
        groups = [chunks[at : at + 200] for at in range(0, len(chunks), 200)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                self._keep(group, ids.tobytes(), cut[:-1], cut[:-1])
            else:
                self._marked(group, self.plain)

    def _keep(self, group: list[bytes], raw: bytes, ends: np.ndarray, starts: np.ndarray) -> None:
        for c, a, b in zip(group, [0, *(4 * starts).tolist()], [*(4 * ends).tolist(), len(raw)], strict=True):
            self.known[c] = raw[a:b]

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Puts the ids of chunks into `known`. A word with one of TAILS after it is the word and that; where the word is new itself, only it is remembered, and the ids of both are returned."""
        known, older = self.known, self.older
        new, joined = [], []
        for c in chunks:
            if (ids := older.get(c)) is not None:
                known[c] = ids
            elif self.small and c[-1:] in TAILS and c[:-1].isalpha():
                joined.append(c)
            else:
                new.append(c)
        seen, rare = set(new), {}
        for c in joined:
            if c[:-1] not in known:
                rare[c] = b""
            for part in (c[:-1], c[-1:]):
                if part not in known and part not in seen:
                    if (ids := older.get(part)) is not None:
                        known[part] = ids
                    else:
                        seen.add(part)
                        new.append(part)
        letters, latin, ascii_, other = [], [], [], []
        for c in new:
            if self.small and c.isascii() and c == c.lower():
                (letters if self.letters_whole and c.isalpha() else ascii_).append(c)
            else:
                (latin if self.letters_whole and _LATIN.fullmatch(c.decode("utf-8", "surrogatepass")) else other).append(c)
        works = (
            (lambda x: self._letters(x, self.ascii_words), letters),
            (lambda x: self._letters(x, self.other_words), latin),
            (lambda x: self._marked(x, self.plain), ascii_),
            (lambda x: self._marked(x, self.tokenizer), other),
        )
        for work, some in works:
            for at in range(0, len(some), 5000):
                work(some[at : at + 5000])
        for c in joined:
            (rare if c in rare else known)[c] = known[c[:-1]] + known[c[-1:]]
        return rare

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at, raws, odd = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_chunk or "<|" in text or MARK in text:
                odd.append(i)
            else:
                raw = text.encode("utf-8", "surrogatepass")
                # A letter with a combining mark may compose only as a capital, or only as a small letter.
                if self.small and b"\xcc" not in raw and b"\xcd" not in raw:
                    raw = raw.lower()
                at.append(i)
                raws.append(raw.replace(b"\n", b" "))
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        for i, ids in zip(at, self._by_chunk(raws) if raws else [], strict=True):
            out[i] = ids
        return out

    def _by_chunk(self, raws: list[bytes]) -> list[bytes]:
        """Texts by their chunks: each different one of them is looked up once."""
        if len(self.known) > self.remembered:
            self.known, self.older = {b"": b""}, self.known
        split = pc.split_pattern(pa.array(raws, pa.large_binary()), " ")
        chunks = split.flatten().dictionary_encode()
        different = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, different))
        gaps = [k for k, x in enumerate(ids) if x is None]
        rare = self._learn([different[k] for k in gaps]) if gaps else {}
        for k in gaps:
            c = different[k]
            ids[k] = rare[c] if (x := self.known.get(c)) is None else x
        # The ids of all chunks one after the other: where each chunk's begin among those of the different ones, and how many they are.
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begin = np.cumsum(size) - size
        which = chunks.indices.to_numpy()
        many = size[which]
        past = np.cumsum(many)
        places = np.repeat(begin[which] - (past - many), many)
        places += np.arange(len(places))
        raw = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        cut = np.concatenate(([0], past))[split.offsets.to_numpy()] << 2
        return [raw[a:b] for a, b in pairwise(cut.tolist())]


@functools.lru_cache(maxsize=1)
def encoder(file: str) -> Encoder:
    """One a worker process, which keeps what it has learnt from task to task. A task has one core: the library's own threads would only wait for each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(file)


# ---- blocks --------------------------------------------------------------------------------------


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each of v needs."""
    return np.frexp(v.astype(float))[1]


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32-bit numbers at `width` bits each, low bits first, as rows of bytes."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(v.astype(f"<u{width // 8}")).view(np.uint8)
    size = 2 if width < 16 else 4
    bits = np.unpackbits(np.ascontiguousarray(v.astype(f"<u{size}")).view(np.uint8).reshape(*v.shape, size), axis=-1, bitorder="little")
    return np.packbits(bits[..., :width].reshape(len(v), -1), axis=-1, bitorder="little")


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}").astype(np.uint32)
    # Eight bytes from the one in which a number begins hold it.
    at = np.arange(n) * width
    padded = np.pad(raw, ((0, 0), (0, 8)))
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded), padded.shape[1] - 7, 8), (*padded.strides, 1))
    found = words[:, at >> 3].reshape(len(raw), -1).view("<u8")
    return (found >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percent: int = PERCENT) -> list[bytes]:
    """Blocks of `block` ids; the last may have fewer."""
    out: list[bytes | None] = [None] * -(-len(ids) // block)
    for first, count, size in ((0, len(ids) // block, block), (len(ids) // block, 1, len(ids) % block)):
        if not count or not size:
            continue
        v = ids[first * block : first * block + count * size].reshape(count, size).astype(np.uint32)
        low = v.min(axis=1)
        v = v - low[:, None]
        need = _bits(v)
        rank = -(-size * percent // 100) - 1
        width = np.partition(need, rank, axis=1)[:, rank]
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            part = v[mine]
            packed = _pack(part & np.uint32((1 << w) - 1), w) if w else np.zeros((len(mine), 0), np.uint8)
            row, place = np.nonzero(need[mine] > w)
            high = (part[row, place] >> np.uint32(w)).astype("<u4") if w < 32 else np.zeros(0, "<u4")
            place = place.astype("<u2")
            edge = np.searchsorted(row, np.arange(len(mine) + 1)).tolist()
            for k, i in enumerate(mine.tolist()):
                a, b = edge[k], edge[k + 1]
                out[first + i] = b"".join([_BLOCK.pack(int(low[i]), w, b - a), packed[k].tobytes(), place[a:b].tobytes(), high[a:b].tobytes()])
    return out


def unpack_blocks(raw: memoryview, starts: list[int], sizes: list[int]) -> np.ndarray:
    """Ids of the blocks that start at these bytes and have these many ids."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    out = np.zeros(int(at[-1]), np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    heads = [_BLOCK.unpack_from(raw, s) for s in starts]
    for i, (h, n) in enumerate(zip(heads, sizes, strict=True)):
        groups.setdefault((h[1], n), []).append(i)
    for (w, n), mine in groups.items():
        many = (n * w + 7) // 8
        low = np.array([heads[i][0] for i in mine], np.uint32)
        if w:
            rows = np.stack([np.frombuffer(raw, np.uint8, many, starts[i] + _BLOCK.size) for i in mine])
            v = _unpack(rows, w, n)
        else:
            v = np.zeros((len(mine), n), np.uint32)
        for k, i in enumerate(mine):
            if odd := heads[i][2]:
                here = starts[i] + _BLOCK.size + many
                place = np.frombuffer(raw, "<u2", odd, here)
                v[k, place] |= np.frombuffer(raw, "<u4", odd, here + 2 * odd) << np.uint32(w)
        v += low[:, None]
        for k, i in enumerate(mine):
            out[at[i] : at[i + 1]] = v[k]
    return out


# ---- segments ------------------------------------------------------------------------------------


def segment_bytes(shard: int, number: int, docs: list[int | None], sizes: list[int], ids: np.ndarray, block: int = BLOCK, percent: int = PERCENT) -> bytes:
    blocks = pack_blocks(ids, block, percent)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<i8")
    head = _HEAD.pack(MAGIC, shard, number, len(docs), len(ids), len(blocks), block, int(starts[-1]))
    tables = [np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), np.array(sizes, "<i8").tobytes()]
    return b"".join([head, *tables, starts.tobytes(), *blocks])


class Segment:
    """Reads a segment that starts at byte `at`; its length is `size`."""

    def __init__(self, raw, at: int = 0):
        self.raw = memoryview(raw)
        magic, self.shard, self.number, n_docs, self.n_ids, n_blocks, self.block, body = _HEAD.unpack_from(self.raw, at)
        if magic != MAGIC:
            raise ValueError("no segment starts here")
        here = at + _HEAD.size
        null = np.frombuffer(self.raw, np.uint8, n_docs, here + 8 * n_docs)
        self.docs = [None if x else d for d, x in zip(np.frombuffer(self.raw, "<i8", n_docs, here).tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(self.raw, "<i8", n_docs, here + 9 * n_docs)
        here += 17 * n_docs
        self.first = here + 8 * (n_blocks + 1)
        self.starts = np.frombuffer(self.raw, "<i8", n_blocks + 1, here)
        self.size = self.first + body - at
        if self.first + body > len(self.raw):
            raise ValueError("a segment is cut off")

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b, from their blocks alone."""
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        one, past = a // self.block, -(-b // self.block)
        sizes = [min(self.block, self.n_ids - i * self.block) for i in range(one, past)]
        got = unpack_blocks(self.raw, (self.starts[one:past] + self.first).tolist(), sizes)
        return got[a - one * self.block : b - one * self.block]


def segments_of(raw):
    at = 0
    while at < len(raw):
        s = Segment(raw, at)
        yield s
        at += s.size + 1
        if bytes(raw[at - 1 : at]) != b"\n":
            raise ValueError("a segment does not end where it should")


# ---- tables to files and back --------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, segment: int = SEGMENT) -> str:
    """Files of docs(doc_id, text) in ascending doc_id order at `path`, which must not exist."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_r"))
    size = docs_bytes(docs)
    files = max(1, -(-size // FILE_BYTES), min(4 * shuffle_partitions(spark), -(-size // (1 << 22))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc_nulls_first(), F.col("_r").asc()]
    ranged = d.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        shard, number = TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        ids, sizes, parts, held = [], [], [], 0

        def cut():
            return segment_bytes(shard, number, ids, sizes, np.frombuffer(b"".join(parts), "<u4"))

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                for doc, one in zip(some.column(0).to_pylist(), encoder(tokenizer).encode(some.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    parts += [one, last]
                    sizes.append(len(one) // 4 + 1)
                    held += sizes[-1]
                    if held >= segment:
                        yield pa.RecordBatch.from_arrays([pa.array([cut()], pa.binary())], names=["segment"])
                        ids, sizes, parts, held, number = [], [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([cut()], pa.binary())], names=["segment"])

    # The cast keeps the bytes as they are, and so does the text sink.
    rows = ranged.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", SEGMENTS).text(path)
    return path


def docs_bytes(docs: DataFrame) -> int:
    return pick(docs, "text").agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def _read(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    """Rows of each(segment), for all segments of all files."""
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                for s in segments_of(raw.as_buffer()):
                    yield pa.RecordBatch.from_pydict(each(s), schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, at, doc_id, ids) of every document; at: ids before it in its segment."""

    def each(s: Segment):
        ids, at = s.ids(), np.concatenate(([0], np.cumsum(s.sizes))).tolist()
        return {"shard": [s.shard] * len(s.docs), "segment": [s.number] * len(s.docs), "at": at[:-1], "doc_id": s.docs, "ids": [ids[a:b] for a, b in zip(at, at[1:], strict=False)]}

    return _read(spark, path, each, "shard long, segment long, at long, doc_id long, ids array<long>")


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""

    def each(s: Segment):
        ids, at = s.ids().astype("<u4"), np.concatenate(([0], np.cumsum(s.sizes))).tolist()
        n = len(s.docs)
        return {"shard": [s.shard] * n, "segment": [s.number] * n, "at": at[:-1], "doc_id": s.docs, "n_tokens": s.sizes.tolist(), "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]}

    rows = stored(_read(spark, path, each, "shard long, segment long, at long, doc_id long, n_tokens long, ids_crc32 long"), "token-rows")
    # A row a segment; sums over the segments of a shard, then over the shards, of which there is one a file.
    held = rows.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    shards, before, total = {}, [], 0
    for r in held.groupBy("shard").agg(F.sum("n").alias("n"), F.max("segment").alias("last")).collect():
        shards[r["shard"]] = r["n"]
    for k in sorted(shards):
        before.append((k, total))
        total += shards[k]
    from pyspark.sql import Window

    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = held.withColumn("sofar", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("n")
    firsts = spark.createDataFrame(before, "shard long, before long")
    starts = segments.join(F.broadcast(firsts), "shard").select("shard", "segment", (F.col("sofar") + F.col("before")).alias("first"))
    joined = rows.join(starts.hint("shuffle_hash"), ["shard", "segment"])
    return joined.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op11_token_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/quire/tokens-{uuid.uuid4().hex}"
    return token_report(spark, write_tokens(table(spark, sf_dir, "documents"), path))

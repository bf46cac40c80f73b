"""Exact substring removal over sorted suffixes (operator 1).

A byte goes if some string of `length` bytes that covers it starts anywhere
else too. All suffixes need not be sorted for that: every window of `length`
bytes elects an anchor in itself (the leftmost least hash of its half-length
grams), equal windows elect the same one, so it is enough to sort the
suffixes that start at anchors, one in about length/4 bytes.

1. Anchors whose gram occurs once are dropped: gram hashes meet by bucket;
   each task sends a hash once, however often it holds it.
2. The suffixes of the others are sorted in each task, front-coded (length of
   the prefix shared with the one before, then the rest) and exchanged by
   the hash of their gram. Loser trees merge the runs; they carry the known
   common prefixes along and never compare those bytes again. The merge
   yields the order of all suffixes and their common prefixes.
3. A window that starts l bytes before its anchor recurs if another anchor
   shares length - l bytes to the right (neighbours in suffix order) and l
   bytes to the left (neighbours in the order of reversed left contexts).
4. A gram that very many places share (hot_at) would be one task's work. The
   windows at its anchors are dealt by their own 128-bit digests instead, each
   batch sends a digest once, and digests that meet recur.

Elsewhere hashes only choose what is compared; the comparison is exact. Equal
texts are one text, and all of a text that occurs twice goes (if long enough).

Defined cases: null is the empty text; texts shorter than `length` lose
nothing and find nothing, longer ones of any length are treated whole; repeated
rows are other places; ties need no order, since bytes go at every place; an
empty table gives an empty table; other columns don't matter (see common.pick).
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from itertools import groupby
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, shuffle_partitions, stored, table
from quire.llm.ngram_join import mix, powers

LENGTH = 200
ENTRY = np.dtype([("hash", "<u8"), ("hi", "<u8"), ("lo", "<u8"), ("pos", "<u4"), ("lmin", "<u2"), ("lmax", "<u2"), ("flag", "u1"), ("n", "<u4")])
SPOT = np.dtype([("pos", "<u4"), ("lmin", "<u2"), ("lmax", "<u2"), ("hash", "<u8")])
WINDOW = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("hi", "<u8"), ("lo", "<u8"), ("pos", "<u4"), ("flag", "u1")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
ALONE, KNOWN, DIRECT = 0, 1, 2
#: Entries whose windows are looked at together.
STRETCH = 20_000
#: Windows of hot grams that a task holds before it sends them.
HELD_WINDOWS = 200_000
#: A gram is hot from so many places on, or from one in this many of all anchors: so there are at most HOT_SHARE hot ones.
HOT_AT, HOT_SHARE = 20_000, 4_000_000


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, least and greatest distance of window starts before it) of a text's anchors."""
    n, k = len(raw), length // 2
    if n < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    gram = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    pos = chosen[first]
    return gram[pos], pos, pos - last, pos - first


def _by_bucket(entries: np.ndarray, bucket: np.ndarray):
    if not len(entries):
        return
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), entries[a:b]


def _found(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, data): ENTRY arrays of the anchors of (key, text)."""

    def run(batches):
        for b in batches:
            parts, seen = [], set()
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if key in seen or not raw:
                    continue
                seen.add(key)
                h, pos, lmin, lmax = anchors(raw, length)
                e = np.zeros(len(h), ENTRY)
                e["hash"], e["pos"], e["lmin"], e["lmax"] = h, pos, lmin, lmax
                e["hi"], e["lo"] = np.frombuffer(key, "<u8")
                parts.append(e)
            e = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
            e = e[np.argsort(e["hash"], kind="stable")]
            new = np.concatenate(([True], e["hash"][1:] != e["hash"][:-1])) if len(e) else np.zeros(0, bool)
            size = np.diff(np.concatenate((np.flatnonzero(new), [len(e)]))) if len(e) else np.zeros(0, int)
            many = np.repeat(size > 1, size)
            # Hashes that recur within this batch are known already: one entry tells the others, the rest passes by.
            sent, passed = e[new].copy(), e[many].copy()
            sent["flag"], passed["flag"], sent["n"] = np.where(size > 1, KNOWN, ALONE), DIRECT, size
            out_b, out_d = [], []
            for part, by in ((sent, "hash"), (passed, "lo")):
                for bucket, x in _by_bucket(part, part[by] % np.uint64(buckets)):
                    out_b.append(bucket)
                    out_d.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_d, pa.binary())], names=["bucket", "data"])

    return texts.mapInArrow(run, "bucket int, data binary")


def _groups(batches):
    """Rows of sorted batches by their first column, across batch borders."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    return groupby(rows(), key=itemgetter(0))


def _recurring(found: DataFrame, parts: int, hot_at: int) -> DataFrame:
    """(key, spots): anchors of a text whose gram occurs anywhere else; under a null key the hashes of grams with hot_at places or more."""

    def run(batches):
        for _, rows in _groups(batches):
            e = np.frombuffer(b"".join([r[1] for r in rows]), ENTRY)
            direct, e, hot = e[e["flag"] == DIRECT], e[e["flag"] != DIRECT], np.zeros(0, np.uint64)
            e = e[np.lexsort((e["flag"] != KNOWN, e["pos"], e["lo"], e["hi"], e["hash"]))]
            if len(e):  # copies of a text are one place
                same = np.ones(len(e), bool)
                for f in ("hash", "hi", "lo", "pos"):
                    same[1:] &= e[f][1:] == e[f][:-1]
                same[0] = False
                e = e[~same]
                group = np.cumsum(np.concatenate(([False], e["hash"][1:] != e["hash"][:-1])))
                hot = e["hash"][np.searchsorted(group, np.flatnonzero(np.bincount(group, e["n"]) >= hot_at))]
                often = (np.bincount(group) > 1) | (np.bincount(group, e["flag"] == KNOWN) > 0)
                e = e[often[group] & (e["flag"] != KNOWN)]
            e = np.concatenate((direct, e))
            e = e[np.lexsort((e["lo"], e["hi"]))]
            keys, data = ([None], [hot.tobytes()]) if len(hot) else ([], [])
            if len(e):
                cut = np.flatnonzero(np.concatenate(([True], (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1]))))
                spots = np.zeros(len(e), SPOT)
                for f in SPOT.names:
                    spots[f] = e[f]
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(e)], strict=True):
                    keys.append(e["hi"][a].tobytes() + e["lo"][a].tobytes())
                    data.append(spots[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["key", "spots"])

    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key binary, spots binary")


# ---- front-coded runs and their merge -------------------------------------------------------


def common_prefixes(strings: list[bytes]) -> list[int]:
    """Of each string, the bytes that it shares with the one before; 0 first."""
    if len(strings) < 2:
        return [0] * len(strings)
    most = max(map(len, strings)) or 1
    size = np.array([len(s) for s in strings])
    grid = np.frombuffer(b"".join(s.ljust(most, b"\0") for s in strings), np.uint8).reshape(len(strings), most)
    differs = grid[1:] != grid[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), most)
    return [0, *np.minimum(lcp, np.minimum(size[1:], size[:-1])).tolist()]


def front_code(run: list[tuple]) -> bytes:
    """A sorted run of (suffix, rest of the entry): shared lengths, remainders, entries."""
    suffixes = [r[0] for r in run]
    lcp = common_prefixes(suffixes)
    return pickle.dumps((lcp, [s[h:] for s, h in zip(suffixes, lcp, strict=True)], [r[1] for r in run]), protocol=5)


def decoded(blob: bytes):
    """(suffix, shared length with the one before, entry) of a front-coded run, in order."""
    before = b""
    for h, rest, entry in zip(*pickle.loads(blob), strict=True):  # noqa: S301  written by front_code in this job
        before = before[:h] + rest
        yield before, h, entry


def first_difference(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


def merge_runs(runs: list):
    """(suffix, shared length with the one before, entry) over all runs, in order: a loser tree.

    Every string at a node comes with its common prefix with the last winner
    that passed there. Of two of them the one with the longer prefix is less,
    without a look at the bytes; only equal lengths are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    current: list = [next(s, None) for s in streams]
    shared = [0] * k
    loser = [0] * k  # loser[1:] are the nodes; leaf i stands at k + i

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of streams a and b; the loser learns what it shares with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[0], y[0]
        h = first_difference(s, t, p)
        if h == len(s) or h < len(t) and s[h] < t[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1)
    while (top := current[win]) is not None:
        yield top[0], shared[win], top[2]
        current[win] = nxt = next(streams[win], None)
        shared[win] = nxt[1] if nxt else 0
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


# ---- windows --------------------------------------------------------------------------------


def covered(suffixes: list[bytes], lcp: list[int], lefts: list[bytes], lmin: np.ndarray, lmax: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries in suffix order: the least and greatest l whose window recurs (least > greatest: none).

    many: this very entry stands for several places.
    """
    n = len(suffixes)
    least, most = np.full(n, length), np.full(n, -1)
    least[many], most[many] = lmin[many], lmax[many]
    right = np.array(lcp)
    reverse = [x[::-1] for x in lefts]
    order = sorted(range(n), key=reverse.__getitem__)
    left = np.array(common_prefixes([reverse[i] for i in order]))
    order = np.array(order)
    for step in range(int(lmin.min(initial=0)), int(lmax.max(initial=-1)) + 1):
        on = np.flatnonzero((lmin <= step) & (step <= lmax))
        if not len(on):
            continue
        rank = np.cumsum(right < length - step)
        side = np.empty(n, np.int64)
        side[order] = np.cumsum(left < step)
        _, group = np.unique(rank[on] * np.int64(n + 1) + side[on], return_inverse=True)
        again = (np.bincount(group) > 1) | (np.bincount(group, many[on]) > 0)
        hit = on[again[group]]
        least[hit] = np.minimum(least[hit], step)
        most[hit] = np.maximum(most[hit], step)
    return least, most


def _windows_at(key: bytes, raw: bytes, spots: np.ndarray, length: int) -> np.ndarray:
    """WINDOW rows of all windows of a text's spots."""
    start = np.unique(np.concatenate([np.arange(a - hi, a - lo + 1) for a, lo, hi, _ in spots.tolist()]))
    out = np.zeros(len(start), WINDOW)
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in start.tolist()), "<u8")
    out["d1"], out["d2"], out["pos"] = digests[::2], digests[1::2], start
    out["hi"], out["lo"] = np.frombuffer(key, "<u8")
    return out


def _spans_by_key(windows: np.ndarray, length: int) -> dict[bytes, bytes]:
    """key → SPAN array of windows."""
    if not len(windows):
        return {}
    windows = windows[np.lexsort((windows["lo"], windows["hi"]))]
    spans = np.zeros(len(windows), SPAN)
    spans["start"], spans["end"] = windows["pos"], windows["pos"] + length
    keys = np.stack((windows["hi"], windows["lo"]), 1)
    cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    return {keys[a].tobytes(): spans[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True)}


def _same_digest(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows sorted by digest, number of the digest of each)."""
    windows = windows[np.lexsort((windows["d2"], windows["d1"]))]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["d1"][1:] != windows["d1"][:-1]) | (windows["d2"][1:] != windows["d2"][:-1])
    return windows, np.cumsum(new) - 1


def _sent_windows(windows: np.ndarray, length: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows of _runs for windows of hot grams: each digest once (kind 2), and the spans of those that recur among these (kind 1)."""
    windows, group = _same_digest(windows)
    size = np.bincount(group)
    again = size[group] > 1
    first = windows[np.searchsorted(group, np.arange(len(size)))]
    first["flag"] = np.where(size > 1, KNOWN, ALONE)
    known: dict[int, dict[bytes, bytes]] = {}
    for key, spans in _spans_by_key(windows[again], length).items():
        known.setdefault(zlib.crc32(key) % buckets, {})[key] = spans
    return [(i, 2, x.tobytes()) for i, x in _by_bucket(first, first["d1"] % np.uint64(buckets))] + [(i, 1, pickle.dumps(d, protocol=5)) for i, d in known.items()]


def _runs(texts: DataFrame, length: int, buckets: int, hot) -> DataFrame:
    """(bucket, kind, data): front-coded runs (kind 0) of (key, text, spots), spans that are known at once (kind 1), windows of hot grams (kind 2); hot: broadcast hashes of these."""
    half = length // 2

    def run(batches):
        for b in batches:
            held: dict[tuple, list] = {}
            windows, waiting, early = [], 0, []
            for key, raw, spots in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                spots = np.unique(np.frombuffer(b"".join(spots), SPOT))
                if len(hot.value) and (often := np.isin(spots["hash"], hot.value)).any():
                    windows.append(_windows_at(key, raw, spots[often], length))
                    waiting += len(windows[-1])
                    spots = spots[~often]
                    if waiting > HELD_WINDOWS:
                        early += _sent_windows(np.concatenate(windows), length, buckets)
                        windows, waiting = [], 0
                for a, lo, hi, _ in spots.tolist():
                    held.setdefault((raw[a : a + length - lo], raw[a - hi : a], lo, hi), []).append((key, a))
            if windows:
                early += _sent_windows(np.concatenate(windows), length, buckets)
            runs: dict[int, list] = {}
            known: dict[int, dict[bytes, list]] = {}
            for (suffix, left, lo, hi), places in held.items():
                bucket = zlib.crc32(suffix[:half]) % buckets
                runs.setdefault(bucket, []).append((suffix, (left, lo, hi, None if len(places) > 1 else places[0])))
                if len(places) > 1:
                    for key, a in places:
                        known.setdefault(zlib.crc32(key) % buckets, {}).setdefault(key, []).append((a - hi, a - lo + length))
            held = {}
            out = early + [(i, 0, front_code(sorted(r, key=itemgetter(0)))) for i, r in runs.items()]
            out += [(i, 1, pickle.dumps({k: np.array(v, SPAN).tobytes() for k, v in d.items()}, protocol=5)) for i, d in known.items()]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int8(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

    return texts.select("key", "text", "spots").mapInArrow(run, "bucket int, kind tinyint, data binary")


def _spans(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """(key, spans): SPAN arrays of the bytes to remove."""
    half = length // 2

    def merged(blobs: list[bytes]):
        """Entries in suffix order, equal ones joined: [suffix, shared, left, lmin, lmax, places, stands for several].

        They come in stretches of whole blocks of one gram, some thousand
        entries at a time; entries alone in their block find nothing.
        """
        ready: list[list] = []
        block: dict[tuple, list] = {}
        for suffix, h, (left, lo, hi, place) in merge_runs([decoded(x) for x in blobs]):
            if h < half and block:
                if len(block) > 1 or next(iter(block.values()))[6]:
                    ready += block.values()
                block = {}
                if len(ready) > STRETCH:
                    yield ready
                    ready = []
            e = block.get((suffix, left, lo, hi))
            if e is None:  # a joined entry shares its whole suffix with those before it, so no shorter prefix is lost
                block[(suffix, left, lo, hi)] = [suffix, h if block else 0, left, lo, hi, [] if place is None else [place], place is None]
            else:
                e[6] = True
                if place is not None:
                    e[5].append(place)
        if len(block) > 1 or block and next(iter(block.values()))[6]:
            ready += block.values()
        if ready:
            yield ready

    def run(batches):
        for _, rows in _groups(batches):
            rows = list(rows)
            out: dict[bytes, list] = {}
            for r in rows:
                if r[1] == 1:
                    for key, spans in pickle.loads(r[2]).items():  # noqa: S301  written by _runs in this job
                        out.setdefault(key, []).append(spans)
            if windows := [np.frombuffer(r[2], WINDOW) for r in rows if r[1] == 2]:
                w, group = _same_digest(np.concatenate(windows))
                again = (np.bincount(group) > 1)[group] & (w["flag"] == ALONE)  # of the others the places are known already
                for key, spans in _spans_by_key(w[again], length).items():
                    out.setdefault(key, []).append(spans)
            for stretch in merged([r[2] for r in rows if r[1] == 0]):
                suffixes, lcp, lefts, lmin, lmax, places, many = zip(*stretch, strict=True)
                low, high = covered(suffixes, lcp, lefts, np.array(lmin), np.array(lmax), np.array(many), length)
                for own, lo, hi in zip(places, low.tolist(), high.tolist(), strict=True):
                    if lo <= hi:
                        for key, a in own:
                            out.setdefault(key, []).append(pack("<II", a - hi, a - lo + length))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array([b"".join(v) for v in out.values()], pa.binary())], names=["key", "spans"])

    return runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key binary, spans binary")


def union_of(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = True, hot_at: int = HOT_AT) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null unless with_kept)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = 4 * parts
    d = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    hot_at = max(hot_at, 4 * n_bytes // (length * HOT_SHARE))  # four anchors in `length` bytes
    spots = _recurring(_found(d.select("key", "text"), length, buckets), parts, hot_at)
    spots = stored(spots.groupBy("key").agg(F.collect_list("spots").alias("spots")), "spots")
    found = spots.where("key is null").first()
    hot = spark.sparkContext.broadcast(np.frombuffer(b"".join(found[1]) if found else b"", np.uint64))  # at most HOT_SHARE hashes
    texts = d.select("key", "text").dropDuplicates(["key"])
    runs = _runs(texts.join(spots.hint("shuffle_hash"), "key"), length, buckets, hot)
    spans = stored(_spans(runs, length, parts).groupBy("key").agg(F.collect_list("spans").alias("spans")), "spans")
    copies = d.groupBy("key").agg(F.count("*").alias("n"))

    def cut(batches):
        for b in batches:
            rows = []
            for raw, spans_, n in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone = [(0, len(raw))] if n > 1 and len(raw) >= length else union_of(np.frombuffer(b"".join(spans_ or []), SPAN))
                at, kept = 0, []
                for x, y in gone:
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = texts.join(spans.hint("shuffle_hash"), "key", "left").join(copies.hint("shuffle_hash"), "key")
    done = whole.select("key", "text", "spans", "n").mapInArrow(cut, f"key binary, {RESULT}")
    return d.select("doc_id", "key").join(done.hint("merge"), "key").drop("key")


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")

"""Near-duplicate line removal by a segment-partition edit join (operator 10), in DataFrame functions only.

A line is removed if an earlier line (by doc_id, then line number) equals it
or, both having 2 * (tau + 1) characters or more, is within `tau` edits of it.
Each such line is split into tau + 1 segments; of two lines within tau edits,
one holds a segment of the other at one of few places that the lengths allow,
and so do the rests of both, so lines meet in a shuffled join on the hashes of
two segments. A key that more than HOT lines share (lines of one template
with some varying part) is split: what is left of two lines without the shared
segments is within tau edits too and shares a segment in turn, and so on until
few lines share a key or nothing is left to cut. Candidates are verified by
edit distance in a band of 2 * tau + 1 diagonals, one bit each. Equal lines are
one line in the join.

Lines are those of split at ``\\n``. Lines of white space alone set texts out:
they take no part and stay.

Defined cases: null text has no lines and stays null; an empty text stays
empty; rows that repeat a doc_id share their order: the lines of either are
before those with a greater number of the other, equal rows stay equal and
don't remove each other; a null doc_id comes before all others; lines and
texts may be of any length. An empty table gives an empty table. Other
columns stay as they are, also ones whose names clash (see common.pick).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, pick, place_of, stored, table

TAU = 1
MAX_BROADCAST_IDS = 1_000_000
#: Lines of a key beyond which it is split.
HOT = 128


def segment_bounds(n: Column, tau: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the tau + 1 even segments of n characters; the longer ones come last."""
    short = F.floor(n / (tau + 1)).cast("int")
    long_ones = n - short * (tau + 1)
    out, start = [], F.lit(1)
    for i in range(tau + 1):
        size = short + F.when(long_ones >= tau + 1 - i, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def _parts(line: Column, n: Column, tau: int, less: int, own: bool):
    """(segment number, place, segment, rest of the line) of each way in which a line of n characters,
    `less` fewer than this one's, can share a segment with it; own: only at the line's own places.

    Segment i may have moved by at most i places from the left end and by
    tau - i from the right end; both bounds together leave few places.
    """
    for i, (a, size) in enumerate(segment_bounds(n, tau)):
        for move in [0] if own else range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
            at = a + move
            rest = F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + size, F.length(line)))
            yield i, move, size, F.substring(line, at, size), rest


def _cuts(line: Column, n: Column, tau: int, less: int, own: bool) -> list[tuple[bool, Column, Column, Column]]:
    """(moved, key, what is left, its length in the shorter line): segments of the line, each with a segment of the rest.

    What is left of two lines without a shared segment is within tau edits
    too, so it shares a segment in turn. Keys of both segments keep lines
    apart that only have a long passage in common.
    """
    out = []
    for i, move, size, part, rest in _parts(line, n, tau, less, own):
        for j, move2, size2, part2, left in _parts(rest, n - size, tau, less, own):
            out.append((bool(move or move2), F.xxhash64(F.lit(i), F.lit(j), n.cast("int"), part, part2), left, n - size - size2))
    return out


def all_cuts(line: Column, n: Column, tau: int) -> list[tuple[bool, int, Column, Column, Column]]:
    """(own, characters more than the other line, key, what is left, its length in the other): first the index keys (own), which also probe, then keys that only probe lines of n, n-1 … n-tau characters."""
    own = [(True, 0, *c[1:]) for c in _cuts(line, n, tau, 0, True)]
    return own + [(False, less, *c[1:]) for less in range(tau + 1) for c in _cuts(line, n - less, tau, less, False) if less or c[0]]


STATE = ["k", "s", "own", "less", "rest", "m"]


def _split(rows: DataFrame, tau: int) -> DataFrame:
    """Rows of STATE under the keys of one more segment each."""
    made = []
    rest, m = F.col("rest"), F.col("m")
    for less in range(tau + 1):
        for i, move, size, part, left in _parts(rest, m, tau, less, False):
            # An own row stays one where nothing moves; where it does, it only probes.
            here = F.struct(F.xxhash64("k", F.lit(i), m, part).alias("k"), (F.col("own") & F.lit(not move)).alias("own"), left.alias("rest"), (m - size).cast("int").alias("m"))
            made.append(F.when(F.col("less") == less, here))
    cut = F.filter(F.array(*made), lambda x: x.isNotNull())
    return rows.select("s", "less", F.explode(cut).alias("c")).select("c.k", "s", "c.own", "less", "c.rest", "c.m")


def _hot_pairs(lines: DataFrame, hot: DataFrame, rows: DataFrame, tau: int, limit: int, spread, max_broadcast_ids: int) -> DataFrame:
    """(x, y) candidates among the lines of the keys of hot(k); rows(k, s): all keys of all lines."""
    asked = stored(spread(rows, hot, "left_semi").select("s").distinct(), "line-hot-ids")
    some = F.broadcast(asked) if asked.count() <= max_broadcast_ids else asked.hint("shuffle_hash")
    text = lines.select(F.xxhash64("id").alias("s"), "line").join(some, "s", "left_semi").dropDuplicates(["s"])
    n = F.length("line")
    states = [F.struct(k.alias("k"), F.lit(own).alias("own"), F.lit(less).alias("less"), left.alias("rest"), m.cast("int").alias("m")) for own, less, k, left, m in all_cuts(F.col("line"), n, tau)]
    open_ = text.select("s", F.explode(F.array(*states)).alias("c")).select("c.k", "s", "c.own", "c.less", "c.rest", "c.m")
    open_ = spread(open_, hot, "left_semi").select(*STATE)
    done = None
    while True:
        cut = stored(_split(open_, tau), "line-hot-keys")
        large = stored(cut.groupBy("k").agg(F.count("*").alias("c"), F.max("m").alias("m")).where((F.col("c") > limit) & (F.col("m") > tau)).select("k"), "line-hot")
        none = large.isEmpty()
        few = (cut if none else spread(cut, large, "left_anti")).select("k", "s", "own")
        done = few if done is None else done.unionByName(few)
        if none:
            break
        open_ = spread(cut, large, "left_semi").select(*STATE)
    index = done.where("own").select("k", F.col("s").alias("x"))
    return index.hint("merge").join(done.select("k", F.col("s").alias("y")), "k").select("x", "y")


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two arrays of characters if it is at most tau, else more than tau.

    Bit k of a word stands for diagonal k - tau; column j of the matrix holds
    rows j - tau … j + tau. Needs more than tau characters in a, and lengths
    that differ by at most tau.
    """
    width, full = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    n, m = F.size(a), F.size(b)
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    inv = lambda v: v.bitwiseXOR(F.lit(full))

    def step(acc, j):
        char = F.get(b, j - 1)
        match = F.lit(0)
        for k in range(width):  # row j - tau + k, from 1
            match = match + F.when((j + (k - tau) >= 1) & (F.get(a, j + (k - tau - 1)) == char), F.lit(1 << k)).otherwise(F.lit(0))
        return F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), match.alias("x"), j.alias("j"))

    def zero(acc):
        sums = acc["x"].bitwiseAND(acc["vp"]) + acc["vp"]
        d0 = sums.bitwiseXOR(acc["vp"]).bitwiseOR(acc["x"]).bitwiseOR(acc["vn"]).bitwiseAND(F.lit(full))
        return F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), acc["j"].alias("j"), d0.alias("d0"))

    def across(acc):
        hp = acc["vn"].bitwiseOR(inv(acc["d0"].bitwiseOR(acc["vp"])))
        hn = acc["d0"].bitwiseAND(acc["vp"])
        return F.struct(acc["d"].alias("d"), acc["j"].alias("j"), acc["d0"].alias("d0"), hp.alias("hp"), hn.alias("hn"))

    def down(acc):
        low = F.shiftright(acc["d0"], 1)
        k = n - acc["j"] + tau  # of the last row, once the band reaches it
        diagonal = 1 - bit(acc["d0"], 2 * tau)
        at = lambda v: sum((F.when(k == i, bit(v, i)).otherwise(0) for i in range(width)), F.lit(0))
        level = at(acc["hp"]) - at(acc["hn"])
        d = acc["d"] + F.when(acc["j"] <= n - tau, diagonal).otherwise(level).cast("int")
        return F.struct(
            acc["hn"].bitwiseOR(inv(low.bitwiseOR(acc["hp"]))).alias("vp"),
            low.bitwiseAND(acc["hp"]).alias("vn"),
            d.alias("d"),
        )

    def let(value: Column, body):
        """body(value), value worked out once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    start = F.struct(F.lit(full - ((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), m), start, lambda acc, j: let(let(let(step(acc, j), zero), across), down))["d"]


def _ord(doc_id: Column, pos: Column) -> Column:
    """A number that orders all lines; null doc_ids first."""
    place = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    return (place * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(31,0)")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, pos, line, id): the lines that take part; of: fingerprint of the whole text."""
    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.unhex(F.md5("line")))


def near_lines(lines: DataFrame, tau: int, max_broadcast_ids: int = MAX_BROADCAST_IDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Lines of _lines() → (id, low): the first place of each line that recurs; (id, low): the first place of a near line, where one is earlier."""
    line, n = F.col("line"), F.length("line")
    ord_ = _ord(F.col("doc_id"), F.col("pos"))
    keys = [k for _, _, k, _, _ in all_cuts(line, n, tau)]
    # Keys of short lines are worked out too and left aside: in a condition, the segments that keys share would be cut anew for each.
    slim = lines.select("id", ord_.alias("ord"), n.alias("chars"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    # Numbers only: the partial aggregate keeps one row a line and task before the exchange.
    once = slim.groupBy("id").agg(F.min("ord").alias("low"), F.count("*").alias("n"), F.min("chars").alias("chars"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    once = stored(once, "lines")
    short = F.xxhash64("id")
    near = once.where(F.col("chars") >= 2 * (tau + 1))
    index = near.select(F.explode(F.array(*[F.col(f"k{i}") for i in range((tau + 1) ** 2)])).alias("k"), short.alias("x"))
    probe = near.select(F.explode(F.array(*[F.col(f"k{i}") for i in range(len(keys))])).alias("k"), short.alias("y"))
    large = stored(probe.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("k"), "line-hot")
    n_large = large.count()

    def spread(df, few, how):
        # 8 bytes a key; more of them meet the rows in a shuffle.
        return df.join(F.broadcast(few) if n_large <= max_broadcast_ids else few.hint("shuffle_hash"), "k", how)

    if n_large:
        index, rows = spread(index, large, "left_anti"), probe
        probe = spread(probe, large, "left_anti")
    pairs = index.hint("merge").join(probe, "k").select("x", "y")
    if n_large:
        pairs = pairs.unionByName(_hot_pairs(lines, large, rows.withColumnRenamed("y", "s"), tau, hot, spread, max_broadcast_ids))
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = stored(pairs, "line-pairs")
    asked = stored(pairs.select(F.explode(F.array("x", "y")).alias("s")).distinct(), "line-ids")
    small = asked.count() <= max_broadcast_ids  # 8 bytes each; beyond, the same join with a shuffle
    texts = lines.select("id", "line", ord_.alias("ord"), short.alias("s")).join(F.broadcast(asked) if small else asked.hint("shuffle_hash"), "s", "left_semi")
    texts = stored(texts.groupBy("s", "id", "line").agg(F.min("ord").alias("low")).withColumn("chars", F.split("line", "")).drop("line"), "line-texts")
    side = lambda c: texts.select(F.col("s").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("id", "low", "chars")])
    both = pairs.join(side("x").hint("shuffle_hash"), "x").join(side("y").hint("shuffle_hash"), "y")
    both = both.where(F.abs(F.size("x_chars") - F.size("y_chars")) <= tau)
    close = both.where(banded_distance(F.col("x_chars"), F.col("y_chars"), tau) <= tau)
    later = F.when(F.col("x_low") > F.col("y_low"), F.struct(F.col("x_id").alias("id"), F.col("y_low").alias("low"))).when(
        F.col("x_low") < F.col("y_low"), F.struct(F.col("y_id").alias("id"), F.col("x_low").alias("low"))
    )
    near = close.select(later.alias("s")).where("s is not null").select("s.*").groupBy("id").agg(F.min("low").alias("low"))
    return once.where("n > 1").select("id", "low"), near


def removed_lines(docs: DataFrame, tau: int = TAU, max_broadcast_ids: int = MAX_BROADCAST_IDS, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) → (doc_id, of, gone): numbers, from 0, of the lines to remove from the rows whose text has the fingerprint `of`; rows without such lines are left out."""
    lines = _lines(pick(docs, "doc_id", "text"))
    same, near = near_lines(lines, tau, max_broadcast_ids, hot)
    # Written out, so that both sides of the join come straight from a shuffle and AQE can split a very common line.
    first = stored(same.unionByName(near).groupBy("id").agg(F.min("low").alias("low")), "line-firsts")
    hit = lines.select("doc_id", "of", "pos", "id").hint("merge").join(first, "id").where(_ord(F.col("doc_id"), F.col("pos")) > F.col("low"))
    return hit.groupBy("doc_id", "of").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs, all columns, with `text` without its removed lines, and one more at the end: how many they are."""
    names = docs.columns
    at, text = (F.col(f"_c{place_of(names, k)}") for k in ("doc_id", "text"))
    d = numbered(docs)
    gone = removed_lines(docs, tau).select(F.col("doc_id").alias("_doc"), "of", "gone")
    both = d.join(gone.hint("shuffle_hash"), at.eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("of")), "left")
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    new = F.when(F.col("gone").isNull() | text.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    own = [new if i == place_of(names, "text") else F.col(f"_c{i}") for i in range(len(names))]
    # Not size() of a missing set: that is -1 or null by configuration.
    return both.select(*[c.alias(f"_c{i}") for i, c in enumerate(own)], F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("_n")).toDF(*names, "n_gone")


def clean_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs, all columns, with `text` without its removed lines and `n_chars`, if there is one, to match; documents that lost lines and have no word left go."""
    names = docs.columns
    text, chars = place_of(names, "text"), place_of(names, "n_chars", None)
    d = numbered(drop_lines(docs, tau))
    d = d.where((F.col(f"_c{len(names)}") == 0) | F.col(f"_c{text}").rlike(r"[^\x20\x09-\x0D]")).drop(f"_c{len(names)}")
    if chars is not None:
        d = d.withColumn(f"_c{chars}", F.length(f"_c{text}").cast(d.schema[chars].dataType))
    return d.toDF(*names)


def op10_line_dedup(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    out = drop_lines(docs)
    return out.select(
        "doc_id",
        "n_lines",
        F.col("n_gone").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


# Of two lines within one edit, the shorter with m characters, the first or the last m / 2 characters are equal;
# with the place of the edit left out, both are equal (levenshtein would count bytes).
OP10_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents where text is not null),
d as (select line, length(line) as n, min(doc_id * 1000000 + pos) as low from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by line),
m as (select line, n, low, unnest([n, n - 1]) as m from d where n >= 4),
h as (select line, n, low, m, 'l' || left(line, m // 2) as part from m union all select line, n, low, m, 'r' || right(line, m // 2) from m),
p as (select distinct a.line as x, b.line as y, b.low as yl, greatest(a.n, b.n) as n from h a join h b on a.part = b.part and a.m = b.m and a.m = least(a.n, b.n) where a.low > b.low and abs(a.n - b.n) <= 1),
near as (select x as line, min(yl) as low from p where list_bool_or(list_transform(range(0, n), lambda i: left(x, i) = left(y, i) and right(x, n - 1 - i) = right(y, n - 1 - i))) group by x),
f as (select line, min(low) as low from (select line, low from d union all select * from near) group by line),
k as (select doc_id, pos, l.line, f.low is not null and doc_id * 1000000 + pos > f.low as gone from l left join f on l.line = f.line),
t as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept from k group by doc_id)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_removed as bigint) as n_removed, cast(length(kept) as bigint) as n_chars, sha256(kept) as kept_sha256 from t
union all select doc_id, 0, 0, null, sha256('') from documents where text is null
"""

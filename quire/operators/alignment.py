"""Paragraphs of a document found again among the blocks of another rendering.

A paragraph is sought by its text without white space, and where no block has
that text, by its first KEY UTF-16 units anywhere in a block. Of several
blocks the one whose neighbours are the paragraph's own wins, then the one
whose number among them is nearest to the paragraph's, then the first.

Nothing pairs all paragraphs with all blocks that share a text: digests of
texts meet by value, and of keys those that a block holds. Windows over both
sides, in the order of occurrences, give the nearest block below and above.
One exchange by document and key serves all four windows (both neighbours,
either one, none); texts don't take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import compact_text, utf16_length
from quire.sources.tables import stored

#: Units of a key, and the least that a key must have.
KEY, LEAST = 18, 3
#: Up to so many keys of a document and length each is sought in each block; of more, all parts of a block meet them by value.
FEW = 64


def block_key(norm: Column) -> Column:
    """The first characters of norm that have KEY UTF-16 units at most."""
    head = F.substring(norm, 1, KEY)
    cut = F.aggregate(F.split(head, ""), F.lit(""), lambda acc, c: F.when(utf16_length(F.concat(acc, c)) <= KEY, F.concat(acc, c)).otherwise(acc))
    return F.when(utf16_length(head) <= KEY, head).otherwise(cut)


def _digest(norm: Column) -> Column:
    """128 bits for a text, nothing for an empty one."""
    return F.when(norm != "", F.md5(norm)).otherwise("")


def _near(targets: DataFrame, candidates: DataFrame, carried: list[str] = []) -> DataFrame:
    """targets(doc_id, k, para_index, prev, next, occurrence, carried…) without k and with block_index: the best of candidates(doc_id, k, block_index, prev, next)."""
    number = F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("block_index")) - 1
    side = lambda df, order, index, block: df.select("doc_id", "k", "prev", "next", order.cast("long").alias("o"), index.alias("para_index"), block.alias("here"), *[(F.col(c) if c in df.columns else F.lit(None).cast(targets.schema[c].dataType)).alias(c) for c in carried])
    c = candidates.repartition("doc_id", "k").select("*", number.alias("o"))
    none = F.lit(None)
    here = F.struct(F.col("o").cast("long").alias("o"), F.col("block_index").cast("long").alias("b"))
    both = side(targets, F.col("occurrence"), F.col("para_index").cast("long"), none.cast("struct<o:bigint,b:bigint>")).unionByName(side(c, F.col("o"), none.cast("long"), here)).repartition("doc_id", "k")

    def nearest(*by: str) -> Column:
        low = F.last("here", ignorenulls=True).over(Window.partitionBy("doc_id", "k", *by).orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        # Blocks of the same place are in low, whatever the order of equals; a frame up to the end would be gone through for each row.
        high = F.expr(f"lead(here) ignore nulls over (partition by {', '.join(('doc_id', 'k', *by))} order by o)")
        far = lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["o"] - F.col("o")).alias("d"), x["b"].alias("b")))
        real = F.lit(True)
        for c in by:
            real = real & (F.col(c) != "")
        return F.when(real, F.least(far(low), far(high)))

    found = both.select("*", nearest("prev", "next").alias("n4"), nearest("prev").alias("p2"), nearest("next").alias("q2"), nearest().alias("n0")).where("para_index is not null")
    return found.select("doc_id", "para_index", F.coalesce(F.col("n4.b"), F.least("p2", "q2")["b"], F.col("n0.b")).alias("block_index"), "prev", "next", F.col("o").alias("occurrence"), *carried)


def find_blocks(targets: DataFrame, blocks: DataFrame, keep=stored) -> DataFrame:
    """targets(doc_id, para_index, text, prev_text, next_text, occurrence), blocks(doc_id, block_index, text) → (doc_id, para_index, block_index, step).

    One row for each target; step: `exact`, `part`, or null where block_index
    is -1. Null texts are empty; texts with keys of fewer than LEAST units are
    not sought; a null occurrence is 0. keep(rows, name) writes rows that are
    read more than once, and reads them back.
    """
    norm = lambda c: compact_text(F.coalesce(F.col(c), F.lit("")))
    sides, place = ["prev", "next"], ["doc_id", "para_index"]
    t = targets.select(*place, norm("text").alias("norm"), _digest(norm("prev_text")).alias("prev"), _digest(norm("next_text")).alias("next"), F.coalesce("occurrence", F.lit(0)).alias("occurrence"))
    t = t.select(*place, _digest(F.col("norm")).alias("k"), *sides, "occurrence", block_key(F.col("norm")).alias("key"))
    w = Window.partitionBy("doc_id").orderBy("block_index")
    b = blocks.select("doc_id", "block_index", norm("text").alias("norm")).withColumn("k", _digest(F.col("norm")))
    b = b.withColumn("_said", F.nullif("k", F.lit("")))
    ahead = F.expr("lead(_said) ignore nulls over (partition by doc_id order by block_index)")
    b = b.select("doc_id", "block_index", "norm", "k", F.coalesce(F.last("_said", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")).alias("prev"), F.coalesce(ahead, F.lit("")).alias("next"))
    b = keep(b, "blocks")

    # Texts that are not sought go along under no key, which no block has.
    sought = utf16_length(F.col("key")) >= LEAST
    t = t.withColumn("sought", sought).withColumn("k", F.when(F.col("sought"), F.col("k")).otherwise(""))
    found = keep(_near(t, b.where("k <> ''").select("doc_id", "k", "block_index", *sides), ["key", "sought"]), "found-blocks")
    rest = found.where("block_index is null and sought").drop("block_index")
    # Parts of blocks: only of documents with paragraphs left, and only those that are keys.
    keys = rest.groupBy("doc_id", F.length("key").alias("size")).agg(F.collect_set("key").alias("keys"))
    windows = F.regexp_extract_all(F.col("norm"), F.concat(F.lit("(?s)(?=(.{"), F.col("size").cast("string"), F.lit("})).")), F.lit(1))
    held = F.when(F.size("keys") <= FEW, F.filter("keys", lambda k: F.contains(F.col("norm"), k))).otherwise(F.array_intersect(windows, "keys"))
    met = b.where("k <> ''").select("doc_id", "block_index", *sides, "norm").hint("merge").join(keys, "doc_id")
    held = met.select("doc_id", "block_index", *sides, F.explode(held).alias("k"))
    within = _near(rest.select("doc_id", F.col("key").alias("k"), "para_index", *sides, "occurrence"), held)

    done = found.where("block_index is not null or not sought").select(*place, F.coalesce("block_index", F.lit(-1)).alias("block_index"), F.when(F.col("block_index").isNotNull(), "exact").alias("step"))
    inside = within.select(*place, F.coalesce("block_index", F.lit(-1)).alias("block_index"), F.when(F.col("block_index").isNotNull(), "part").alias("step"))
    return done.unionByName(inside)

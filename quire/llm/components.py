"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(u, v) → (node, label): the least node that each node can reach. Nodes without edges don't occur.

    Every round is a min-aggregate (combined before its exchange) and a join
    on the node; it ends when a round changes nothing. Labels stay on the
    executors; the driver sees two numbers a round. The least neighbours are
    written out before each join, so that both its sides come straight from a
    shuffle and AQE can split the edges of a node that very many share.
    """
    e = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(low.hint("shuffle_hash"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = stored(down, "edges")
        low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(low.hint("shuffle_hash"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

"""Chat formatting by perspective rotation (operator 7).

For every participant of a conversation the dialogue is rendered once with
that speaker as assistant and all others as named users; only the
assistant's own words carry loss.

A rendering comes as segments, one a turn, with character offsets into the
whole, so that a conversation of any length never meets in one row or task:
offsets add up within blocks of turns, then over blocks. What blocks add up to
comes from lengths alone; the texts move once, to the task of their block.

Defined cases: null text is empty; null roles take part as ``unknown``;
system turns are context in every rendering and no participant of their own;
a conversation without other speakers gives no rows; rows with equal conv_id
and turn are ordered by role, then text, and rows equal in all are kept, as
often as they come (numbered); null conv_id is one conversation of its own;
null turns come first; texts may have any length and are rendered as they are,
tags within them included, which is why offsets and not tags tell segments
apart; other columns don't matter (see common.pick). An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import pick, table

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) → segments of each participant's rendering.

    conv_id, perspective, turn, role, seg, rendered, start, end, mask_start,
    mask_end: mask_* bound the text with loss, both equal to `end` if none.
    """
    c = pick(conversations, "conv_id", "turn", "role", "text")
    c = c.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).alias("_b"))
    role = F.col("role")
    as_user = F.concat(F.lit(OPEN), F.when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))
    as_assistant = F.lit(f"{OPEN}assistant\n")

    # Lengths only: what each block adds to a rendering, and by how much its own perspective differs.
    size = (F.length(as_user) + F.length("text") + len(CLOSE)).cast("long")
    slim = c.groupBy("conv_id", "_b", "role").agg(F.sum(size).alias("u"), F.count("*").alias("n"))
    slim = slim.withColumn("d", F.col("n") * (F.length(as_assistant) - F.length(as_user)))
    blocks = slim.groupBy("conv_id", "_b").agg(F.sum("u").alias("u"), F.sum("n").alias("n"), F.collect_list(F.struct("role", "d")).alias("ds"))
    people = slim.where(role != "system").select(F.struct("conv_id").alias("_c"), role.alias("perspective")).distinct()
    both = blocks.withColumn("_c", F.struct("conv_id")).hint("merge").join(people, "_c")  # structs: a null conv_id meets itself
    own = F.aggregate(F.filter("ds", lambda x: x["role"] == F.col("perspective")), F.lit(0).cast("long"), lambda acc, x: acc + x["d"])
    outer = Window.partitionBy("conv_id", "perspective").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda x: F.coalesce(F.sum(x).over(outer), F.lit(0))
    both = both.select("conv_id", "_b", "perspective", sum_before(F.col("u") + own).alias("_off"), sum_before(F.col("n")).alias("_before"))
    key = F.struct("conv_id", "_b")
    who = both.groupBy(key.alias("_k")).agg(F.collect_list(F.struct("perspective", "_off", "_before")).alias("_who"))

    # One exchange of the texts: the count of equal rows, the join and the window all keep to its key.
    rows = c.withColumn("_k", key).repartition("_k").groupBy("_k", "turn", "role", "text").agg(F.count("*").alias("_n"))
    rows = rows.join(who.hint("shuffle_hash"), "_k").select("_k", "turn", "role", "text", "_n", F.inline("_who"))
    mine = role == F.col("perspective")
    rows = rows.withColumn("_head", F.when(mine, as_assistant).otherwise(as_user)).withColumn("_len", (F.length("_head") + F.length("text") + len(CLOSE)).cast("long"))
    inner = Window.partitionBy("_k", "perspective").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(F.col("_len") * F.col("_n")).over(inner), F.lit(0))).withColumn("_no", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    placed = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("_off") + F.col("_in") + F.col("_i") * F.col("_len")
    end = start + F.col("_len")
    return placed.select(
        "_k.conv_id",
        "perspective",
        "turn",
        "role",
        (F.col("_before") + F.col("_no") + F.col("_i")).alias("seg"),
        F.concat("_head", "text", F.lit(CLOSE)).alias("rendered"),
        start.alias("start"),
        end.alias("end"),
        F.when(mine, start + F.length("_head")).otherwise(end).alias("mask_start"),
        F.when(mine, end - 1).otherwise(end).alias("mask_end"),  # the closing tag is learned, its line end is not
    )


def op7_chat(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
with c as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
p as (select distinct conv_id, role as perspective from c where role <> 'system'),
r as (select c.conv_id, perspective, turn, role, text, role = perspective as mine,
  '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head
  from c join p on c.conv_id is not distinct from p.conv_id),
s as (select *, head || text || '<|im_end|>' || chr(10) as rendered from r),
o as (select *, row_number() over w - 1 as seg, sum(length(rendered)) over w as e from s
  window w as (partition by conv_id, perspective order by turn nulls first, role, text rows unbounded preceding))
select conv_id, perspective, turn, role, cast(seg as bigint) as seg, rendered, cast(e - length(rendered) as bigint) as start, cast(e as bigint) as "end",
  cast(case when mine then e - length(rendered) + length(head) else e end as bigint) as mask_start,
  cast(case when mine then e - 1 else e end as bigint) as mask_end
from o
"""

"""Proposals with their evidence: in one exchange, with the samples that a plain search finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import proposals as PR

SAMPLES = "doc_id long, role string, field_key string, value_key string, total long, at int, preview string"


def test_evidence_by_one_pass(spark):
    rows = [(d, "body_text", f, str(i * d % 3), 30, i, f"p{i}") for d in range(1, 5) for f in ("bold", "align") for i in range(30)]
    s = spark.createDataFrame(rows, SAMPLES)
    scope, order = ["doc_id"], ["at"]
    apart = PR.with_evidence(PR.summarize_samples(s, scope), s, scope, order)
    once = PR.with_evidence(PR.summarize_samples(s, scope, order), None, scope, order)
    shown = lambda df: sorted((r.doc_id, r.field_key, r.value, tuple(r.evidence), tuple(map(tuple, r.samples)), r.confidence) for r in df.collect())
    assert shown(apart) == shown(once)


def test_samples_need_no_exchange(spark):
    cols = ["font_east_asia", "font_ascii", "alignment"]
    nums = ["size_pt", "line_pt", "space_before_pt", "space_after_pt", "first_line_chars", "hanging_chars", "left_chars"]
    p = spark.range(40).select((F.col("id") % 4).alias("doc_id"), F.col("id").cast("int").alias("para_index"), F.lit("body_text").alias("role"), F.lit("some text").alias("text"), *[F.lit("a").alias(c) for c in cols], *[F.lit(1.0).alias(c) for c in nums], F.lit(True).alias("bold"), F.lit(0).alias("outline_level"))
    s = PR.role_samples(p.repartition(4, "doc_id"))
    got = PR.with_evidence(PR.summarize_samples(s, ["doc_id"], ["at"]), None, ["doc_id"], ["at"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r.sample_count for r in got.collect()} == {10}

"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of documents.

Defined cases, for every stage: null texts have no words, so the quality rules
reject them; where a stage meets them nevertheless (called by itself), they
stay as they are. Empty texts and texts without a word likewise. Texts are
worked on whole, of any length. Of rows that repeat a doc_id and text the
n-gram join keeps one; of equal texts the row with the least doc_id. Further
columns, also ones whose names clash, are carried along. Empty tables give
empty tables; without labels of both kinds the field has built-in weights; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import stored, table
from quire.llm.decontaminate import clean_documents
from quire.llm.line_dedup import clean_lines
from quire.llm.ngram_join import one_of_each
from quire.llm.pieces import encode_documents
from quire.llm.quality_rules import keep_good, train


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal or near line before them go, and documents of which no word is left."""
    return clean_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least doc_id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go; so do documents that are mostly such spans."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text, with the scores of the three best."""
    return encode_documents(docs, n=3)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("pieces", pieces),
]

#: The line labels and the piece lattice are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

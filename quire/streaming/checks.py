"""Checks over files that keep arriving: a file arrives whole, so every micro-batch is a small corpus of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.incremental import run_checks
from quire.sources.docx import extract_facts
from quire.sources.word import Word


def watch_folder(spark: SparkSession, folder: str, job: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs job(facts, batch number) over the files that are new in a folder; no state is kept between batches."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").load(folder)
    files = files.select(F.xxhash64("path").alias("id"), "content")
    w = files.writeStream.foreachBatch(lambda df, n: job(extract_facts(df), n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def check_folder(spark: SparkSession, folder: str, root: str, check: Callable[[Word], DataFrame], checkpoint: str, library_id: str = "default", available_now: bool = True) -> StreamingQuery:
    """Checks files as they arrive; the batch number is the run number, so a batch that comes again adds nothing (incremental.current_issues reads the issues)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").load(folder)
    files = files.select(F.xxhash64("path").alias("id"), "content")
    w = files.writeStream.foreachBatch(lambda df, n: run_checks(df, root, n, check, library_id) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

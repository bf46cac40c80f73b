"""Runs of checks over a corpus of files that changes: only new and changed files are checked.

A run has a number. Its issues and the state of its files (id, digest of the
content) are written below the root as ``issues/run_id=N`` and, last,
``state/run_id=N``; the state commits the run. So a run that is repeated with
the same number, as a streaming batch may be, adds nothing, and one that died
before its commit is written anew. Of each file and library the newest run
counts: its issues are the current ones. A file without issues has a state
too, which hides the issues of older runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.docx import extract_documents
from quire.sources.tables import stored
from quire.sources.word import Word, tables_of

STATE = "id long, library_id string, digest string, run_id long"
#: Ids of changed files beyond which their content is found by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


def state_of(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each file and library: id, library_id, digest (null: the file is gone), run_id."""
    s = _read(spark, f"{root}/state", STATE)
    return s.groupBy("id", "library_id").agg(F.max_by(F.struct("digest", "run_id"), "run_id").alias("x")).select("id", "library_id", "x.*")


def run_checks(files: DataFrame, root: str, run_id: int, check: Callable[[Word], DataFrame], library_id: str = "default", whole: bool = False) -> int:
    """Checks the files(id, content) that are new or changed for the library; returns how many they were.

    check makes issues (with doc_id) of the tables of Word files. whole: files
    are the whole corpus, so those that it lacks are gone, and so are their
    issues. Null contents are empty files; of rows that repeat an id the one
    with the greatest digest counts. A run number that is committed does
    nothing, not even start the check; neither does a run without changes.
    """
    spark = files.sparkSession
    if not _read(spark, f"{root}/state", STATE).where((F.col("run_id") == run_id) & (F.col("library_id") == library_id)).isEmpty():
        return 0
    digest = F.sha2(F.coalesce("content", F.lit(b"")), 256)
    now = files.select("id", digest.alias("digest")).groupBy("id").agg(F.max("digest").alias("digest"))
    before = state_of(spark, root).where(F.col("library_id") == library_id).select("id", F.col("digest").alias("_old"))
    both = now.withColumn("_here", F.lit(True)).join(before.withColumn("_known", F.lit(True)).hint("merge"), "id", "full" if whole else "left")
    changed = both.where(~F.col("digest").eqNullSafe(F.col("_old"))).select("id", "digest")
    changed = stored(changed, "changed-files")
    n = changed.count()
    if n:
        asked = F.broadcast(changed) if n <= MAX_BROADCAST_IDS else changed.hint("shuffle_hash")
        some = files.withColumn("digest", digest).join(asked, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "content")
        issues = check(tables_of(stored(extract_documents(some), "word-files")))
        issues.withColumn("library_id", F.lit(library_id)).write.mode("overwrite").parquet(f"{root}/issues/run_id={run_id}/library={library_id}")
        state = changed.select("id", F.lit(library_id).alias("library_id"), "digest")
        state.write.mode("overwrite").parquet(f"{root}/state/run_id={run_id}/library={library_id}")
    return n


def current_issues(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The issues of the newest run of each file and library, with library_id and run_id; schema: that of the check's issues."""
    issues = _read(spark, f"{root}/issues", f"{schema}, library_id string, run_id long")
    newest = state_of(spark, root).where("digest is not null").select(F.col("id").alias("doc_id"), "library_id", "run_id")
    return issues.hint("merge").join(newest, ["doc_id", "library_id", "run_id"], "left_semi")

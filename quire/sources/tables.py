"""Issue tables as Parquet, partitioned by severity."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is set and driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/quire/{name}-{uuid.uuid4().hex}"


def sink_issues(issues: DataFrame, path: str) -> DataFrame:
    """Writes the issues, one folder a severity, and reads them back."""
    issues.write.partitionBy("severity").parquet(path)
    return issues.sparkSession.read.schema(issues.schema).parquet(path).select(*issues.columns)


def sink_summary(issues: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(issues, summary, totals): the issues as sink_issues writes them, their summary_sets as a table beside, and the totals that the writing job has counted."""
    from quire.operators.report import observed, summary_sets

    counted, seen = observed(issues)
    back = sink_issues(counted, f"{path}/issues")
    totals = seen.get
    summary_sets(back).write.parquet(f"{path}/summary")
    return back, issues.sparkSession.read.parquet(f"{path}/summary"), totals


def clustered(df: DataFrame, name: str, keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("doc_id", "para_index")) -> DataFrame:
    """df as a new table in the shared folder, in as many buckets of its keys as there are shuffle partitions: windows and aggregates by them need no exchange."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = folder(spark, name)
    table = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[1]}"
    # Dealt first: each task writes one file, that of its bucket.
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).sortBy(*order).saveAsTable(table)
    return spark.table(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table in the shared folder and read back: worked out once, however many checks read it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Helpers that every operator of this package uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place_of(cols: list[str], name: str, default: int | None = -1) -> int | None:
    """Where a column stands: the exact spelling wins, then the first that differs only in case; else `default`, or an error."""
    if name in cols:
        return cols.index(name)
    low = [c.lower() for c in cols]
    if name.lower() in low:
        return low.index(name.lower())
    if default == -1:
        raise ValueError(f"column {name!r} is missing; there are {cols}")
    return default


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called _c0, _c1 …, whatever their names were."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by position.

    Extra columns never matter, not even ones whose names differ only in case
    or repeat a name (see place_of).
    """
    cols = df.columns
    return numbered(df).select(*[F.col(f"_c{place_of(cols, n)}").alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a fresh local folder, if driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

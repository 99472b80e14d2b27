"""Stages of a longer job as written tables: lineage ends there, and what several results read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One folder a process, so that a finished run can be removed as a whole.
RUN = f"accordant-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Local sessions without one get a temporary folder; on a cluster it must be named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-accordant-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers or digests that a join may broadcast (about 100 MB in memory at most); of more, Spark picks the join.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """df, marked as the side of a join that is broadcast if a count shows that it is small."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def small(df: DataFrame) -> DataFrame:
    """sized, for a table that is computed: written first, so that the count reads it."""
    return sized(staged(df))

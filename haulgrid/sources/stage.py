"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.
    A session on one machine may leave it unset; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="haulgrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the folder that driver and executors share, and read back: a
    loop's plan does not grow, what several readers need is computed once, and a lost executor
    costs only a new read."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str, tasks: int = 3) -> DataFrame:
    """``df`` dealt by keys over three tasks a core; more ``tasks`` where groups are so few and long that two in one task
    would hold up the rest. Groups of kernels are few bytes and much work; adaptive execution, which looks at bytes,
    merges only partitions whose number isn't given."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, *keys)

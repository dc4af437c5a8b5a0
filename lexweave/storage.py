"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that the session has.

    Only a local session (driver and executors on one machine) may be without:
    it gets a temporary folder.  A cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if folder is None:
        if current.isDefined():
            folder = current.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: lineage ends there and row places are fixed."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back

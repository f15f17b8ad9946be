"""Tables between supersteps: written to shared storage, so lineage stays short and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset."""
    cluster = spark.conf.get("spark.checkpoint.dir", None)
    if cluster:
        return cluster.rstrip("/")
    if not hasattr(shared_dir, "own"):
        holder = tempfile.TemporaryDirectory(prefix="tidegraph-")
        atexit.register(holder.cleanup)
        shared_dir.own = f"file://{holder.name}"
    return shared_dir.own


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

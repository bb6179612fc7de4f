"""Lineage cuts: tables written to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicweft-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """A run's own folder of Parquet tables under the checkpoint folder.

    A loop writes each step here and reads it back, so a lost executor never
    replays more than the current step.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str, schema: str) -> DataFrame:
        """All partitions written so far below ``name`` (``name/step=0``, ...)."""
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Delete a step of this run that later steps no longer read ("" for the whole run)."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

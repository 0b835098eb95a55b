"""Cutting the lineage of iterative plans in storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; one of this process only for a session of one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"lynceus-{os.getpid()}")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's process ends, on whatever storage it lies."""
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder; it goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lynceus-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Cuts of an iteration: each ``cut`` may say that the tables before the last ``keep`` are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/lynceus-cut-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        delete_at_end(self.spark, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int) -> None:
        """Delete all but the last ``keep`` tables."""
        old, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in old:
            delete(self.spark, path)

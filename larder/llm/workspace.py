"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing it as Parquet below ``spark.checkpoint.dir`` and reading it again: the
files outlive any executor, and later stages never recompute Python work. The driver's file system deletes them when it
closes, and ``delete`` does so at once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new temporary folder where that is unset and one machine does all."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
    return _own_folder


class Workspace:
    """Tables of one operator call, below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        files, path = self._files(self.folder)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the files, so that its plan starts there."""
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self._delete(self.path(name))

    def delete(self) -> None:
        """Delete all tables; what was read from them can't be read again."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        files, path = self._files(folder)
        files.delete(path, True)

    def _files(self, folder: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

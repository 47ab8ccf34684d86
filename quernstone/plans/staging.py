"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset (tests, a laptop) a folder of
the driver is used, which is only right in local mode.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; sets a local one if the session names none and runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="quernstone-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


class Stage:
    """A step's own folder in the shared one: tables written to it are read back without lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._files("").deleteOnExit(self._at(""))  # with the session at the latest

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Writes ``df`` once and returns a reader of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}", partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        self._files(name).delete(self._at(name), True)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self, name: str):
        return self._at(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files give fewer.

    For steps in Python whose time is much longer than moving their rows; a table of many files stays as it is.
    ``df`` must be a scan: a plan with exchanges would run to tell its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def checked_broadcast(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have ``most`` rows or fewer, else as it is.

    For tables of a row a language or the like, which must be cheap to count.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

"""Readers for the parquet tables of a data directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        at = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        package = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory that holds one parquet file or folder per table."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Ranks inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1024


def ranked(df: DataFrame, keys: list[str], ids: list[str], seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``place``: 0, 1, … inside each group of ``keys``, in a seeded random order of ``ids``.

    ``ids`` must be unique inside a group. A hash of the ids puts each row into one of
    ``buckets`` buckets of its group; the ranks of a bucket start where the counts of those
    before it end, so the largest sort is a bucket, not a group. The order doesn't depend on the
    partitioning. Null keys form a group of their own.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *ids)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    at = [*keys, "_bucket"]
    inside = hashed.withColumn("_in", F.row_number().over(Window.partitionBy(*at).orderBy("_hash", *ids)) - 1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy(*at).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(at)], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(at)]
    joined = inside.join(renamed, same, "inner")
    return joined.select(*df.columns, (F.col("_start") + F.col("_in")).alias("place"))

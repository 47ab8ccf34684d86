"""Positions in an order, without a task that sorts everything or a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.staging import Stage, checked_broadcast

MOST_GROUPS = 100_000  # groups whose starts are broadcast


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``position``, 0 up, by ``order`` (unique): rows are sorted in ranges, and each range starts where those before it end."""
    stage = Stage(rows.sparkSession, "positions")
    ranges = stage.write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_in", inside).join(starts, "_range").withColumn("position", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def places(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``place``, 0 up in each group, and ``group_size``; ``order`` is unique in a group."""
    placed = positions(rows, group, *order)
    groups = placed.groupBy(F.col(group).alias("_group")).agg(F.min("position").alias("_first"), F.count("*").alias("group_size"))
    joined = placed.join(checked_broadcast(groups, MOST_GROUPS), placed[group].eqNullSafe(groups["_group"]))
    return joined.withColumn("place", F.col("position") - F.col("_first")).drop("position", "_group", "_first")

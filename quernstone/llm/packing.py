"""Problem 7: documents into containers of fixed capacity, by bulk-synchronous best fit.

Sizes are whole numbers up to the capacity, so the range-sorted list of documents, and that
of gaps, is a list of runs of equal values: at most ``capacity`` of them, whatever the
number of documents. A superstep sweeps all runs of documents, from the largest size, for
the successor of each size among the gaps (the smallest gap that holds it). Where several
sizes claim one run of gaps, rank decides: larger sizes first, and those that come too late
wait for the next superstep, which sees the gaps that are left. The largest size that found
no gap opens containers. The sweeps give each size's ranks to runs of container numbers;
ranks of documents within their size are computed in parallel, and each document looks its
container up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.ranking import ranked
from quernstone.plans.staging import Stage

CAPACITY = 4096
MOST_CAPACITY = 1 << 20  # bounds the runs that the driver sweeps


def best_fit(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Matches ``(size, first rank, documents, first container)`` for counts of sizes, and the number of containers."""
    left = {s: n for s, n in sizes.items() if n > 0 and 0 < s <= capacity}
    order = sorted(left, reverse=True)
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> runs [first container, how many]
    values: list[int] = []  # gaps that have runs, rising
    matches: list[tuple[int, int, int, int]] = []
    containers = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap not in gaps or not gaps[gap]:
            bisect.insort(values, gap)
            gaps[gap] = []
        runs = gaps[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, n])

    def place(size: int, gap: int) -> list[tuple[int, int, int]]:
        """Puts documents into containers of one gap; what is left of these, for the next superstep."""
        after, runs = [], gaps[gap]
        while runs and left[size]:
            first, have = runs[-1]
            n = min(left[size], have)
            matches.append((size, taken[size], n, first))
            taken[size] += n
            left[size] -= n
            after.append((gap - size, first, n))
            if n == have:
                runs.pop()
            else:
                runs[-1] = [first + n, have - n]
        if not runs:
            values.pop(bisect.bisect_left(values, gap))
        return after

    after = list(range(len(order) + 1))  # of each place in the order the next size that has documents left

    def next_left(i: int) -> int:
        while after[i] != i:
            after[i] = i = after[after[i]]
        return i

    while next_left(0) < len(order):
        updates: list[tuple[int, int, int]] = []
        roomiest = values[-1] if values else 0  # of all gaps, those that this superstep leaves too
        i = next_left(0)
        while i < len(order):
            size = order[i]
            at = bisect.bisect_left(values, size)
            if at < len(values):
                new = place(size, values[at])
            elif size > roomiest:
                # no gap holds it: it opens containers; n of its size share one if they can
                n = -(-left[size] // (capacity // size))
                new = [(capacity - size, containers, n)]
                matches.append((size, taken[size], n, containers))
                taken[size] += n
                left[size] -= n
                containers += n
            elif values:
                # larger sizes had the better rank for its gap, and it doesn't open one: all sizes wait that the gaps left can't hold
                i = next_left(bisect.bisect_left(order, -values[-1], lo=i + 1, key=neg))
                continue
            else:
                break
            if not left[size]:
                after[i] = i + 1
            i = next_left(i + 1)
            updates += new
            roomiest = max([roomiest, *(g for g, _, _ in new)])
        for gap, first, n in updates:
            if gap:
                give(gap, first, n)
    return matches, containers


def pack(documents: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """``doc_id, part, n_tokens, container``: each document whole in one container, unless it is larger than one.

    A document above the capacity fills containers of its own with full parts; its rest is
    packed like any document. Containers are numbered from 0, those of full parts behind
    the others. Documents of size 0 lie in container 0; null ids and sizes are left out;
    repeated ids count once, with their largest size. Other columns are ignored.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError("the capacity is out of range")
    spark = documents.sparkSession
    stage = Stage(spark, "packing")
    each = documents.select(F.col(doc_id).alias("doc_id"), F.col(size).cast("long").alias("n")).where("doc_id is not null and n is not null and n >= 0").groupBy("doc_id").agg(F.max("n").alias("n"))
    each = stage.write(each.withColumn("full", F.expr(f"n div {capacity}")).withColumn("rest", F.col("n") % capacity), "sizes")
    counts = {r["rest"]: r["count"] for r in each.where("rest > 0").groupBy("rest").count().collect()}  # at most ``capacity`` rows
    matches, n_shared = best_fit(counts, capacity)
    plan = np.array(sorted(matches), np.int64).reshape(-1, 4)
    shipped = spark.sparkContext.broadcast((plan[:, 0] * (1 << 40) + plan[:, 1], plan[:, 1], plan[:, 3]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, starts = shipped.value
        for b in batches:
            rest, place = np.asarray(b.column(2)), np.asarray(b.column(3))
            at = np.searchsorted(keys, rest * (1 << 40) + place, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(starts[at] + place - firsts[at])], names=["doc_id", "part", "n_tokens", "container"])

    kind = each.schema["doc_id"].dataType.simpleString()
    items = ranked(each.where("rest > 0").select("doc_id", F.col("full").alias("part"), "rest"), ["rest"], ["doc_id"], seed)
    shared = items.select("doc_id", "part", "rest", "place").mapInArrow(look_up, f"doc_id {kind}, part long, n_tokens long, container long")
    empty = each.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("container"))
    # full parts are numbered by their document's place among the large ones
    large = each.where("full > 0").select("doc_id", "full")
    order = ranked(large.withColumn("all", F.lit(0)), ["full", "all"], ["doc_id"], seed)
    starts = large.groupBy("full").agg((F.count("*") * F.first("full")).alias("parts"))
    starts = starts.select(F.col("full").alias("_full"), (F.coalesce(F.sum("parts").over(Window.orderBy("full").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + n_shared).alias("start"))
    full = order.join(starts, F.col("full") == F.col("_full")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"), (F.col("start") + F.col("place") * F.col("full")).alias("at"))
    full = full.select("doc_id", "part", F.lit(capacity).cast("long").alias("n_tokens"), (F.col("at") + F.col("part")).alias("container"))
    return shared.unionByName(full).unionByName(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens and their share."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return by.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")).withColumn("unused", F.col("n_containers") * capacity - F.col("n_tokens")).withColumn("unused_share", F.round(F.col("unused") / (F.col("n_containers") * capacity), 6))

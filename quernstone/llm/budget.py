"""Problem 6: how many tokens each item holds, and totals by source, language and domain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.tokens import Pieces, chunked, count_tokens
from quernstone.plans.staging import Stage

MOST_BROADCAST = 200_000  # ids of items without tokens up to which they are broadcast
SALTS = 64


def real_tokens(items: DataFrame, pieces: Pieces, keep: tuple[str, ...]) -> DataFrame:
    """``keep…, n_tokens``: tokens of ``tokens.input_ids`` whose piece isn't special; null where there are none to count."""
    shipped = items.sparkSession.sparkContext.broadcast(np.array(sorted(pieces.special), np.int64))
    shape = items.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = shipped.value
        for b in batches:
            ids = b.column(len(keep))
            flat = ids.flatten()
            real = ~np.isin(np.asarray(flat.cast(pa.int64()).fill_null(-1)), special) & np.asarray(flat.is_valid())
            ends = np.concatenate(([0], np.cumsum(real)))
            size = np.asarray(ids.value_lengths().fill_null(0))
            stop = np.cumsum(size)
            n = ends[stop] - ends[stop - size]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64(), mask=np.asarray(ids.is_null()))], names=[*keep, "n_tokens"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape), "n_tokens bigint"])
    return items.select(*keep, F.col("tokens.input_ids").alias("_ids")).mapInArrow(run, fields)


def item_tokens(items: DataFrame, texts: DataFrame, pieces: Pieces, code: Column) -> DataFrame:
    """``item_id, source, lang, n_tokens, estimated`` once for each item.

    items: ``item_id, q_id, tokens, source``; texts: ``docid, text``. Items without tokens
    are counted from their text, cut only where the tokenizer is proven independent and
    spread over SALTS workers an item; without a text they have none (null). Repeated rows
    count once. ``code`` is the column of the label's code. Other columns are ignored.
    """
    spark = items.sparkSession
    stage = Stage(spark, "tokens")
    keep = ("item_id", "q_id", "source", "lang")
    rows = real_tokens(items.withColumn("lang", code), pieces, keep).where("item_id is not null")
    # of repeated rows the one with most tokens holds
    once = rows.groupBy("item_id").agg(F.max(F.struct(F.coalesce("n_tokens", F.lit(-1)).alias("n"), "q_id", "source", "lang")).alias("x"))
    once = stage.write(once.select("item_id", "x.q_id", "x.source", "x.lang", F.when(F.col("x.n") >= 0, F.col("x.n")).alias("n_tokens")), "items")
    lacking = once.where("n_tokens is null and q_id is not null").select(F.col("q_id").alias("docid")).distinct()
    few = lacking.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wanted = texts.select("docid", "text").join(F.broadcast(lacking) if few else lacking, "docid", "left_semi").dropDuplicates(["docid"])
    spread = chunked(wanted, "docid", "text").repartition("docid", F.pmod("chunk_no", F.lit(SALTS)))
    shipped = spark.sparkContext.broadcast(pieces)
    counts = count_tokens(spread, "docid", "chunk", lambda: shipped.value).groupBy("docid").agg(F.sum("n_tokens").alias("n"))
    none = wanted.where("text is not null").select("docid", F.lit(0).cast("long").alias("n"))  # an empty text has no chunk
    counts = counts.unionByName(none).groupBy("docid").agg(F.max("n").alias("n"))
    estimated = once.where("n_tokens is null").join(counts, F.col("q_id") == F.col("docid"), "left").select("item_id", "source", "lang", F.col("n").alias("n_tokens"), F.lit(True).alias("estimated"))
    return once.where("n_tokens is not null").select("item_id", "source", "lang", "n_tokens", F.lit(False).alias("estimated")).unionByName(estimated)


def totals(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, domain, lang, n_items, n_tokens, n_estimated``: sums of every slice, partly aggregated before the shuffle."""
    domains = sources.groupBy("source").agg(F.min("domain").alias("domain"))
    by = counts.groupBy("source", "lang").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("estimated"), F.col("n_tokens"))).alias("n_estimated"))
    return by.join(domains, "source", "left").select("source", "domain", "lang", "n_items", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_estimated", F.lit(0)).alias("n_estimated"))


def rollup(by_slice: DataFrame) -> DataFrame:
    """Totals of each source, each language, each domain and of all: ``slice, name, n_items, n_tokens``."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), c.cast("string").alias("name")) for s, c in (("source", F.col("source")), ("lang", F.col("lang")), ("domain", F.col("domain")), ("all", F.lit("all")))]))
    return by_slice.select(each.alias("s"), "n_items", "n_tokens").groupBy("s.slice", "s.name").agg(F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))

"""Inverted indexes as DataFrames: postings, statistics and weights, one model for each language.

``docs`` everywhere has ``lang, doc_id, tokens``. Postings are ``lang, doc_id, dl, term,
tf``; a document's length travels with its postings, so no join brings it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.staging import checked_broadcast

#: Tuned (k1, b) of each language (fixed values).
TUNED = {"ar": (1.6, 1.0), "de": (2.0, 0.95), "en": (1.4, 0.5), "es": (1.7, 0.95), "fr": (1.8, 0.95), "it": (2.0, 0.9), "ko": (1.7, 1.0)}
K1, B = 1.5, 0.75


def vocabulary(docs: DataFrame) -> DataFrame:
    """The different terms of each language."""
    return docs.select("lang", F.explode(F.array_distinct("tokens")).alias("term")).distinct()


def postings(docs: DataFrame) -> DataFrame:
    """How often each term occurs in each document, one row of ``docs``.

    Counted inside the row, as runs of its sorted words: nothing moves.
    """
    words = docs.where(F.size("tokens") > 0).select("lang", "doc_id", F.size("tokens").cast("long").alias("dl"), F.sort_array("tokens").alias("_w"))
    first = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    runs = F.transform("_first", lambda p, i: F.struct(F.get("_w", p - 1).alias("term"), (F.coalesce(F.get("_first", i + 1), F.size("_w") + 1) - p).cast("long").alias("tf")))
    return words.withColumn("_first", first).select("lang", "doc_id", "dl", F.inline(runs))


def packed(docs: DataFrame) -> DataFrame:
    """The same in a row a document: ``lang, doc_id, dl, terms, tfs``; in Python, so that no filter splits a text a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            size = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
            coded = pc.list_flatten(lists).dictionary_encode()
            doc, many = np.repeat(np.arange(b.num_rows), size), max(1, len(coded.dictionary))
            pairs, tf = np.unique(doc * many + np.asarray(coded.indices), return_counts=True)
            some = np.flatnonzero(size)
            cuts = pa.array(np.append(np.searchsorted(pairs // many, some), len(pairs)), pa.int32())
            terms = pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(pairs % many)))
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(some)), b.column("doc_id").take(pa.array(some)), pa.array(size[some]), terms, pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))], names=["lang", "doc_id", "dl", "terms", "tfs"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("lang", "doc_id")}
    return docs.select("lang", "doc_id", "tokens").mapInArrow(run, f"lang {kinds['lang']}, doc_id {kinds['doc_id']}, dl bigint, terms array<string>, tfs array<int>")


def unpacked(rows: DataFrame) -> DataFrame:
    """The postings of ``packed`` rows."""
    return rows.select("lang", "doc_id", "dl", F.inline(F.arrays_zip("terms", "tfs"))).select("lang", "doc_id", "dl", F.col("terms").alias("term"), F.col("tfs").cast("long").alias("tf"))


def packed_stats(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``corpus_stats`` from ``lang`` of all documents and ``packed`` rows."""
    n = documents.groupBy("lang").agg(F.count("*").alias("n_docs"))
    total = rows.groupBy("lang").agg(F.sum("dl").alias("total"))
    return n.join(total, "lang", "left").select("lang", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """Documents that hold each term."""
    return tf.groupBy("lang", "term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``lang, n_docs, avgdl`` over all documents, empty ones too."""
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))


def stats_of(documents: DataFrame, tf: DataFrame) -> DataFrame:
    """The same from ``lang`` of all documents and the postings, without reading a text again."""
    n = documents.groupBy("lang").agg(F.count("*").alias("n_docs"))
    total = tf.groupBy("lang").agg(F.sum("tf").alias("total"))
    return n.join(total, "lang", "left").select("lang", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def bm25_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``idf`` = ln((N - df + 0.5) / (df + 0.5) + 1). A language has one row of statistics; they are counted before they are broadcast."""
    return df.join(checked_broadcast(stats), "lang").withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25_weight(k1: Column | float, b: Column | float) -> Column:
    """From ``tf, dl, avgdl, idf``."""
    k1, b = (F.lit(x) if not isinstance(x, Column) else x for x in (k1, b))
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def with_idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings with ``df, n_docs, avgdl, idf``; the adaptive plan splits the commonest terms' partitions.

    ``tf`` is read twice: write it first where it isn't stored.
    """
    return tf.join(bm25_idf(document_frequency(tf), stats), ["lang", "term"])


def per_language(default: float, chosen: dict[str, float]) -> Column:
    c = F.lit(default)
    for lang, value in chosen.items():
        c = F.when(F.col("lang") == lang, F.lit(value)).otherwise(c)
    return c


def bm25_index(tf: DataFrame, stats: DataFrame, k1: float = K1, b: float = B, tuned: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Weighted postings ``lang, doc_id, term, tf, weight``; ``tuned`` gives languages their own (k1, b)."""
    tuned = tuned or {}
    weight = bm25_weight(per_language(k1, {x: p[0] for x, p in tuned.items()}), per_language(b, {x: p[1] for x, p in tuned.items()}))
    return with_idf(tf, stats).select("lang", "doc_id", "term", "tf", weight.alias("weight"))


def tfidf_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``idf`` = ln(N / df): a term of every document weighs nothing."""
    return df.join(checked_broadcast(stats), "lang").withColumn("idf", F.log(F.col("n_docs") / F.col("df")))


def tf_norms(documents: DataFrame, tf: DataFrame) -> DataFrame:
    """``lang, doc_id, norm``: root of the summed squares of a document's counts; 0 if it is empty."""
    squares = tf.groupBy("lang", "doc_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("s"))
    return documents.select("lang", "doc_id").join(squares, ["lang", "doc_id"], "left").select("lang", "doc_id", F.sqrt(F.coalesce(F.col("s"), F.lit(0)).cast("double")).alias("norm"))


def pivoted_tf(documents: DataFrame, tf: DataFrame) -> DataFrame:
    """``lang, doc_id, term, tf, norm_tf``: counts over half the median norm and half the own norm."""
    norms = tf_norms(documents, tf)
    medians = norms.groupBy("lang").agg(F.median("norm").alias("median"))
    joined = tf.join(norms, ["lang", "doc_id"]).join(checked_broadcast(medians), "lang")
    return joined.select("lang", "doc_id", "term", "tf", (F.col("tf") / (0.5 * F.col("median") + 0.5 * F.col("norm"))).alias("norm_tf"))


def df_filter(df: DataFrame, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """Terms in ``min_df`` documents or more and in at most ``max_df`` of all; needs ``df, n_docs``."""
    return df.where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))


def unit_weights(weighted: DataFrame, key: str) -> DataFrame:
    """``weight`` divided by the root of its squares' sum over ``key``; an all-zero row stays zero."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("lang", key)))
    return weighted.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(F.lit(0.0)))


def tfidf_index(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """Weighted postings at unit length: ``lang, doc_id, term, tf, weight``.

    Pivoted counts would be the same up to rounding, as their norm cancels out.
    """
    idf = tfidf_idf(document_frequency(tf), stats).select("lang", "term", "idf")
    weighted = tf.join(idf, ["lang", "term"]).select("lang", "doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    return unit_weights(weighted, "doc_id")

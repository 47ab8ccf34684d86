"""Batches of queries against an index: scores, top k with padding, fusion, hit lists.

``queries`` has ``query_id, lang, terms``; equal scores (to 6 digits) are ordered by id.
Queries are many and grow with the data, so only their different terms are broadcast, if counted to be few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.blocks import DIGITS, Asks, Block, reach
from quernstone.plans.staging import checked_broadcast

SPREAD = 16  # parts of a language's documents that are scored in parallel, at least
ASKED = 20_000  # queries that a task holds, about
BLOCK = 1_000_000  # postings that a task holds, about
MOST_TERMS = 200_000  # different terms of all queries that are broadcast


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, lang, term, qtf``: a repeated term counts as often as it occurs."""
    return queries.select("query_id", "lang", F.explode("terms").alias("term")).groupBy("query_id", "lang", "term").agg(F.count("*").alias("qtf"))


def asked_postings(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of terms that some query has, before they are weighted or moved; counts by term stay those of all documents."""
    terms = queries.select("lang", F.explode("terms").alias("term")).distinct()
    return postings.join(checked_broadcast(terms, MOST_TERMS), ["lang", "term"], "left_semi")


def scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, lang, doc_id, score`` of the documents that share a term with the query; unknown terms are dropped."""
    met = index.join(query_terms(queries), ["lang", "term"])
    return met.groupBy("query_id", "lang", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), DIGITS).alias("score"))


def best_scores(index: DataFrame, queries: DataFrame, k: int, spread: int | None = None) -> DataFrame:
    """Of ``scores`` a superset of each query's ``k`` best, without moving a row for every query and document that meet.

    The documents of a language lie in ``spread`` parts, to which its queries go, if they are many in rows of a grid. A part adds up its
    postings of whole documents, a block at a time, and hands on the ``k`` best of each query.
    """
    spread = spread or max(SPREAD, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": index.schema["doc_id"].dataType.simpleString()}
    rows = max(1, -(-queries.count() // ASKED))
    part, row = F.sequence(F.lit(0), F.lit(spread - 1)), F.sequence(F.lit(0), F.lit(rows - 1))
    asks = query_terms(queries).select("lang", F.explode(part).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("row"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(types["doc_id"]).alias("doc_id"), "term", F.col("qtf").cast("double").alias("x"))
    held = index.select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("part"), F.explode(row).alias("row"), F.lit(1).alias("kind"), F.lit(None).cast(types["query_id"]).alias("query_id"), "doc_id", "term", F.col("weight").alias("x"))
    mixed = asks.unionByName(held).repartition("lang", "part", "row").sortWithinPartitions("lang", "part", "row", "kind", "query_id", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's queries come before its postings."""
        group, asked, waiting = None, [], []

        def runs(b: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("lang", "part", "row", "kind")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield keys[i], b.slice(i, j - i)

        def answer(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if not asked or not waiting:
                waiting = []
                return
            docs, queries = pa.concat_tables(waiting).combine_chunks(), pa.concat_tables(asked)
            if not whole:  # the last document may go on
                last = pc.equal(docs["doc_id"], docs["doc_id"][-1])
                waiting, docs = [docs.filter(last)], docs.filter(pc.invert(last))
            else:
                waiting = []
            if docs.num_rows:
                yield from _block(docs, queries, group[0], k)

        for batch in batches:
            for key, t in runs(pa.Table.from_batches([batch])):
                if key[:3] != group:
                    yield from answer(True)
                    group, asked, waiting = key[:3], [], []
                (waiting if key[3] else asked).append(t)
                if key[3] and sum(x.num_rows for x in waiting) > BLOCK:
                    yield from answer(False)
        yield from answer(True)

    lang = index.schema["lang"].dataType.simpleString()
    found = mixed.mapInArrow(run, f"query_id {types['query_id']}, lang {lang}, doc_id {types['doc_id']}, score double")
    return found


def _block(docs: pa.Table, queries: pa.Table, lang: object, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of a block for each query; documents come in their order, queries sorted."""
    words, ids, names = queries["term"].unique(), docs["doc_id"].unique(), queries["query_id"].unique()
    word, number = np.asarray(pc.index_in(docs["term"], value_set=words).fill_null(-1)), np.asarray(pc.index_in(docs["doc_id"], value_set=ids))
    block = Block.of(word, number, np.asarray(docs["x"]), len(words), len(ids))
    owner, asked = np.asarray(pc.index_in(queries["query_id"], value_set=names)), np.asarray(pc.index_in(queries["term"], value_set=words))
    asks = Asks(np.searchsorted(owner, np.arange(len(names) + 1)), asked, np.asarray(queries["x"]))
    found = list(reach(block, asks, np.zeros(len(names)), k))
    if found:
        who, what, scores = np.concatenate([np.full(len(x), q) for q, x, _ in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array([lang] * len(who)), ids.take(pa.array(what)), pa.array(scores)], names=["query_id", "lang", "doc_id", "score"])


def tfidf_scores(index: DataFrame, idf: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of queries and documents; ``idf`` has ``lang, term, idf`` of the corpus."""
    known = query_terms(queries).join(idf.select("lang", "term", "idf"), ["lang", "term"])
    length = F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2)).over(Window.partitionBy("query_id")))
    weighted = known.withColumn("wq", F.when(length > 0, F.col("qtf") * F.col("idf") / length).otherwise(F.lit(0.0))).drop("idf", "qtf")
    met = index.join(weighted, ["lang", "term"])
    return met.groupBy("query_id", "lang", "doc_id").agg(F.round(F.sum(F.col("wq") * F.col("weight")), DIGITS).alias("score"))


def top_k(scored: DataFrame, k: int, *by: Column) -> DataFrame:
    """Adds ``rank``, 1 to ``k``: by ``by``, or by falling score, then document id."""
    order = Window.partitionBy("query_id").orderBy(*(by or (F.desc("score"), F.asc("doc_id"))))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pad(scored: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Adds the ``k`` lowest ids of the query's language at score 0, so that every list has min(k, N) documents.

    If m < k documents score, k - m others are among any k documents: the result is exact.
    """
    lowest = Window.partitionBy("lang").orderBy("doc_id")
    first = documents.select("lang", "doc_id").withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k).drop("n")
    fill = queries.select("query_id", "lang").join(first, "lang").select("query_id", "lang", "doc_id", F.lit(0.0).alias("score"))
    return scored.unionByName(fill).groupBy("query_id", "lang", "doc_id").agg(F.max("score").alias("score"))


def match(scored: DataFrame, queries: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each query, padded with unscored ones."""
    return top_k(pad(top_k(scored, k).drop("rank"), queries, documents, k), k)


def match_all(scored: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """The whole ranking of a language's documents for each query; its size is queries times documents."""
    every = queries.select("query_id", "lang").join(documents.select("lang", "doc_id"), "lang")
    full = every.join(scored.drop("lang"), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def fuse(first: DataFrame, second: DataFrame, k_first: int = 9, k: int = 10) -> DataFrame:
    """The first ``k_first`` of one ranking, then the other's best ``k_first`` not yet there, then the first's rest.

    Both have ``query_id, lang, doc_id, rank``; shorter lists give fewer rows.
    """
    a = first.select("query_id", "lang", "doc_id", F.when(F.col("rank") <= k_first, F.col("rank")).otherwise(F.col("rank") + k_first).alias("pos"))
    b = second.where(F.col("rank") <= k_first).select("query_id", "lang", "doc_id", (F.col("rank") + k_first).alias("pos"))
    # the second list's places lie between: 1..9 first, 10..18 second, 19.. the first's rest
    best = a.unionByName(b).groupBy("query_id", "lang", "doc_id").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy("pos")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("pos")


def hit_list(ranked: DataFrame) -> DataFrame:
    """``query_id, docids``: the ids in order, as text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"))))
    return ranked.groupBy("query_id").agg(F.transform(ordered, lambda x: x["doc_id"]).alias("docids"))


def scatter(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its hit list, null if it has none."""
    return queries.join(hits, "query_id", "left")

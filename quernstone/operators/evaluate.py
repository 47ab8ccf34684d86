"""Retrieval quality: hit rates, pessimistic ranks, recall, grids of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import index as I
from quernstone.operators.search import DIGITS, query_terms
from quernstone.plans.staging import checked_broadcast

#: The grid of the tuning script, in its order (fixed values).
K1_GRID = (1.2, 1.1, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0)
B_GRID = (0.0, 0.25, 0.5, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``query_id, lang, hit`` of every query of ``relevant`` (``query_id, lang, doc_id``)."""
    found = ranked.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return relevant.join(found, ["query_id", "doc_id"], "left").select("query_id", "lang", F.coalesce("hit", F.lit(0)).alias("hit"))


def accuracy(ranked: DataFrame, relevant: DataFrame, *by: str) -> DataFrame:
    """Share of queries whose relevant document is in their list, by language or what ``by`` names."""
    each = hits(ranked, relevant)
    return (each.groupBy(*by) if by else each.groupBy()).agg(F.count("*").alias("n_queries"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def pessimistic_ranks(scored: DataFrame, relevant: DataFrame, stats: DataFrame, score: tuple[str, ...] = ("score",)) -> DataFrame:
    """``query_id, lang``, and for each column of ``score`` its target score and its rank, named ``<score>_rank``.

    The rank is the number of documents that score at least as much as the relevant one;
    all of the language if that doesn't score. Several scores share one pass.
    """
    wanted = [F.coalesce(c, F.lit(0.0)).alias(f"t_{c}") for c in score]
    target = relevant.join(scored.drop("lang"), ["query_id", "doc_id"], "left").select("query_id", "lang", *wanted)
    met = scored.drop("lang").join(target.drop("lang"), "query_id")
    above = met.groupBy("query_id").agg(*[F.count(F.when((F.col(f"t_{c}") > 0) & (F.col(c) >= F.col(f"t_{c}")), 1)).alias(f"n_{c}") for c in score])
    ranks = target.join(above, "query_id", "left").join(checked_broadcast(stats), "lang")
    return ranks.select("query_id", "lang", *[F.col(f"t_{c}").alias(c) for c in score], *[F.when(F.col(f"t_{c}") > 0, F.col(f"n_{c}")).otherwise(F.col("n_docs")).alias(f"{c}_rank") for c in score])


def recall_at_k(ranks: DataFrame, k: int, *by: str) -> DataFrame:
    """Share of ranks up to ``k``; no row for no rank."""
    return ranks.groupBy(*by).agg(F.avg((F.col("rank") <= k).cast("double")).alias("recall")).withColumn("k", F.lit(k))


def bm25_grid(tf: DataFrame, stats: DataFrame, queries: DataFrame, relevant: DataFrame, k1s: tuple[float, ...] = K1_GRID, bs: tuple[float, ...] = B_GRID, k: int = 10) -> DataFrame:
    """``lang, grid_pos, k1, b, recall, k``, the grid in the order k1 by k1.

    Postings are counted once; those that a query meets are weighted at all points in one
    pass, a column a point, so rows aren't multiplied.
    """
    points = [(k1, b) for k1 in k1s for b in bs]
    met = I.with_idf(tf, stats).join(query_terms(queries), ["lang", "term"])
    names = tuple(f"s{i}" for i in range(len(points)))
    sums = [F.round(F.sum(F.col("qtf") * I.bm25_weight(k1, b)), DIGITS).alias(n) for n, (k1, b) in zip(names, points, strict=True)]
    scored = met.groupBy("query_id", "lang", "doc_id").agg(*sums)
    ranks = pessimistic_ranks(scored, relevant, stats, names)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("grid_pos"), F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}_rank").alias("rank")) for i, (k1, b) in enumerate(points)]))
    return recall_at_k(ranks.select("lang", each.alias("p")).select("lang", "p.*"), k, "lang", "grid_pos", "k1", "b")


def best_parameters(tuned: DataFrame) -> DataFrame:
    """Each language's point of highest recall, the first of the grid on ties."""
    order = Window.partitionBy("lang").orderBy(F.desc(F.round("recall", DIGITS)), "grid_pos")
    return tuned.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")

"""Training data and training of the two-tower encoders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import parse_list
from quernstone.operators.dense import Encoder
from quernstone.operators.positions import places
from quernstone.plans.staging import Stage

DRAWS = 1_000_000  # rows that one task draws again at most
BATCH_QUERIES = 512  # whose pairs a task multiplies at once


def training_pairs(queries: DataFrame) -> DataFrame:
    """``query_id, lang, doc_id, is_positive``: the positive of each query and all its parsed negatives."""
    single = F.trim(F.col("positive_docs"))
    positive = queries.where(single.isNotNull() & ~single.isin("", "[]")).select("query_id", "lang", single.alias("doc_id"), F.lit(True).alias("is_positive"))
    negative = queries.select("query_id", "lang", F.explode(parse_list(F.col("negative_docs"))).alias("doc_id"), F.lit(False).alias("is_positive"))
    return positive.unionByName(negative)


def with_vectors(pairs: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs whose query (``query_id, vector``) and document (``doc_id, vector``) both have a vector: adds ``qv, dv``."""
    return pairs.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").join(documents.select("doc_id", F.col("vector").alias("dv")), "doc_id")


def contrastive_loss(pairs: DataFrame, cosine: str = "cosine") -> DataFrame:
    """``query_id, loss`` = -ln(P / (P + Q)), P and Q the sums of exp(cosine) of positives and negatives; no row without a positive."""
    p, q = (F.sum(F.when(F.col("is_positive") == kind, F.exp(cosine)).otherwise(0.0)) for kind in (True, False))
    return pairs.groupBy("query_id").agg(p.alias("p"), q.alias("q")).where("p > 0").select("query_id", F.log((F.col("p") + F.col("q")) / F.col("p")).alias("loss"))


def upsample(rows: DataFrame, lang: str = "lang", row_id: str = "query_id", seed: int = 7) -> DataFrame:
    """All rows, and of each language so many drawn again, with replacement, that all have the largest count: adds ``copy``.

    Draw j of a language with n rows takes the row at place (j * 48271 + seed) mod n of its
    ids in order. ``row_id`` must be unique in a language.
    """
    counts = rows.groupBy(lang).agg(F.count("*").alias("_n"))
    lacking = counts.withColumn("_most", F.max("_n").over(Window.partitionBy())).where("_most > _n").select(F.col(lang).alias("_lang"), (F.col("_most") - F.col("_n")).alias("_less"), "_n")
    # a language's draws are made in blocks of DRAWS by many tasks
    blocks = lacking.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_less - 1) div {DRAWS}")))).repartition("_lang", "_block")
    lacking = blocks.select("_lang", F.explode(F.sequence(F.col("_block") * DRAWS + 1, F.least(F.col("_less"), (F.col("_block") + 1) * DRAWS))).alias("copy"), "_n")
    draws = lacking.select("_lang", "copy", F.pmod(F.col("copy") * 48271 + seed, F.col("_n")).alias("_at"))
    placed = places(rows, lang, row_id)
    drawn = placed.join(draws, placed[lang].eqNullSafe(draws["_lang"]) & (placed["place"] == draws["_at"])).select(*rows.columns, "copy")
    return rows.withColumn("copy", F.lit(0).cast("long")).unionByName(drawn)


def _batch_gradient(b: pd.DataFrame, query: Encoder, document: Encoder) -> tuple[float, int, list[np.ndarray]]:
    """Summed loss, queries and summed gradients of both encoders over whole queries."""
    queries, at = np.unique(b["query_id"].values, return_inverse=True)
    q, d = (np.stack(b[c].values).astype(np.float64) for c in ("qv", "dv"))
    y, z = query.forward(q), document.forward(d)
    cos = (y * z).sum(1)
    e, positive = np.exp(cos), b["is_positive"].values.astype(bool)
    p, all_ = np.bincount(at, e * positive, len(queries)), np.bincount(at, e, len(queries))
    ok = p > 0
    loss = float(-np.log(p[ok] / all_[ok]).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(ok[at], e / all_[at] - np.where(positive, e / p[at], 0), 0)
    return loss, int(ok.sum()), query.gradient(q, slope[:, None] * z) + document.gradient(d, slope[:, None] * y)


def _by_query(pairs: DataFrame) -> DataFrame:
    """A row a query, with its few pairs in a list."""
    return pairs.groupBy("query_id").agg(F.collect_list(F.struct("is_positive", "qv", "dv")).alias("pairs"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of at most ``BATCH_QUERIES`` queries at a time, a row a pair."""
    for b in batches:
        for at in range(0, len(b), BATCH_QUERIES):
            some = b.iloc[at : at + BATCH_QUERIES]
            rows = [(i, *(p[c] for c in ("is_positive", "qv", "dv"))) for i, pairs in zip(some["query_id"], some["pairs"], strict=True) for p in pairs]
            yield pd.DataFrame(rows, columns=["query_id", "is_positive", "qv", "dv"])


def train(pairs: DataFrame, dim: int, hidden: int = 256, epochs: int = 30, rate: float = 1e-5, steps: int = 8, decay: float = 0.01, restart: int = 5, least_rate: float = 1e-7, validation: DataFrame | None = None, seed: int = 0) -> tuple[dict[str, Encoder], list[tuple[int, float, float | None]]]:
    """Fits the query and document encoders; returns them and ``epoch, train_loss, val_loss``.

    pairs: ``query_id, is_positive, qv, dv``, with all rows of a query. Each of the
    ``steps`` of an epoch takes the queries whose hash falls to it; gradients are summed in
    parallel and the driver only receives sums of a model's size. AdamW without decay of biases, cosine
    warm restarts every ``restart`` epochs.
    """
    spark = pairs.sparkSession
    encoders = {"query": Encoder.seeded(dim, hidden, seed), "document": Encoder.seeded(dim, hidden, seed + 1)}
    weights = [p for e in encoders.values() for p in e.parameters()]
    m, v = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    parted = _by_query(pairs).withColumn("step", F.pmod(F.xxhash64("query_id"), F.lit(steps)))
    parted = Stage(spark, "pairs").write(parted, "pairs", "step")

    def sums(df: DataFrame) -> tuple[float, int, list[np.ndarray]]:
        now = spark.sparkContext.broadcast(encoders)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            e = now.value
            loss, n, gradient = 0.0, 0, None
            for b in _pieces(batches):
                more, k, g = _batch_gradient(b, e["query"], e["document"])
                flat = np.concatenate([x.ravel() for x in g])
                loss, n, gradient = loss + more, n + k, flat if gradient is None else gradient + flat
            if gradient is not None:
                yield pd.DataFrame({"loss": [loss], "n": [n], "g": [gradient]})

        parts = df.mapInPandas(run, "loss double, n long, g array<double>")
        nothing = (0.0, 0, np.zeros(sum(p.size for p in weights)))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        total = parts.rdd.map(lambda r: (r["loss"], r["n"], np.array(r["g"]))).treeAggregate(nothing, add, add, 2)
        out, i = [], 0
        for p in weights:
            out.append(total[2][i : i + p.size].reshape(p.shape))
            i += p.size
        return total[0], total[1], out

    history, t = [], 0
    for epoch in range(epochs):
        losses, count = 0.0, 0
        for step in range(steps):
            loss, n, g = sums(parted.where(F.col("step") == step).select("query_id", "pairs"))
            losses, count = losses + loss, count + n
            if not n:
                continue
            t += 1
            lr = least_rate + (rate - least_rate) * (1 + math.cos(math.pi * ((epoch + step / steps) % restart) / restart)) / 2
            for i, p in enumerate(weights):
                x = g[i] / n
                m[i] += 0.1 * (x - m[i])
                v[i] += 0.001 * (x * x - v[i])
                if p.ndim > 1:
                    p *= 1 - lr * decay
                p -= lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        check = sums(_by_query(validation)) if validation is not None else None
        history.append((epoch + 1, losses / max(1, count), check[0] / max(1, check[1]) if check else None))
    return encoders, history

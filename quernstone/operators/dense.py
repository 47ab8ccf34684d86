"""Dense retrieval: the two-tower encoder, exact top k within a language, chunk scores, hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.vectors import cosine, l2_normalize
from quernstone.sources.io import read_by_language, write_by_language

DIGITS = 6
BLOCK = 2048  # documents, and queries, that are compared at once
ASKED = 20_000  # queries that a task holds, about
SPREAD = 16  # parts of each language's documents that are searched in parallel, at least


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Encoder:
    """Two blocks of linear, rectifier, linear and unit length; the first adds its input."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray
    w4: np.ndarray
    b4: np.ndarray

    @classmethod
    def seeded(cls, dim: int, hidden: int = 256, seed: int = 0) -> Encoder:
        r = np.random.default_rng(seed)

        def linear(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            edge = 1 / np.sqrt(a)
            return r.uniform(-edge, edge, (a, b)), r.uniform(-edge, edge, b)

        return cls(*linear(dim, hidden), *linear(hidden, dim), *linear(dim, hidden), *linear(hidden, dim))

    def parameters(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2, self.w3, self.b3, self.w4, self.b4]

    def forward(self, x: np.ndarray) -> np.ndarray:
        y = _unit(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2 + x)
        return _unit(np.maximum(y @ self.w3 + self.b3, 0) @ self.w4 + self.b4)

    def gradient(self, x: np.ndarray, out_gradient: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, summed over rows."""

        def through_unit(v: np.ndarray, g: np.ndarray) -> np.ndarray:
            n = np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
            u = v / n
            return (g - u * (g * u).sum(1, keepdims=True)) / n

        h1 = x @ self.w1 + self.b1
        a1 = np.maximum(h1, 0)
        v1 = a1 @ self.w2 + self.b2 + x
        y = _unit(v1)
        h2 = y @ self.w3 + self.b3
        a2 = np.maximum(h2, 0)
        v2 = a2 @ self.w4 + self.b4
        g4 = through_unit(v2, out_gradient)
        g3 = (g4 @ self.w4.T) * (h2 > 0)
        g2 = through_unit(v1, g3 @ self.w3.T)
        g1 = (g2 @ self.w2.T) * (h1 > 0)
        return [x.T @ g1, g1.sum(0), a1.T @ g2, g2.sum(0), y.T @ g3, g3.sum(0), a2.T @ g4, g4.sum(0)]


def save_weights(spark: SparkSession, encoders: dict[str, Encoder], path: str) -> None:
    """Writes ``name, part, shape, data`` as parquet."""
    rows = [(name, i, list(p.shape), p.ravel().tolist()) for name, e in encoders.items() for i, p in enumerate(e.parameters())]
    spark.createDataFrame(rows, "name string, part int, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, Encoder]:
    """Weights have the size of a model, not of data, so they come to the driver."""
    parts: dict[str, dict[int, np.ndarray]] = {}
    for r in spark.read.parquet(path).collect():
        parts.setdefault(r["name"], {})[r["part"]] = np.array(r["data"]).reshape(r["shape"])
    return {name: Encoder(*(p[i] for i in range(8))) for name, p in parts.items()}


def encode(vectors: DataFrame, encoder: Encoder, vector: str, into: str = "encode") -> DataFrame:
    """Adds the encoding of each vector; null for null and for another width than the encoder's."""
    shipped = vectors.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = shipped.value
        for s in batches:
            out: list = [None] * len(s)
            ok = [i for i, v in enumerate(s) if hasattr(v, "__len__") and len(v) == len(e.w1)]
            if ok:
                x = np.stack([np.asarray(s.iloc[i], np.float64) for i in ok])
                for i, y in zip(ok, e.forward(x).astype(np.float32), strict=True):
                    out[i] = y
            yield pd.Series(out, dtype=object)

    return vectors.withColumn(into, run(F.col(vector)))


def embed(texts: DataFrame, text: str, model, into: str = "embeds") -> DataFrame:
    """Adds a pluggable model's vector of each text; ``model()`` gives a function from texts to rows of floats."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model()
        for s in batches:
            yield pd.Series(list(of(s.fillna("").tolist())))

    return texts.withColumn(into, run(F.col(text)))


def mean_windows(windows: DataFrame, doc_id: str, vector: str) -> DataFrame:
    """``doc_id, vector``: mean of a document's window vectors, a short last window counting fully."""
    each = windows.select(doc_id, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(doc_id, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vector))


def top_k(queries: DataFrame, documents: DataFrame, k: int = 10, spread: int | None = None) -> DataFrame:
    """``query_id, lang, doc_id, score, rank``: the ``k`` documents of the query's language with the highest cosine.

    queries: ``query_id, lang, vector``; documents: ``doc_id, lang, vector``. Exact: the
    queries meet each of ``spread`` parts of their language's documents, a block at a
    time, and each part sends its k best; many queries are split into rows of a grid. Zero vectors score 0; null vectors, and those of
    another width than a part's first, are left out.
    """
    return _best(_search_parts(queries, documents, k, spread), k)


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_parts(queries: DataFrame, documents: DataFrame, k: int, spread: int | None, most: int | None = None) -> DataFrame:
    """The ``k`` best of every part: ``query_id, lang, doc_id, score``; ``most``: queries that a language holds at most."""
    spread = spread or max(SPREAD, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = documents.schema["doc_id"].dataType.simpleString()
    q_ids = queries.schema["query_id"].dataType.simpleString()
    lang = documents.schema["lang"].dataType.simpleString()
    parts = F.sequence(F.lit(0), F.lit(spread - 1))
    asked = queries.where("vector is not null")
    rows = max(1, -(-(asked.count() if most is None else most) // ASKED))  # of the grid; each holds at most about ASKED queries
    row = F.sequence(F.lit(0), F.lit(rows - 1))
    asks = asked.select("lang", F.explode(parts).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("row"), F.col("query_id"), F.lit(None).cast(ids).alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(0).alias("kind"))
    docs = documents.where("vector is not null").select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("part"), F.explode(row).alias("row"), F.lit(None).cast(q_ids).alias("query_id"), "doc_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(1).alias("kind"))
    mixed = asks.unionByName(docs).repartition("lang", "part", "row").sortWithinPartitions("lang", "part", "row", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of a part come before its documents."""
        group, names, asked, best = None, [], [], None

        def done() -> pd.DataFrame | None:
            if best is None or not len(best):
                return None
            return best.assign(lang=group[0])

        def merge(b: pd.DataFrame) -> None:
            nonlocal best, asked
            if not names or not len(b):
                return
            if isinstance(asked, list):
                width = len(asked[0])
                ok = [i for i, v in enumerate(asked) if len(v) == width]
                names[:] = [names[i] for i in ok]
                asked = _unit(np.stack([asked[i] for i in ok]))
            b = b[b["vector"].map(len) == asked.shape[1]]
            for i in range(0, len(b), BLOCK):
                some = b.iloc[i : i + BLOCK]
                x = _unit(np.stack(some["vector"].values).astype(np.float64))
                new = []
                for q in range(0, len(asked), BLOCK):
                    cos = np.round(asked[q : q + BLOCK] @ x.T, DIGITS)
                    if cos.shape[1] > k:
                        edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k][:, None]
                        r, c = np.nonzero(cos >= edge)
                    else:
                        r, c = np.nonzero(np.ones_like(cos, bool))
                    new.append(pd.DataFrame({"query_id": np.array(names[q : q + BLOCK], object)[r], "doc_id": some["doc_id"].values[c], "score": cos[r, c]}))
                all_ = pd.concat(new if best is None else [best, *new])
                best = all_.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

        for batch in batches:
            for key, b in batch.groupby(["lang", "part", "row"], sort=False, dropna=False):
                if key != group:
                    if (out := done()) is not None:
                        yield out[["query_id", "lang", "doc_id", "score"]]
                    group, names, asked, best = key, [], [], None
                q = b[b["kind"] == 0]
                names += q["query_id"].tolist()
                if len(q):
                    asked = [*asked, *q["vector"]]
                merge(b[b["kind"] == 1])
        if (out := done()) is not None:
            yield out[["query_id", "lang", "doc_id", "score"]]

    return mixed.mapInPandas(run, f"query_id {q_ids}, lang {lang}, doc_id {ids}, score double")


def save_vectors(documents: DataFrame, path: str) -> None:
    """``doc_id, lang, vector`` at unit length, in a folder a language."""
    unit = documents.select("doc_id", "lang", l2_normalize(F.col("vector")).alias("vector")).where("vector is not null")
    write_by_language(unit, path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_by_language(spark, path)


def model_scores(pairs: DataFrame, query: Encoder, document: Encoder) -> DataFrame:
    """Adds ``score``, the cosine of the encodings of ``qv`` and ``dv``."""
    both = encode(encode(pairs, query, "qv", "_q"), document, "dv", "_d")
    return both.withColumn("score", cosine(F.col("_q"), F.col("_d"))).drop("_q", "_d")


def chunk_scores(scored: DataFrame, how: str = "mean") -> DataFrame:
    """Scores of chunks to one of their document: ``mean``, ``sum`` or ``max``."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return scored.groupBy("query_id", "doc_id").agg(F.round(f("score"), DIGITS + 2).alias("score"))


def candidate_chunks(near: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: all chunks of every document of which a chunk is in ``near``, scored exactly.

    near: ``query_id, lang, doc_id`` (of the document); queries: ``query_id, vector``; chunks: ``doc_id, lang,
    vector``, where a document's chunks are those with its language. Null vectors and those of another width
    than the query's are left out.
    """
    pairs = near.select("query_id", "lang", "doc_id").distinct()
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("_q"))
    own = chunks.where("vector is not null").select("lang", "doc_id", F.col("vector").cast("array<double>").alias("_d"))
    met = pairs.join(own, ["lang", "doc_id"]).join(asked, "query_id").where(F.size("_q") == F.size("_d"))
    return met.select("query_id", "doc_id", F.round(cosine(F.col("_q"), F.col("_d")), DIGITS).alias("score"))


def _probes(products: np.ndarray, probes: int) -> np.ndarray:
    """``probes`` keys a row and table: the signs of ``products`` (rows, tables, bits), then those with the surest least changed."""
    bits = products.shape[2]
    own = ((products > 0) * (1 << np.arange(bits))).sum(2)[:, :, None]
    few = min(bits, probes - 1)  # the n-th cheapest change flips none but the n - 1 least sure bits
    if not few:
        return own
    margins = np.abs(products)
    at = np.argsort(margins, axis=2, kind="stable")[:, :, :few]
    flips = (np.arange(1 << few)[:, None] >> np.arange(few)) & 1
    price = np.take_along_axis(margins, at, 2) @ flips.T
    changed = (1 << at) @ flips.T
    return own ^ np.take_along_axis(changed, np.argsort(price, axis=2, kind="stable")[:, :, :probes], 2)


def hash_neighbours(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 8, bits: int = 6, seed: int = 5, probes: int = 8) -> DataFrame:
    """``query_id, doc_id, score, rank``: approximate top k by signs of random projections, reranked exactly.

    A vector and a query are compared if in any table all ``bits`` signs of the vector agree with one of
    the query's ``probes`` likeliest keys: its own, and those that change the signs of its smallest
    products. Both have ``id, vector`` with ``dim`` numbers.
    """
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    def keys(n: int):
        @F.pandas_udf("array<long>")
        def run(s: pd.Series) -> pd.Series:
            x = np.stack(s.map(lambda v: np.asarray(v, np.float64)).values) if len(s) else np.zeros((0, dim))
            key = _probes((x @ planes.T).reshape(len(s), tables, bits), n) + (np.arange(tables) << bits)[:, None]
            return pd.Series(list(key.reshape(len(s), -1)))

        return run

    asked = queries.where("vector is not null")
    d = vectors.where("vector is not null").select(F.col("id").alias("doc_id"), "vector", F.explode(keys(1)("vector")).alias("lang"))
    q = asked.select(F.col("id").alias("query_id"), "vector", F.explode(keys(probes)("vector")).alias("lang"))
    near = _search_parts(q, d, k, 1, asked.count()).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return _best(near, k)

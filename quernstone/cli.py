"""Command line: ``python -m quernstone.cli COMMAND …``; every command reads and writes folders."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import analyze, search
from quernstone.operators import evaluate as E
from quernstone.operators import index as I
from quernstone.plans.staging import Stage
from quernstone.sources import io
from quernstone.sources.tables import ship_package


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.endswith(".json"):
        return io.read_corpus(spark, path)
    return io.read_queries(spark, path, schema or io.QUERIES) if path.endswith(".csv") else spark.read.parquet(path)


def _documents(spark: SparkSession, path: str, lang: str | None) -> DataFrame:
    df = _read(spark, path)
    df = df.withColumnRenamed("docid", "doc_id") if "docid" in df.columns else df
    return df.where(F.col("lang") == lang) if lang else df


def _queries(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = _read(spark, path, schema)
    df = df.withColumnRenamed("id", "query_id") if "id" in df.columns else df
    df = df if "query_id" in df.columns else df.withColumn("query_id", F.monotonically_increasing_id())
    return analyze.tokenize(df, "query").withColumnRenamed("tokens", "terms")


def tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = analyze.tokenize(_documents(spark, a.corpus, a.lang)).select("doc_id", "lang", "tokens")
    if a.stop_words:
        docs = analyze.remove_stop_words(docs, analyze.read_stop_words(spark, a.stop_words, a.lang))
    docs.write.mode("overwrite").partitionBy("lang").parquet(a.output)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(a.tokens)
    tf = Stage(spark, "postings").write(I.postings(docs.repartition("doc_id")), "tf")
    stats = I.stats_of(docs, tf)
    weighted = I.tfidf_index(tf, stats) if a.model == "tfidf" else I.bm25_index(tf, stats, tuned=I.TUNED)
    io.save_index(weighted, stats, a.output)
    docs.select("lang", "doc_id").write.mode("overwrite").parquet(f"{a.output}/ids")
    if a.model == "tfidf":
        I.tfidf_idf(I.document_frequency(tf), stats).write.mode("overwrite").parquet(f"{a.output}/idf")


def _ranked(spark: SparkSession, path: str, model: str, queries: DataFrame, k: int) -> DataFrame:
    stored, _ = io.load_index(spark, path)
    scored = search.tfidf_scores(stored, spark.read.parquet(f"{path}/idf"), queries) if model == "tfidf" else search.scores(stored, queries)
    return search.match(scored, queries, spark.read.parquet(f"{path}/ids"), k)


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    queries = Stage(spark, "queries").write(_queries(spark, a.queries, a.schema), "queries")
    ranked = [_ranked(spark, path, model, queries, a.k) for path, model in ((a.bm25, "bm25"), (a.tfidf, "tfidf")) if path]
    best = search.fuse(*ranked, a.k - 1, a.k) if len(ranked) == 2 else ranked[0]
    io.write_results(search.hit_list(best), a.output)


def tune(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(a.tokens)
    tf = Stage(spark, "postings").write(I.postings(docs.repartition("doc_id")), "tf")
    queries = Stage(spark, "queries").write(_queries(spark, a.queries), "queries")
    relevant = queries.select("query_id", "lang", F.col("positive_docs").alias("doc_id"))
    io.write_csv(E.bm25_grid(tf, I.stats_of(docs, tf), queries, relevant, tuple(a.k1s), tuple(a.bs), a.k), a.output)


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = _documents(spark, a.corpus, None)
    if a.sentences:
        analyze.chunk_documents(docs).write.mode("overwrite").parquet(a.output)
    else:
        io.ceil_split(docs.withColumn("text", X.clean_dense(F.col("text"))), a.num_splits).write.mode("overwrite").partitionBy("shard").parquet(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(run, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__)
        p.set_defaults(run=run)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        return p

    p = command(tokenize, "corpus", "output")
    p.add_argument("--lang")
    p.add_argument("--stop-words")
    command(index, "tokens", "output").add_argument("--model", choices=("bm25", "tfidf"), default="bm25")
    p = command(infer, "queries", "output")
    p.add_argument("--bm25")
    p.add_argument("--tfidf")
    p.add_argument("--schema")
    p.add_argument("-k", type=int, default=10)
    p = command(tune, "tokens", "queries", "output")
    p.add_argument("--k1s", type=float, nargs="+", default=E.K1_GRID)
    p.add_argument("--bs", type=float, nargs="+", default=E.B_GRID)
    p.add_argument("-k", type=int, default=10)
    p = command(chunk, "corpus", "output")
    p.add_argument("--num-splits", type=int, default=12)
    p.add_argument("--sentences", action="store_true", help="overlapping chunks at sentences instead of shards")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.run is infer and not (a.bm25 or a.tfidf):
        raise SystemExit("infer needs --bm25, --tfidf or both")
    spark = SparkSession.builder.appName("quernstone").getOrCreate()
    ship_package(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()

import json

import pytest

from quernstone import cli
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_tokenize_index_infer_tune_chunk(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    table(spark, SF, "corpus_df").dropDuplicates(["docid"]).write.parquet(at("corpus"))
    table(spark, SF, "dev").select("query_id", "query", "lang", "positive_docs").distinct().write.parquet(at("dev"))
    cli.main(["tokenize", "--corpus", at("corpus"), "--output", at("tokens")])
    for model in ("bm25", "tfidf"):
        cli.main(["index", "--tokens", at("tokens"), "--output", at(model), "--model", model])
    for name, args in (("a", ["--bm25", at("bm25")]), ("b", ["--tfidf", at("tfidf")]), ("c", ["--bm25", at("bm25"), "--tfidf", at("tfidf")])):
        cli.main(["infer", "--queries", at("dev"), "--output", at(name), *args])
        rows = spark.read.csv(at(name), header=True, escape='"').collect()
        assert rows and all(len(json.loads(r["docids"])) == len(set(json.loads(r["docids"]))) <= 10 for r in rows)
    cli.main(["tune", "--tokens", at("tokens"), "--queries", at("dev"), "--output", at("tuned"), "--k1s", "1.2", "2.0", "--bs", "0.5"])
    assert {(r["k1"], r["b"]) for r in spark.read.csv(at("tuned"), header=True).collect()} == {("1.2", "0.5"), ("2.0", "0.5")}
    cli.main(["chunk", "--corpus", at("corpus"), "--output", at("shards"), "--num-splits", "4"])
    assert spark.read.parquet(at("shards")).count() == 60 and spark.read.parquet(at("shards")).select("shard").distinct().count() == 4
    cli.main(["chunk", "--corpus", at("corpus"), "--output", at("chunks"), "--sentences"])
    assert spark.read.parquet(at("chunks")).count() >= 55
    with pytest.raises(SystemExit):
        cli.main(["infer", "--queries", at("dev"), "--output", at("x")])

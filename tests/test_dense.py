import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import vectors as V
from quernstone.operators import dense, train
from quernstone.operators.positions import positions
from quernstone.operators.ranking import ranked
from quernstone.sources import io


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        V.inner_product(F.col("a"), F.col("b")).alias("ab"), V.l2_normalize(F.col("a")).alias("u"), V.l2_normalize(F.col("z")).alias("uz"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("cz")
    ).first()
    assert row["ab"] == 24 and row["u"] == pytest.approx([0.6, 0.8]) and row["uz"] == [0, 0] and row["c"] == pytest.approx(0.96) and row["cz"] == 0


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0]), ([[1.0, 2.0]], [0.0])], "v array<array<double>>, m array<double>")
    assert [r["x"] for r in df.select(V.masked_mean(F.col("v"), F.col("m")).alias("x")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


@pytest.mark.parametrize("n,windows", [(0, 1), (3, 1), (4, 2), (6, 2), (7, 3)])
def test_windows(spark, n, windows):
    got = spark.createDataFrame([(list(range(10, 10 + n)),)], "ids array<int>").select(V.window_ids(F.col("ids"), 3, 1, 2).alias("w")).first()["w"]
    assert len(got) == windows and all(w[0] == 1 and w[-1] == 2 for w in got)
    assert [x for w in got for x in w[1:-1]] == list(range(10, 10 + n))


def test_top_k_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8)).round(1)
    x[7] = 0
    rows = [(i, "abc"[i % 3], x[i].tolist()) for i in range(300)]
    docs = spark.createDataFrame([*rows, (999, "a", None), (998, "a", [1.0])], "doc_id long, lang string, vector array<double>")
    queries = spark.createDataFrame(rows[:30], "query_id long, lang string, vector array<double>")
    got = {}
    for row in dense.top_k(queries, docs, 5, spread=4).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["doc_id"], row["score"]))
    n = np.sqrt((x * x).sum(1))
    for q in range(30):
        own = [i for i in range(300) if i % 3 == q % 3]
        cos = {i: round(float(x[q] @ x[i] / (n[q] * n[i])), 6) if n[q] * n[i] else 0.0 for i in own}
        want = sorted(own, key=lambda i: (-cos[i], i))[:5]
        assert [d for d, _ in got[q]] == want


def test_encoder_gradient():
    e = dense.Encoder.seeded(5, 7, 3)
    x, g = np.random.default_rng(2).standard_normal((4, 5)), np.random.default_rng(3).standard_normal((4, 5))
    assert np.allclose((e.forward(x) ** 2).sum(1), 1)
    grads = e.gradient(x, g)
    for p, dp in zip(e.parameters(), grads, strict=True):
        at = tuple(0 for _ in p.shape)
        keep, h = p[at], 1e-6
        p[at] = keep + h
        up = (e.forward(x) * g).sum()
        p[at] = keep - h
        down = (e.forward(x) * g).sum()
        p[at] = keep
        assert dp[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-7)


def test_contrastive_loss(spark):
    pairs = spark.createDataFrame([(1, True, 0.9), (1, False, 0.2), (1, False, -0.1), (2, True, 0.5), (2, False, 0.5), (3, False, 0.1)], "query_id int, is_positive boolean, cosine double")
    got = {r["query_id"]: round(r["loss"], 6) for r in train.contrastive_loss(pairs).collect()}
    assert got == {1: 0.622974, 2: 0.693147}


def test_training_lowers_the_loss(spark):
    r = np.random.default_rng(4)
    rows = []
    for q in range(24):
        v = r.standard_normal(6)
        rows += [(q, True, v.tolist(), (v + 0.1 * r.standard_normal(6)).tolist()), (q, False, v.tolist(), r.standard_normal(6).tolist())]
    pairs = spark.createDataFrame(rows, "query_id int, is_positive boolean, qv array<double>, dv array<double>")
    _, history = train.train(pairs, 6, hidden=8, epochs=4, rate=0.01, steps=1, validation=pairs)
    assert [h[0] for h in history] == [1, 2, 3, 4] and history[-1][1] < history[0][1] and history[0][2] is not None


def test_weights_round_trip(spark, tmp_path):
    e = dense.Encoder.seeded(4, 3, 1)
    dense.save_weights(spark, {"query": e}, str(tmp_path / "w"))
    back = dense.load_weights(spark, str(tmp_path / "w"))["query"]
    assert all(np.array_equal(a, b) for a, b in zip(e.parameters(), back.parameters(), strict=True))


def test_upsample(spark):
    rows = spark.createDataFrame([("en", i) for i in range(7)] + [("fr", i) for i in range(3)] + [("ko", 0)], "lang string, query_id long")
    up = train.upsample(rows)
    assert {r["lang"]: r["count"] for r in up.groupBy("lang").count().collect()} == {"en": 7, "fr": 7, "ko": 7}
    assert up.where("copy = 0").count() == 11


def test_shards(spark):
    for n, floor, ceil in ((10, [2, 2, 2, 4], [3, 3, 3, 1]), (3, [0, 0, 0, 3], [1, 1, 1, 0])):
        rows = spark.createDataFrame([("en", i) for i in range(n)], "lang string, doc_id long")
        for got, want in ((io.floor_split(rows, 4), floor), (io.ceil_split(rows, 4), ceil)):
            sizes = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
            assert [sizes.get(i, 0) for i in range(1, 5)] == want


def test_positions_and_ranks(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS id", "if(id % 3 = 0, null, id % 3) AS g")
    assert [r["position"] for r in positions(rows, "id").orderBy("id").collect()] == list(range(1000))
    places = ranked(rows, ["g"], ["id"], seed=5)
    for r in places.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m"), F.min("place").alias("s")).collect():
        assert r["n"] == r["d"] == r["m"] + 1 and r["s"] == 0
    assert places.columns == ["id", "g", "place"]


def test_hash_neighbours_find_copies(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, rows[0][1])], "id long, vector array<double>")
    got = dense.hash_neighbours(df, df.where("id < 3"), 4, 16, tables=6, bits=3)
    best = {x["query_id"]: (x["doc_id"], x["score"]) for x in got.where("rank = 1").collect()}
    assert best == {0: (0, 1.0), 1: (1, 1.0), 2: (2, 1.0)}
    assert (100, 1.0) in {(x["doc_id"], x["score"]) for x in got.where("query_id = 0").collect()}
    assert got.groupBy("query_id", "doc_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("how", ["mean", "sum"])
def test_all_chunks_of_candidates_count(spark, how):
    """Against numpy: the 100 best chunks choose the documents, and all their chunks of the language are scored."""
    from quernstone.plans import retrieval

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], object), np.array([r[2] for r in rows])
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    want, cut = {}, 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        own = np.nonzero(labels == labels[q])[0]
        score = np.round(x[own] @ x[q], 6)
        best = np.argsort(-score, kind="stable")[:100]
        for doc in set((ids[own[best]] // 4).tolist()):
            s = score[ids[own] // 4 == doc]
            cut += len(s) > (ids[own[best]] // 4 == doc).sum()
            want[int(ids[q]), doc] = s.mean() if how == "mean" else s.sum()
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.queries()[f"chunk_to_doc_{how}_full"](spark, d).collect()}
    assert cut > 0 and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_hash_neighbours_recall(spark):
    """Of the 10 nearest on the whole table, for the registered query."""
    from quernstone.plans import retrieval

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    asked = np.nonzero(ids % 20 == 0)[0]
    best = np.argsort(-np.round(x[asked] @ x.T, 6), axis=1, kind="stable")[:, :10]
    want = {(int(ids[q]), int(ids[j])) for q, near in zip(asked, best, strict=True) for j in near}
    got = {(r["query_id"], r["doc_id"]) for r in retrieval.queries()["hash_neighbours"](spark, d).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in io.last_wins(rows, "k", "t").collect()} == {"a": "y", "b": None}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"docid": "d1", "text": "a\\nb", "lang": "en"}, {"docid": "d2", "text": "", "lang": "fr"}]')
    assert io.read_corpus(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "q.csv").write_text("query,lang,positive_docs,negative_docs\n\"say \"\"hi\"\"\nthere\",en,d1,\"['a', 'b']\"\n")
    assert io.read_queries(spark, str(tmp_path / "q.csv")).first()["query"] == 'say "hi"\nthere'
    hits = spark.createDataFrame([(1, ["a", "b"])], "query_id int, docids array<string>")
    io.write_results(hits, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()["docids"] == '["a","b"]'
    (tmp_path / "t.csv").write_text("lang,k1,b,recall@10\nen,1.4,0.5,0.8\n")
    assert io.read_tuning(spark, str(tmp_path / "t.csv")).first()["recall@10"] == 0.8

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.operators import evaluate as E
from quernstone.operators import index as I
from quernstone.operators import search
from quernstone.plans import retrieval
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("en", "d1", list("abbc")), ("en", "d2", list("ac")), ("en", "d3", ["d"]), ("en", "d4", []), ("fr", "d5", list("ab"))]
    return spark.createDataFrame(rows, "lang string, doc_id string, tokens array<string>")


@pytest.fixture(scope="module")
def tf(corpus):
    return I.postings(corpus).cache()


def ask(spark, *queries):
    return spark.createDataFrame([(i, "en", q.split()) for i, q in enumerate(queries)], "query_id int, lang string, terms array<string>")


def test_bm25_weights(corpus, tf):
    index = I.bm25_index(tf, I.corpus_stats(corpus)).where("lang = 'en'")
    got = {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in index.collect()}
    assert got == {("d1", "a"): 0.439098, ("d1", "b"): 1.217012, ("d1", "c"): 0.439098, ("d2", "a"): 0.651279, ("d2", "c"): 0.651279, ("d3", "d"): 1.491648}


def test_statistics_agree(corpus, tf):
    a, b = ({r["lang"]: (r["n_docs"], r["avgdl"]) for r in x.collect()} for x in (I.corpus_stats(corpus), I.stats_of(corpus, tf)))
    assert a == b == {"en": (4, 1.75), "fr": (1, 2.0)}


def test_match_pads_and_doubles(spark, corpus, tf):
    queries = ask(spark, "b", "b b zzz", "a c", "zzz")
    index = I.bm25_index(tf, I.corpus_stats(corpus))
    got = {}
    for r in search.match(search.scores(index, queries), queries, corpus).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got[0] == [("d1", 1.217012), ("d2", 0), ("d3", 0), ("d4", 0)]
    assert got[1][0] == ("d1", 2.434024)
    assert got[2] == [("d2", 1.302558), ("d1", 0.878196), ("d3", 0), ("d4", 0)]
    assert got[3] == [("d1", 0), ("d2", 0), ("d3", 0), ("d4", 0)]


def test_pessimistic_rank(spark, corpus, tf):
    queries = ask(spark, "b", "a c")
    stats = I.corpus_stats(corpus)
    scored = search.scores(I.bm25_index(tf, stats), queries)
    for doc, ranks in {"d1": (1, 2), "d2": (4, 1), "d3": (4, 4), "d4": (4, 4)}.items():
        got = E.pessimistic_ranks(scored, queries.select("query_id", "lang", F.lit(doc).alias("doc_id")), stats)
        assert tuple(r["score_rank"] for r in got.orderBy("query_id").collect()) == ranks


def test_tfidf(spark, corpus, tf):
    stats = I.corpus_stats(corpus)
    index = I.tfidf_index(tf, stats)
    got = {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in index.where("lang = 'en'").collect()}
    assert got == {("d1", "a"): 0.235702, ("d1", "b"): 0.942809, ("d1", "c"): 0.235702, ("d2", "a"): 0.707107, ("d2", "c"): 0.707107, ("d3", "d"): 1.0}
    idf = I.tfidf_idf(I.document_frequency(tf), stats)
    scored = search.tfidf_scores(index, idf, ask(spark, "b", "a c"))
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in scored.collect()} == {(0, "d1"): 0.942809, (1, "d2"): 1.0, (1, "d1"): 0.333333}
    norms = {r["doc_id"]: round(r["norm"], 6) for r in I.tf_norms(corpus, tf).where("lang = 'en'").collect()}
    assert norms == {"d1": 2.44949, "d2": 1.414214, "d3": 1.0, "d4": 0.0}


@pytest.mark.parametrize("second,expected", [([f"b{i}" for i in range(1, 10)], [f"b{i}" for i in range(1, 11)]), (["x", "y", *[f"b{i}" for i in range(1, 8)]], [*[f"b{i}" for i in range(1, 10)], "x"]), (["b10", "x"], [f"b{i}" for i in range(1, 11)])])
def test_fusion(spark, second, expected):
    make = lambda ids: spark.createDataFrame([(1, "en", d, i) for i, d in enumerate(ids, 1)], "query_id int, lang string, doc_id string, rank int")
    fused = search.fuse(make([f"b{i}" for i in range(1, 11)]), make(second))
    assert [r["doc_id"] for r in fused.orderBy("rank").collect()] == expected
    assert search.hit_list(fused).first()["docids"] == expected


def test_bm25_equals_plain_python(spark):
    docs = [(r["doc_id"], r["lang"], r["tokens"]) for r in retrieval._docs(spark, SF).collect()]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25_scores(spark, SF).collect()}
    want = {}
    for lang in {x[1] for x in docs}:
        own = {i: t for i, x, t in docs if x == lang}
        df = Counter(w for t in own.values() for w in set(t))
        mean = sum(map(len, own.values())) / len(own)
        for q, t in own.items():
            if q % 20 == 0:
                for i, words in own.items():
                    counts = Counter(words)
                    s = sum(math.log((len(own) - df[w] + 0.5) / (df[w] + 0.5) + 1) * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in t[2:8] if w in counts)
                    if any(w in counts for w in t[2:8]):
                        want[q, i] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("block", [1, 40, 1_000_000])
def test_best_scores_hold_every_top_k(spark, monkeypatch, block):
    """In parts and blocks of any size, ties and repeated terms included, the k best are those of all scores."""
    monkeypatch.setattr(search, "BLOCK", block)
    rows = [(["en", "fr", None][i % 3], 1000 - i, f"t{(i * j) % 7}", float((i * j) % 3 + 1)) for i in range(60) for j in range(1, 5)]
    index = spark.createDataFrame(rows, "lang string, doc_id long, term string, weight double").groupBy("lang", "doc_id", "term").agg(F.max("weight").alias("weight"))
    queries = spark.createDataFrame([("a", "en", ["t1", "t2", "t2"]), ("b", "en", ["t9"]), ("c", "fr", ["t0", "t3", "t9"]), ("d", "fr", []), ("e", "de", ["t1"])], "query_id string, lang string, terms array<string>")
    want = search.top_k(search.scores(index, queries), 4)
    got = search.top_k(search.best_scores(index, queries, 4, spread=3), 4)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert search.best_scores(index, queries.where("false"), 4).count() == search.best_scores(index.where("false"), queries, 4).count() == 0


def test_grid_and_best(spark, corpus, tf):
    queries = ask(spark, "b", "a c")
    relevant = queries.select("query_id", "lang", F.lit("d1").alias("doc_id"))
    grid = E.bm25_grid(tf, I.corpus_stats(corpus), queries, relevant, (1.2, 1.1), (0.0, 1.0), k=1)
    assert grid.count() == 4
    best = E.best_parameters(grid).first()
    assert best["grid_pos"] == min(r["grid_pos"] for r in grid.collect() if abs(r["recall"] - best["recall"]) < 1e-9)


def test_full_grid(spark):
    """All points of the reference's grid, equal to the small one where both have a point; the best of all is taken."""
    Q = retrieval.queries()
    full = {(r["lang"], r["k1"], r["b"]): r for r in Q["bm25_grid_full"](spark, SF).collect()}
    few = {(r["lang"], r["k1"], r["b"]): r["recall"] for r in Q["bm25_grid"](spark, SF).collect()}
    langs = {lang for lang, _, _ in few}
    assert full.keys() == {(lang, k1, b) for lang in langs for k1 in E.K1_GRID for b in E.B_GRID} and len(E.K1_GRID) * len(E.B_GRID) == 110
    assert all(p in E.K1_GRID and b in E.B_GRID for p, b in I.TUNED.values())
    assert {p: full[p]["recall"] for p in few} == few
    best = {r["lang"]: (r["recall"], r["grid_pos"]) for r in Q["best_params_full"](spark, SF).collect()}
    assert best == {lang: (x["recall"], x["grid_pos"]) for lang in langs for x in [min((r for r in full.values() if r["lang"] == lang), key=lambda r: (-r["recall"], r["grid_pos"]))]}


def test_empty_inputs(spark, corpus, tf):
    none = ask(spark, "a").where("false")
    index = I.bm25_index(tf, I.corpus_stats(corpus))
    assert search.match(search.scores(index, none), none, corpus).count() == 0
    empty = corpus.where("false")
    assert I.bm25_index(I.postings(empty), I.corpus_stats(empty)).count() == 0
    assert E.recall_at_k(spark.createDataFrame([], "lang string, rank long"), 10, "lang").count() == 0


def test_streamed_answers_equal_batch(spark):
    a, b = (sorted(map(tuple, f(spark, SF).select("query_id", "doc_id", "score", "rank").collect())) for f in (retrieval.passage_search, retrieval.stream_passage_search))
    assert a == b


def test_tables_exist(spark):
    assert table(spark, SF, "documents").count() == 100

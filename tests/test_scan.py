"""Scores added up where the documents lie are those of the joins, whatever the blocks and lots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import blocks, scan, search
from quernstone.operators import evaluate as E
from quernstone.operators import index as I
from quernstone.plans import retrieval

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    """Documents of two languages with common and rare terms, ties, an empty one; queries with repeated, unknown and no terms."""
    rng = np.random.default_rng(3)
    rows = [(["en", "fr"][i % 2], f"d{i:03}", [f"t{int(x)}" for x in rng.zipf(1.4, i % 9) if x < 30]) for i in range(120)]
    asked = [(i, ["en", "fr", "de"][i % 3 if i < 30 else 0], [f"t{int(x)}" for x in rng.zipf(1.3, 4) if x < 40] if i else []) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, doc_id string, tokens array<string>")
    queries = spark.createDataFrame(asked, "query_id int, lang string, terms array<string>")
    tf, stats = I.postings(docs).cache(), I.corpus_stats(docs).cache()
    return docs, queries, tf, stats, I.packed(docs).cache()


@pytest.fixture(params=[(1, 7), (60, 1000), (10**6, 15)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", request.param[0])
    monkeypatch.setattr(scan, "LOT", request.param[1])


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_packed_rows_are_postings(world):
    _, _, tf, _, packed = world
    cols = ("lang", "doc_id", "dl", "term", "tf")
    assert rows(I.unpacked(packed), *cols) == rows(tf, *cols) != []
    assert rows(I.packed_stats(world[0], packed), "lang", "n_docs", "avgdl") == rows(world[3], "lang", "n_docs", "avgdl")


def test_grid_counts_the_same(world, sizes):
    _, queries, tf, stats, packed = world
    relevant = queries.select("query_id", "lang", F.format_string("d%03d", F.col("query_id") * 2).alias("doc_id"))
    cols = ("lang", "grid_pos", "k1", "b", "recall", "k")
    got, want = scan.grid(packed, stats, queries, relevant, (1.2, 2.0), (0.0, 0.75, 1.0), 5), E.bm25_grid(tf, stats, queries, relevant, (1.2, 2.0), (0.0, 0.75, 1.0), 5)
    assert rows(got, *cols) == rows(want, *cols) != []


def moved_by_term(df):
    """Exchanges that hash postings by their term, as a join of postings and queries needs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "term#" in x]


@pytest.mark.parametrize("name", ["bm25_grid_full", "accuracy_tfidf", "bm25_match_and_eval", "passage_search", "bm25_top_k_padded", "fused_top_k", "bm25_grid"])
def test_no_meeting_moves(spark, name):
    """What a query and a document give stays in its task; only sums a query leave it."""
    assert moved_by_term(retrieval.queries()[name](spark, SF)) == []


@pytest.mark.parametrize("unit", [False, True])
@pytest.mark.parametrize("k", [1, 4, None])
def test_best_are_those_of_all_scores(world, sizes, unit, k):
    docs, queries, tf, stats, packed = world
    want = search.tfidf_scores(I.tfidf_index(tf, stats), I.tfidf_idf(I.document_frequency(tf), stats), queries) if unit else search.scores(I.bm25_index(tf, stats), queries)
    got, cols = scan.best(packed, stats, queries, k, unit), ("query_id", "lang", "doc_id", "score")
    if k is None:
        assert rows(got, *cols) == rows(want, *cols) != []
    else:
        assert rows(search.top_k(got, k), *cols, "rank") == rows(search.top_k(want, k), *cols, "rank") != []


def test_ranks_count_the_same(world, sizes):
    _, queries, tf, stats, packed = world
    relevant = queries.select("query_id", "lang", F.format_string("d%03d", F.col("query_id") * 2).alias("doc_id"))
    cols = ("query_id", "lang", "score", "score_rank")
    want = E.pessimistic_ranks(search.scores(I.bm25_index(tf, stats), queries), relevant, stats)
    assert rows(scan.ranks(packed, stats, queries, relevant), *cols) == rows(want, *cols) != []


def test_many_words_of_a_corpus(world, monkeypatch):
    """Cosines need every word; where these are too many for the tasks, joins give the same."""
    _, queries, _, stats, packed = world
    cols = ("query_id", "lang", "doc_id", "score", "rank")
    few = rows(search.top_k(scan.best(packed, stats, queries, 3, True), 3), *cols)
    monkeypatch.setattr(scan, "MOST_WORDS", 5)
    assert rows(search.top_k(scan.best(packed, stats, queries, 3, True), 3), *cols) == few


def test_norms_by_slices_of_words(spark, world, monkeypatch):
    """However many words a corpus has, no posting is joined to its term's weight."""
    _, queries, tf, stats, packed = world
    monkeypatch.setattr(scan, "MOST_WORDS", 4)
    assert moved_by_term(scan.best(packed, stats, queries, 3, True)) == []
    idf = I.tfidf_idf(I.document_frequency(tf), stats)
    weighted = tf.join(idf.select("lang", "term", "idf"), ["lang", "term"])
    want = weighted.groupBy("lang", "doc_id").agg(F.round(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))), 9).alias("norm"))
    assert rows(scan.with_norms(packed, idf).withColumn("norm", F.round("norm", 9)), "lang", "doc_id", "norm") == rows(want, "lang", "doc_id", "norm") != []


def test_saved_index_moves_no_posting(spark, monkeypatch):
    """Weights are told where the documents lie, whatever the slices of words."""
    want = rows(retrieval.queries()["bm25_saved_index"](spark, SF), "query_id", "lang", "doc_id", "score", "rank")
    monkeypatch.setattr(I, "with_idf", None)  # joins postings to their words
    monkeypatch.setattr(scan, "MOST_WORDS", 500)
    assert rows(retrieval.queries()["bm25_saved_index"](spark, SF), "query_id", "lang", "doc_id", "score", "rank") == want != []


def test_stored_weights_are_those_of_the_index(world, tmp_path):
    _, queries, tf, stats, packed = world
    idf, tuned = I.bm25_idf(I.document_frequency(tf), stats), {"en": (1.1, 0.3)}
    index = scan.with_weights(packed, stats, idf, tuned)
    got = index.select("lang", "doc_id", F.inline(F.arrays_zip("terms", "weights"))).select("lang", "doc_id", F.col("terms").alias("term"), F.round("weights", 9).alias("weight"))
    assert rows(got, "lang", "doc_id", "term", "weight") == rows(I.bm25_index(tf, stats, tuned=tuned).withColumn("weight", F.round("weight", 9)), "lang", "doc_id", "term", "weight") != []


def of_pairs(df, *names):
    """Exchanges of the plan behind which rows are scored."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange " in x and any(f"{c}#" in x for c in names)]


@pytest.mark.parametrize("block,lot,cells", [(1, 15, 300), (60, 1000, 1), (10**6, 1000, 10**7)])
def test_rankings_are_those_of_a_join(world, monkeypatch, block, lot, cells):
    """Every document of a query's language, empty ones and those of languages and queries without a known word too, in order; no pair moves."""
    docs, queries, tf, stats, packed = world
    for name, size in (("BLOCK", block), ("LOT", lot), ("CELLS", cells), ("SENT", 50)):
        monkeypatch.setattr(scan, name, size)
    bare = docs.sparkSession.createDataFrame([("it", "e2", []), ("it", "e1", []), (None, "n", ["t1"])], docs.schema)
    more = docs.sparkSession.createDataFrame([(90, "it", ["t1"]), (91, "it", []), (92, None, ["t1"])], queries.schema)
    docs, queries = docs.unionByName(bare), queries.unionByName(more)
    stats, packed, cols = I.corpus_stats(docs), I.packed(docs), ("query_id", "lang", "doc_id", "score", "rank")
    got, want = scan.rankings(packed, stats, queries, docs), search.match_all(search.scores(I.bm25_index(I.postings(docs), stats), queries), queries, docs)
    assert rows(got, *cols) == rows(want, *cols) != []
    assert [x for x in got.dtypes if x[0] in cols] == [(c, t) for c in cols for x, t in want.dtypes if x == c]
    assert of_pairs(want, "query_id") and of_pairs(got, "query_id") == []


@pytest.mark.parametrize("name", ["bm25_full_ranking", "bm25_scores"])
def test_no_pair_moves(spark, name):
    got = retrieval.queries()[name](spark, SF)
    assert of_pairs(got, "query_id", "doc_id") == []


def test_grid_scores_few_at_all_points(monkeypatch):
    """One bound over all points leaves out what can't reach a query's own document; counts stay those of every document scored at every point."""
    rng, points = np.random.default_rng(7), [(k1, b) for k1 in (1.2, 1.5, 2.0) for b in (0.0, 0.75, 1.0)]
    n_docs, n_words = 400, 60
    pairs = np.unique(rng.integers(0, n_docs, 9000) * n_words + (rng.zipf(1.2, 9000) - 1) % n_words)
    doc, word, tf = pairs // n_words, pairs % n_words, rng.integers(1, 6, len(pairs)).astype(float)
    length, idf = rng.uniform(0.2, 3, n_docs), rng.uniform(0.1, 6, n_words)
    asks = blocks.Asks(np.arange(0, 101 * 4, 4), np.concatenate([rng.choice(n_words, 4, False) for _ in range(100)]), rng.integers(1, 3, 400).astype(float))
    k1, b = np.array(points).T
    each = np.zeros((n_docs, n_words, len(points)))
    each[doc, word] = idf[word][:, None] * tf[:, None] * (k1 + 1) / (tf[:, None] + k1 * (1 - b + b * length[doc][:, None]))
    scores = np.round(np.stack([(each[:, asks.word[4 * q : 4 * q + 4]] * asks.times[4 * q : 4 * q + 4, None]).sum(axis=1) for q in range(100)]), 6)
    least = np.stack([scores[q, np.argsort(-scores[q, :, 4])[rng.integers(0, 60)]] for q in range(100)])
    least[least <= 0] = np.inf
    want = {q: x.tolist() for q in range(100) if (x := (scores[q] >= least[q]).sum(axis=0)).any()}
    block, seen = blocks.Block.of(word, doc, tf, n_words, n_docs), []
    reach = blocks.reach
    monkeypatch.setattr(blocks, "reach", lambda *a: (seen.append(len(x[1])) or x for x in reach(*a)))
    assert {q: x.tolist() for q, x in blocks.reach_grid(block, length, idf, points, asks, least)} == want != {}
    assert 0 < sum(seen) < 0.7 * (scores > 0).any(axis=2).sum()
    for k in (0, 3, 10):
        got = {q: np.minimum(x, k + 1).tolist() for q, x in blocks.reach_grid(block, length, idf, points, asks, least, k)}
        assert got == {q: np.minimum(x, k + 1).tolist() for q, x in want.items()}

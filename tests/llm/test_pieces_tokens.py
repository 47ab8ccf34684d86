import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import budget, pieces
from quernstone.llm.tokens import BytePairs, Pieces, chunked, count_tokens
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.01"
VOCAB = [(0, "[PAD]", True), (1, "[CLS]", True), (2, "[SEP]", True), (3, "[UNK]", False), (5, "\n", False), (6, "▁", False), (7, ".", False), (8, "▁a", False), (9, "b", False), (10, "7", False), (11, "▁ab", False), (12, "»", False), (13, "c", False)]


@pytest.fixture(scope="module")
def small():
    return Pieces(VOCAB)


@pytest.fixture(scope="module")
def real(spark):
    return Pieces.of(table(spark, SF, "vocab"))


def test_longest_piece_from_the_left(small):
    assert small.tokens("ab a zz") == 1 + 1 + 3  # ▁ab, ▁a, ▁ and two unknown characters
    assert small.tokens("a\na\n\n") == 5 and small.tokens("  ") == 0


def test_counts_equal_the_given_tokens(spark, real):
    """Texts recounted by the vocabulary agree with every item that has tokens."""
    items = budget.real_tokens(table(spark, SF, "token_dataset"), real, ("item_id", "q_id")).where("n_tokens is not null")
    texts = table(spark, SF, "corpus_df").where("text is not null").dropDuplicates(["docid"])
    counted = count_tokens(texts, "docid", "text", lambda: real).withColumnRenamed("n_tokens", "m")
    rows = items.join(counted, F.col("q_id") == F.col("docid")).select("n_tokens", "m").collect()
    assert len(rows) > 400 and all(r["n_tokens"] == r["m"] for r in rows)


def test_byte_pairs_add_up():
    t = BytePairs()
    texts = ["Hello  world", " a\n\n\nb  c\t d", "don't stop—it's  1234 5", "\x1c\x1d x \x85y", "가나다 라마\r\n  مرحبا", "x" * 3000, "", "   ", "a b c  "]
    r = random.Random(2)
    texts += ["".join(r.choice("ab 1\n\t.'é가 ") for _ in range(60)) for _ in range(300)]
    for s in texts:
        assert t.tokens(s) == len(t.encoding.encode_ordinary(s)), repr(s)


def test_chunks_add_up(spark, real):
    text = ("the old observatory\ndescribed  twelve wooden boats " * 400) + "y" * 5000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "docid long, text string")
    cut = chunked(df, "docid", "text", 1000).collect()
    assert "".join(r["chunk"] for r in sorted(cut, key=lambda r: r["chunk_no"]) if r["docid"] == 1) == text
    assert sum(real.tokens(r["chunk"]) for r in cut if r["docid"] == 1) == real.tokens(text)
    assert {r["docid"] for r in cut} == {1, 4} and max(len(r["chunk"]) for r in cut) >= 5000


def test_item_tokens(spark, small):
    kind = "item_id long, q_id string, lang string, tokens struct<input_ids:array<int>,attention_mask:array<int>>, source string, n_tokens string, docid string"
    rows = [(1, "a", "en", ([1, 8, 9, 2, 0], None), "s", None, None), (1, "a", "en", ([1, 8, 9, 2, 0], None), "s", None, None), (2, "b", None, None, None, None, None), (3, "c", "fr", None, "s", None, None), (4, "zz", "fr", None, "t", None, None), (5, "b", "en", (None, None), "s", None, None), (6, None, None, None, None, None, None), (7, "a", "en", ([1, None, 99], None), "s", None, None), (8, "e", "en", None, "s", None, None), (9, "a", "en", ([], None), "s", None, None)]
    items = spark.createDataFrame(rows, kind)
    texts = spark.createDataFrame([("b", "ab a"), ("b", "ab a"), ("c", None), ("e", ""), ("x", "a" * 10)], "docid string, text string")
    got = {r["item_id"]: (r["n_tokens"], r["estimated"]) for r in budget.item_tokens(items, texts, small, F.col("lang")).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (None, True), 4: (None, True), 5: (2, True), 6: (None, True), 7: (1, False), 8: (0, True), 9: (0, False)}
    sources = spark.createDataFrame([("s", "news"), ("s", "news"), ("t", None)], "source string, domain string")
    totals = budget.totals(budget.item_tokens(items, texts, small, F.col("lang")), sources)
    assert {(r["source"], r["lang"]): (r["domain"], r["n_items"], r["n_tokens"], r["n_estimated"]) for r in totals.collect()}[("s", "en")] == ("news", 5, 5, 2)
    assert {r["name"]: r["n_items"] for r in budget.rollup(totals).where("slice = 'all'").collect()} == {"all": 9}
    assert budget.totals(budget.item_tokens(items.where("false"), texts, small, F.col("lang")), sources).count() == 0


def marks(p):
    return pieces.Marks(p)


def test_boundaries(small):
    # a . b | a 7.7 a . » a \n \n a
    ids = np.array([8, 7, 9, 8, 10, 7, 10, 8, 7, 12, 8, 5, 5, 8])
    at, strength = pieces.boundaries(ids, marks(small))
    assert at.tolist() == [10, 12, 13, 14] and strength.tolist() == [pieces.SENTENCE, pieces.LINE, pieces.PARAGRAPH, pieces.PARAGRAPH]


@pytest.mark.parametrize("seed", range(25))
def test_cut_properties(small, seed):
    r = random.Random(seed)
    ids = []
    while len(ids) < r.choice([5, 300, 1500, 6000]):
        ids += [8] + [9] * r.choice([0, 3, 12, 40, 700 if seed % 5 == 0 else 20]) + r.choice([[7], [5], [7, 5, 5], [7]])
    ids, m = np.array(ids), marks(small)
    found, longest = pieces.cut(ids, m)
    stops, _ = pieces.boundaries(ids, m)
    assert longest == max(np.diff(stops, prepend=0))
    assert [s for s, *_ in found] == [0, *[e for _, e, *_ in found[:-1]]] and found[-1][1] == len(ids)
    natural = set(stops.tolist())
    for i, (s, e, shared, strength) in enumerate(found):
        assert e - s + shared <= 510 and shared == min(64, s) and (i == 0) == (s == 0)
        assert (e in natural) == (strength != pieces.FORCED)
    if longest <= 446:
        assert all(k != pieces.FORCED for *_, k in found)
    for (s, _, shared, k), (_, e, _, _) in zip(found, found[1:], strict=False):
        assert e - s + shared > 510 or len(ids) <= 510, "neighbours that fit are merged"


def test_split_items(spark, small):
    long = [1] + ([8, 9, 7] * 400) + [2, 0, 0]
    rows = [(1, (long, None), 5), (1, (long, None), 5), (2, None, 5), (3, (None, None), 5), (4, ([], None), 5), (5, ([1, 2], None), 5), (6, ([8] * 511, None), 5), (7, ([8] * 510, None), 5), (8, ([8, None, 4000, -1], None), 5), (None, ([8], None), 5)]
    items = spark.createDataFrame(rows, "item_id long, tokens struct<input_ids:array<int>,attention_mask:array<int>>, piece_no int")
    got = {}
    for r in pieces.split_items(items, small, with_ids=True).dropDuplicates(["item_id", "piece_no"]).orderBy("item_id", "piece_no").collect():
        got.setdefault(r["item_id"], []).append(r)
    assert set(got) == {1, 4, 5, 6, 7, 8}
    assert {i: (x[0]["cut_kind"], x[0]["n_item_tokens"]) for i, x in got.items()} == {1: ("natural", 1200), 4: ("whole", 0), 5: ("whole", 0), 6: ("forced", 511), 7: ("whole", 510), 8: ("whole", 3)}
    back = [t for r in got[1] for t in r["input_ids"][r["n_shared"] :]]
    assert back == [t for t in long if t > 2]
    assert got[1][1]["input_ids"][:64] == got[1][0]["input_ids"][-64:]
    assert pieces.split_items(items.where("false"), small).count() == 0
    with pytest.raises(ValueError):
        pieces.split_items(items, small, limit=100, overlap=60)

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import overlap as O
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.01"
Q = "how do we know that the grain market repaired the signal tower 805 years after Cinullum left Comjornarorb"


def pairs_of(df_train, df_eval):
    return {(r["train_id"], r["eval_id"]): r for r in O.expand(*O.same_questions(df_train, df_eval)).collect()}


def frames(spark, train, evaluation):
    return spark.createDataFrame(train, "query_id long, query string, source string, class string"), spark.createDataFrame(evaluation, "query_id long, query string, source string, split string, words string")


@pytest.mark.parametrize(
    "other,same",
    [
        (Q, True),
        (Q.upper() + "??", True),
        ("“" + Q.title() + "”", True),
        (Q.replace(" market", " - market;"), True),
        (Q.replace("market", "mar­ket​"), True),
        (Q.replace("grain", "grian").replace("signal", "signall"), True),
        (Q.replace("that the", "that"), True),
        ("actually, " + Q, True),
        (" ".join(reversed(Q.split())), True),
        (Q.replace("é", "e"), True),
        (Q.replace("805", "806"), False),
        (Q.replace("Cinullum", "Hufenes"), False),
        (Q.replace("repaired", "inherited"), False),
        (Q.replace("signal tower", "paper mill"), False),
    ],
)
def test_compare(other, same):
    assert (O.compare(O.bag(Q), O.bag(other)) is not None) == same


def test_digits_and_accents():
    assert O.bag("Écôle ١٢٣") == O.bag("ecole 123") and O.numbers(O.bag("in 1882년에 12")) == "12 1882"


def test_slips():
    for a, b, n in (("saline", "salnie", 1), ("spring", "sprig", 1), ("abc", "abc", 0), ("tisssage", "tissage", 1), ("abcd", "wxyz", 3), ("", "abc", 3)):
        assert O.slips(a, b) == n


def test_bucket_recall():
    """Bags with a similarity of 0.8 or more share a bucket."""
    r = np.random.default_rng(0)
    signer, hit, total = O.Signer(), 0, 0
    for _ in range(200):
        words = ["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(14)]
        other = [*words[:-1], words[-1][:-1]]
        if O.jaccard(words, other) >= 0.8:
            with np.errstate(over="ignore"):
                a, b = signer.keys([words, other], np.zeros(2, np.uint64))[0][:, : O.BANDS]
            hit, total = hit + bool((a == b).any()), total + 1
    assert total > 150 and hit >= 0.99 * total


def test_against_all_pairs(spark):
    train = table(spark, SF, "train")
    dev = table(spark, SF, "dev").selectExpr("*", "'dev' AS split")
    got = set(pairs_of(train, dev))
    a = {r["query_id"]: O.bag(r["query"]) for r in train.collect() if r["query"]}
    b = {r["query_id"]: O.bag(r["query"]) for r in dev.collect() if r["query"]}
    by = {}
    for i, w in a.items():
        by.setdefault(O.numbers(w), []).append(i)
    often = Counter(w for x in {tuple(x) for x in [*a.values(), *b.values()]} for w in set(x))
    sure = lambda x: x is not None and all(p in O.SMALL if not q else min(often[p], often[q]) < O.RARE for p, q in x)
    want = {(i, j) for j, w in b.items() if w for i in by.get(O.numbers(w), ()) if sure(O.compare(a[i], w))}
    assert want <= got and len(want) > 20
    assert all(O.compare(a[i], b[j]) for i, j in got - want) and len(got - want) <= 0.05 * len(got)


def met(bags, signer):
    keys, ends = O.buckets(bags, signer)
    return bool(np.intersect1d(keys[: ends[0]], keys[ends[0] :]).size)


def slip(r, w):
    i, kind = int(r.integers(0, len(w))), int(r.integers(0, 4))
    c = "abcdefghijklmnopqrstuvwxyz"[r.integers(0, 26)]
    return [w[:i] + c + w[i:], w[:i] + w[i + 1 :] if len(w) > 1 else w + c, w[:i] + c + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]][kind]


@pytest.mark.parametrize("n", [3, 4, 5, 6, 8, 12, 16])
def test_recall_by_length(n):
    """Pairs with two slips and a small word more are met and taken for the same, however short."""
    r, vocabulary = np.random.default_rng(n), [w for w in re.findall("[a-z]+", " ".join(open(O.__file__, encoding="utf-8").read().lower().split())) if len(w) > 2]
    signer, found, total = O.Signer(), 0, 300
    for _ in range(total):
        words = [str(w) for w in r.choice(vocabulary, n)]
        other = list(words)
        for i in r.integers(0, n, 2):
            other[i] = slip(r, other[i])
        bags = [O.bag(" ".join(words)), O.bag(" ".join([*other, "really"]))]
        found += met(bags, signer) and O.similar(*bags) is not None
    assert found >= 0.95 * total


def test_spaces_set_otherwise():
    a = O.bag("what is the capital of france 12")
    for other in ("whatisthecapitaloffrance12", "w h a t i s t h e c a p i t a l o f f r a n c e 12", "what isthe cap ital of france 12", "thecapital of france what is 12"):
        b = O.bag(other)
        if O.numbers(a) == O.numbers(b):
            assert O.similar(a, b) is not None, other
        assert met([a, b], O.Signer())
    assert not O._spaced(["ab", "ab"], ["aabb"])
    assert not O._spaced(["ab"] * 40, ["ba"] * 40)  # ends soon


def test_other_nouns_and_names_make_another_question(spark):
    train = [(i, f"who sells the {w} number {n}", "s", None) for i, (n, w) in enumerate(itertools.product(range(10), ("car", "cart", "state", "estate")))]
    train += [(700, "who directed the film titanic", "s", None), (701, "best cheap hotels in paris", "s", None), (702, "please who painted the old bridge", "s", None)]
    asked = ["who sells the car number 3", "who sells the estate number 4", "who directed the film", "best hotels in paris", "who painted the old bridge"]
    a, b = frames(spark, train, [(900 + i, q, "s", "dev", None) for i, q in enumerate(asked)])
    assert set(pairs_of(a, b)) == {(12, 900), (19, 901), (702, 904)}


def test_common_words_make_another_question(spark):
    # رمم and صمم are one letter apart and both common
    verbs = ["رمم", "صمم", "باع", "نقل"]
    train = [(i, f"هل صحيح أن المرصد {v} البرج رقم {n}", "s", None) for i, (n, v) in enumerate(itertools.product(range(100, 140), verbs[:3:2]))]
    train += [(500 + i, f"متى {v} النادي {n}", "s", None) for i, (n, v) in enumerate(itertools.product(range(10), verbs))]
    a, b = frames(spark, train, [(900, "هل صحيح أن المرصد صمم البرج رقم 105", "s", "dev", None), (901, "هل صحيح أن المرصد رمم البرج رقم 105", "s", "dev", None)])
    assert {j for _, j in pairs_of(a, b)} == {901}


def test_defined_results(spark):
    train = [(1, Q, "a", None), (1, Q, "a", None), (2, Q.upper(), None, None), (3, None, "a", None), (4, "", "a", None), (5, "!!", "a", None), (None, Q, "a", None), (6, Q.replace("805", "9") + " x" * 3000, "a", None)]
    evaluation = [(11, Q + "?", "b", "dev", None), (11, Q + "?", "b", "dev", None), (12, None, "b", "dev", None), (13, "?", None, "test", None), (14, Q.replace("grain", "grrain"), None, "test", None)]
    a, b = frames(spark, train, evaluation)
    pairs, members = O.same_questions(a, b)
    assert {(r["train_id"], r["eval_id"]) for r in O.expand(pairs, members).where("train_id is not null").collect()} == {(1, 11), (2, 11), (1, 14), (2, 14)}
    got = {(r["split"], r["source"]): (r["n_records"], r["n_overlapping"], r["n_pairs"]) for r in O.report(pairs, members).collect()}
    assert got[("dev", "b")] == (1, 1, 2) and got[("test", None)] == (1, 1, 2)
    assert pairs_of(a.where("false"), b) == {} and pairs_of(a, b.where("false")) == {}


def test_hot_question(spark):
    """One question holds a third of train."""
    train = [(i, Q if i % 3 == 0 else f"who says that the club {i} moved the boats near Narullum {i * 7}", "s", None) for i in range(3000)]
    a, b = frames(spark, train, [(9000 + i, Q.title(), "s", "dev", None) for i in range(5)])
    pairs, members = O.same_questions(a, b)
    assert pairs.count() == 1 and O.expand(pairs, members).count() == 5000
    assert O.report(pairs, members).first()["n_pairs"] == 5000


def test_short_questions_with_two_slips(spark):
    """All pairs are found, though bands and similarity miss many; so is one with a word more, above the length."""
    r = np.random.default_rng(8)
    abc = list("abcdefghijklmnopqrstuvwxyz")
    train, dev = [], []
    for i in range(300):
        words = ["".join(r.choice(abc, 5)) for _ in range(4)]
        other = [w[:2] + ("x" if w[2] != "x" else "y") + w[3:] if j < 2 else w for j, w in enumerate(words)]
        train.append((i, " ".join(words), None))
        dev.append((1000 + i, " ".join([*other, "please"] if i % 2 else other), None, "dev"))
    pairs, members = O.same_questions(spark.createDataFrame(train, "query_id long, query string, source string"), spark.createDataFrame(dev, "query_id long, query string, source string, split string"))
    got = {(x["train_id"], x["eval_id"]) for x in O.expand(pairs, members).collect()}
    assert got == {(i, 1000 + i) for i in range(300)}

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import analyze

LEXICAL = [
    ("caf\xe9!!!! x", "caf\xe9 x"),
    ("مُح ًًًً a", "مُح a"),
    ("a\xa0b  c", "a b c"),
    ("ń́́́ q", "n q"),
    ("a\x1c\x1cb", "a b"),
    ("**** ----abc____", "abc____"),
    ("\xbd\xb2① a", "\xbd\xb2① a"),
    ("x!!!y", "x!!!y"),
    ("see http://a.b/c?d=1 next www.x.y z", "see next z"),
    ("HTTP://A.b c", "http://a.b c"),
    (None, ""),
    ("", ""),
]


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_clean_lexical(spark):
    df = spark.createDataFrame(list(enumerate(x for x, _ in LEXICAL)), "i int, x string")
    got = {r["i"]: r["y"] for r in df.select("i", X.clean_lexical(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(LEXICAL))] == [y for _, y in LEXICAL]


def test_clean_dense_keeps_case_and_short_runs(spark):
    assert one(spark, X.clean_dense, "A  !!!! b ********** C") == "A !!!! b C"


def test_cleaning_equals_a_scan(spark):
    parts = ["a", "É", "_", "9", " ", "\t", "\x1c", "\xa0", "!", "?", "#", "·", "́", "http://x.y", "www.", "ß"]
    texts = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=14))
    def collect(xs):
        texts.append("".join(xs))

    collect()

    def kind(c):
        return "space" if c.isspace() else "word" if c.isalnum() or c == "_" else "symbol"

    def scanned(s):
        """Character by character: addresses first, then runs of one kind."""
        kept, i = "", 0
        while i < len(s):
            head = next((h for h in ("https://", "http://", "www.") if s.startswith(h, i)), "")
            rest = s[i + len(head) :].split(maxsplit=1)
            if head and rest and not s[i + len(head)].isspace():
                kept, i = kept + " ", i + len(head) + len(rest[0])
            else:
                kept, i = kept + s[i], i + 1
        runs = [(k, "".join(g)) for k, g in itertools.groupby(kept, kind)]
        return " ".join("".join(" " if k == "symbol" and len(r) > 3 else r for k, r in runs).split()).lower()

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", X.clean_lexical(F.col("x")).alias("y")).collect():
        assert r["y"] == scanned(r["x"]), repr(r["x"])


def test_arabic(spark):
    assert one(spark, X.normalize_arabic, "الْكِتَابُ، كتـــاب!") == "الكتاب كتاب"


def test_words_and_lists(spark):
    assert one(spark, X.split_words, "a_b, c-d  é9") == ["a_b", "c", "d", "é9"]
    assert one(spark, X.split_spaces, "  a  b ") == ["a", "b"]
    assert one(spark, X.parse_list, "['doc-en-1', 'doc-fr-22']") == ["doc-en-1", "doc-fr-22"]
    assert one(spark, X.parse_list, "[]") == [] and one(spark, X.parse_list, None) == []


BOUNDS = [
    (0, [], []),
    (1, [], [(0, 1)]),
    (270, [], [(0, 270)]),
    (271, [], [(0, 270), (140, 271)]),
    (600, [], [(0, 270), (140, 410), (280, 550), (420, 600)]),
    (600, [150, 255], [(0, 256), (151, 421), (291, 561), (431, 600)]),
    (250, [245], [(0, 246), (116, 250)]),
    (300, [239], [(0, 270), (140, 300)]),
    (300, [240], [(0, 241), (111, 300)]),
]


@pytest.mark.parametrize("n,stops,expected", BOUNDS)
def test_chunk_bounds(n, stops, expected):
    assert analyze.chunk_bounds([f"w{i}." if i in stops else f"w{i}" for i in range(n)]) == expected


def test_chunks_cover_every_word(spark):
    words = [f"w{i}" + "." * (i % 11 == 0) for i in range(1500)]
    bounds = analyze.chunk_bounds(words)
    assert set(range(1500)) == {i for a, b in bounds for i in range(a, b)}
    with pytest.raises(ValueError):
        analyze.chunk_bounds(words, 100, 80, 30)
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in analyze.chunk_documents(df).collect()} == {1}


def test_stop_words_keep_duplicates(spark):
    docs = spark.createDataFrame([("en", ["the", "cat", "the", "cat"]), ("xx", ["the"]), (None, ["the"])], "lang string, tokens array<string>")
    got = analyze.remove_stop_words(docs, analyze.stop_word_table(spark)).collect()
    assert sorted((r["lang"] or "", r["tokens"]) for r in got) == [("", ["the"]), ("en", ["cat", "cat"]), ("xx", ["the"])]


def test_compounds(spark):
    split = lambda c: analyze.split_compounds(c, analyze.halves_at_vowels)
    parts = one(spark, split, ["haus", "apfelbaum"], "array<string>")
    assert parts[0] == "haus" and "".join(parts[1:]) == "apfelbaum" and len(parts) > 1


def test_lexical_words_are_those_of_the_cleaned_text(spark):
    odd = [None, "", "  ", "....", "a....b -- c", "see https://a.b/c?d=e now", "wwwx www.x.y z", "http:/x HTTPS://Y.Z/w", "ΑΣ....Β ΟΔΟΣ ΣΑΣ", "ΑΣ'Β ΑΣ", "İstanbul İX Straße", "a b c\x1cd\u0085e", "été 한국어 ஜா", "_x_ 1²½ 𝒳𝟘 😀😀😀😀b", "a\u0000b\n\tc"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    got = df.select("i", X.lexical_words(F.col("x")).alias("a"), X.split_words(X.clean_lexical(F.col("x"))).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and any(r["a"] for r in got)

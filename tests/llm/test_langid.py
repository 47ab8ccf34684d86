import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import langid as L
from quernstone.llm.labels import code_of
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    codes = table(spark, SF, "languages")
    corpus = table(spark, SF, "corpus_df").select(F.col("docid").alias("rec_id"), code_of(F.col("lang"), codes).alias("label"), "text")
    return [(r["label"], r["text"]) for r in corpus.dropDuplicates(["rec_id"]).orderBy("rec_id").collect() if r["text"]]


@pytest.fixture(scope="module")
def model(rows):
    return L.fit_models(rows[::2])


def test_held_out_accuracy(rows, model):
    held = [(lang, t) for lang, t in rows[1::2] if lang in L.LANGUAGES and t.strip()]
    langs, _, _ = L.Reader(model).languages([t for _, t in held])
    single = [(a, b) for (a, _), b in zip(held, langs, strict=True) if len(b) == 1]
    # a few percent of the labels are wrong on purpose
    assert sum(a == b[0] for a, b in single) >= 0.93 * len(single)


def test_mixed_texts(rows, model):
    r = random.Random(1)
    by = {}
    for lang, t in rows:
        if lang in L.LANGUAGES and len(t.split()) > 40:
            by.setdefault(lang, []).append(" ".join(t.split()[:30]))
    right = total = 0
    for _ in range(60):
        a, b = r.sample(sorted(by), 2)
        x, y = r.choice(by[a]), r.choice(by[b])
        found = L.Reader(model).languages([f"{x} {y}"])[0][0]
        right += set(found) == {a, b}
        total += 1
    assert right >= 0.85 * total


def test_segments(spark, model, rows):
    en = next(t for lang, t in rows if lang == "en" and len(t.split()) > 40)
    fr = next(t for lang, t in rows if lang == "fr" and len(t.split()) > 40)
    df = spark.createDataFrame([("m", f"{en}\n{fr}", 1), ("n", None, 1), ("e", " ", 1), ("u", "12 #33 55/7", 1)], "rec_id string, text string, seg_no int")
    got = L.segments(df, model).orderBy("rec_id", "seg_no").collect()
    assert [(r["rec_id"], r["lang"]) for r in got if r["rec_id"] == "u"] == [("u", "und")]
    mixed = [r for r in got if r["rec_id"] == "m"]
    assert mixed[0]["lang"] == "en" and mixed[-1]["lang"] == "fr"
    assert " ".join(r["segment"] for r in mixed).split() == f"{en} {fr}".split()
    assert {r["rec_id"] for r in got} == {"m", "u"}


def test_defined_results(spark, model):
    long = "the old observatory described the reading room near the station. " * 5000
    rows = [("a", "en", "the river council opened the winter garden", "z"), ("a", "en", "the river council opened the winter garden", "z"), ("b", None, "the river council opened the winter garden", None), ("c", "fr", "the river council opened the winter garden", None), ("d", "en", None, None), ("e", "en", "", None), ("f", "en", "44 #9 7:30", None), ("g", "en", long, None)]
    df = spark.createDataFrame(rows, "rec_id string, label string, text string, langs string")
    got = {r["rec_id"]: (r["langs"], r["problem"]) for r in L.relabel(df, model).collect()}
    assert got == {"a": (["en"], None), "b": (["en"], "missing"), "c": (["en"], "wrong"), "f": (["und"], "wrong"), "g": (["en"], None)}
    assert L.relabel(df.where("false"), model).count() == 0


def test_score(model):
    words = ["the", "river"]
    s, n = model.score(words)
    assert s.shape == (2, len(model.langs)) and (s < 0).all() and n.tolist() == [4, 6]
    en = model.langs.index("en")
    assert (s[:, en] == s.max(1)).all()


@pytest.mark.parametrize("context", ["", "h", "hel", "hell", "shel", "lo", "x", "hx", "hallo"])
def test_model_sums_to_one(context):
    """Over all characters that may follow a context, at the start of a word too, the probabilities in a language sum to 1."""
    small = {"a": Counter({"hello": 5, "help": 2, "shell": 1, "lo": 9}), "b": Counter({"hallo": 3, "hilfe": 1})}
    m = L.KneserNey.fit(small, ("a", "b"))
    abc = sorted({c for words in small.values() for w in words for c in w})
    p, at, _ = m.each([context + c for c in [*abc, "ж"]])
    after = np.exp(p[at + len(context) + 1].astype(float))
    p, at, _ = m.each([context])
    end = np.exp(p[at + len(context) + 1].astype(float))[0]
    assert after[:-1].sum(0) + end + 3 * (len(abc) + 1) * after[-1] == pytest.approx(np.ones(2), abs=1e-5)


@pytest.mark.parametrize("text,langs", [("der Leuchtturm wurde the night ferry", ["de", "en"]), ("the river le jardin d'hiver", ["en", "fr"]), ("la escuela the garden was closed", ["es", "en"])])
def test_short_quotation_in_a_short_sentence(spark, model, text, langs):
    """There is no least number of words for a stretch of another language."""
    got = L.segments(spark.createDataFrame([("a", text)], "rec_id string, text string"), model).orderBy("seg_no").collect()
    assert [r["lang"] for r in got] == langs


def test_no_training_rows():
    m = L.fit_models([])
    assert L.Reader(m).languages(["some words"])[0] == [["und"]]


def test_label_spellings(spark):
    codes = table(spark, SF, "languages")
    cases = {"en": "en", " EN ": "en", "en_US": "en", "en-GB": "en", "eng": "en", "English": "en", "ENGLISH": "en", "Français": "fr", "한국어": "ko", "العربية": "ar", "??": None, "-": None, "": None, " ": None, None: None, "und": None, "Unknown": None, "n/a": None, "nl": "nl", "klingon": "klingon", "zh-Hant-TW": "zh"}
    df = spark.createDataFrame([(k,) for k in cases], "lang string").select("lang", code_of(F.col("lang"), codes).alias("code"))
    assert {r["lang"]: r["code"] for r in df.collect()} == cases
    assert df.count() == len(cases)


def test_fold():
    assert L.fold("Éa") == "ea" and L.fold("ß") == "ss" and L.words_of("l'eau,") == ["l", "eau"] and L.words_of("BVV-83") == [] and L.words_of("http://a.b") == []


def test_sample_is_bounded(spark):
    df = spark.range(1000).selectExpr("id AS rec_id", "if(id % 3 = 0, 'en', 'fr') AS c", "'text' AS text")
    got = L.sample(df, "rec_id", F.col("c"), "text", 20, ("en", "fr"))
    assert len(got) == 40 and got == L.sample(df.repartition(7), "rec_id", F.col("c"), "text", 20, ("en", "fr"))
    assert np.unique([lang for lang, _ in got]).tolist() == ["en", "fr"]


def same_models(a, b):
    assert a.keys.tolist() == b.keys.tolist() and np.array_equal(a.logp, b.logp) and np.allclose(a.limit, b.limit, atol=1e-6)


def test_models_are_fitted_on_all_records(spark):
    """Words of no 150 records of a label and table alone: each of 3,000 records counts, repeated rows once."""
    r = random.Random(5)
    letters = {"en": "abcdeimnrst", "de": "aeghilnrstuz"}
    vocabulary = {lang: ["".join(r.choices(abc, k=6)) for _ in range(400)] for lang, abc in letters.items()}
    rows = [(f"r{i}", lang := ["en", "de"][i % 2], " ".join(r.choices(vocabulary[lang], k=12)) + f". {''.join(r.choices('jqxyvw', k=7))}") for i in range(3000)]
    df = spark.createDataFrame([*rows, *rows[:300], ("e", "en", ""), ("n", None, "abc"), ("x", "xx", "abc")], "rec_id string, label string, text string")
    got, want = L.fit_records(df.repartition(3)), L.fit_models([(lang, t) for _, lang, t in rows])
    same_models(got, want)
    s, n = got.score(vocabulary["en"])
    assert (-s[:, got.langs.index("en")] / n <= got.limit[got.langs.index("en")]).mean() >= 0.95


def test_query_models_know_every_labelled_record(spark):
    from quernstone.llm import queries as Q

    records, got = Q._labelled(spark, SF)
    once = records.where(F.col("label").isin(*L.LANGUAGES) & (F.length("text") > 0)).groupBy("tbl", "rec_id").agg(F.min(F.struct("label", "text")).alias("x")).collect()
    same_models(got, L.fit_models([(r["x"]["label"], r["x"]["text"]) for r in once]))


def by_patterns(chunk):
    """``words_of`` with nothing told beforehand."""
    if any(map(str.isdigit, chunk)) or "://" in chunk or chunk.startswith("www.") or "@" in chunk:
        return []
    return L._WORD.findall(chunk)


def test_words_with_a_mark_behind():
    """What needs no pattern has the words, and ends of sentences, that patterns find."""
    heads = ["a", "l'eau", "été", "한국", "سلام", "www", "b2", "x_y", "", "²", "a.b", "é"]
    chunks = [x for h in heads for m in ("", *".,!?;:…؟)\"", ".,", "..") if (x := h + m)]
    for c in chunks:
        assert L.words_of(c) == by_patterns(c), c
    counts = L.WordCounts(("en",), None)
    counts._learn(chunks)
    words, at = list(counts.word), 0
    for i, c in enumerate(chunks):
        parts = L._SENTENCE.split(c)
        want = [(L.fold(w), k) for k, part in enumerate(parts) for w in by_patterns(part)]
        inside = slice(counts.first[i], counts.first[i] + counts.size[i])
        assert [(words[w], k) for w, k in zip(counts.inside[inside], counts.after[inside], strict=True)] == want and counts.breaks[i] == len(parts) - 1, c
        at += len(want)
    assert at == len(counts.inside)


def test_plain_words_need_no_pattern(monkeypatch, model):
    monkeypatch.setattr(L, "_SENTENCE", None)
    monkeypatch.setattr(L, "_WORD", None)
    counts = L.WordCounts(("en",), None)
    counts.add(np.array([0]), ["The river, the garden. It opened!"])
    assert dict(zip(counts.word, counts.times[0].tolist(), strict=True)) == {"the": 2, "river": 1, "garden": 1, "it": 1, "opened": 1}
    assert L.Reader(model).languages(["The river, the garden was opened. It was closed!"])[0] == [["en"]]


@pytest.mark.parametrize("step", [1, 2, 1000])
def test_texts_are_told_alike_in_steps_of_any_size(monkeypatch, rows, model, step):
    texts = ["", "44 #9", *[t for _, t in rows[:12]], "der Leuchtturm wurde the night ferry", ""]
    want = [tuple(x[0] for x in L.Reader(model).languages([t])) for t in texts]
    monkeypatch.setattr(L, "STEP", step)
    assert list(zip(*L.Reader(model).languages(texts), strict=True)) == want
    assert want[0] == want[-1] == want[1] == (["und"], [0.0], [0.0])
    assert L.Reader(model).languages([]) == ([], [], [])


def test_path_over_words():
    """The best of all paths, by brute force."""
    r = np.random.default_rng(2)
    reader = L.Reader(L.KneserNey.fit({"a": Counter({"x": 1}), "b": Counter({"y": 1})}, ("a", "b", "c")))
    for n in (1, 2, 6):
        for _ in range(30):
            ll = r.uniform(-20, 0, (n, 3)).astype(np.float32)
            cost = lambda path: -ll[np.arange(n), path].astype(float).sum() + L.SWITCH_COST * np.count_nonzero(np.diff(path))  # noqa: B023, E731
            assert cost(reader._viterbi(ll)) == pytest.approx(min(cost(np.array(p)) for p in itertools.product(range(3), repeat=n)))

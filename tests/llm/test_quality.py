from collections import Counter

import numpy as np
import pytest

from quernstone.llm import quality as Q
from quernstone.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def profiles(spark):
    return Q.fit_profiles(table(spark, SF, "documents"), table(spark, SF, "languages"))


SENTENCES = "The river council opened the winter garden near the station. According to the old observatory, the night ferry sold twelve wooden boats."
ITEMS = ["The paper mill", "a box of lenses", "The signal tower", "The brass instruments", "the tide tables", "A copper map"]
CASES = {
    SENTENCES: "prose",
    SENTENCES.upper(): "prose",
    SENTENCES.lower().replace(".", ""): "prose",
    "1. " + SENTENCES.replace(". ", ".\n2. "): "prose",
    SENTENCES + "\n" + "\n".join(f"- {x}" for x in ITEMS[:2]): "prose",
    SENTENCES + "\nhttp://a.invalid/b?c=1": "prose",
    "\n".join(ITEMS): "list",
    "\n".join(f"{i}) {x}" for i, x in enumerate(ITEMS)): "list",
    " • ".join(ITEMS): "list",
    ", ".join(ITEMS): "list",
    "\n".join(f"{x} ............ {i}" for i, x in enumerate(ITEMS)): "list",
    "\n".join(f"- {x} / the old timetable" for x in ITEMS): "list",
    "\n".join(f"| {x} | {i} | 3{i} % |" for i, x in enumerate(ITEMS)): "table",
    "\n".join(f'"{x}","{i}.5","2001-01-0{i}"' for i, x in enumerate(ITEMS)): "table",
    "\n".join(f"{x}\t{i}\t\t7" for i, x in enumerate(ITEMS)): "table",
    "\n".join(f"{x:28}{i:9}   the mill" for i, x in enumerate(ITEMS)): "table",
    "store! boats! " * 40: "junk",
    " ".join(SENTENCES.replace(" ", "")): "junk",
    "c5 47 ca db f7 a4 5c 5c 76 44\n82 87 30 16 5f e0 00 aa b1 02": "junk",
    "%s {{title}} &amp; [object] NaN undefined &#x2f; <null> $VAR_5 " * 6: "junk",
    "<_;~/@:$:%\\<_^>/%| <*_>;:_ ;#*;+:/>=_&#": "junk",
    "qjl srkdez jrasfkrf aqsktgxk vfwa fwhd cbaervclqzezc alasqfdkkqfb": "junk",
    SENTENCES.replace("e", "é").encode().decode("latin1"): "junk",
}


def test_kinds(spark, profiles):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in Q.statistics(df, profiles).collect()}
    wrong = {t[:60]: (got[i], k) for i, (t, k) in enumerate(CASES.items()) if got[i] != k}
    assert not wrong, wrong


def test_numbers(spark, profiles):
    df = spark.createDataFrame([(1, "The mill, the mill.\nno end"), (2, None), (3, " \n"), (4, ""), (5, "!!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.statistics(df, profiles).collect()}
    r = got[1]
    assert r["n_words"] == 6 and r["mean_word_length"] == pytest.approx(19 / 6) and r["end_punctuation_share"] == 0.5
    assert r["symbol_ratio"] == pytest.approx(2 / 21) and 0 < r["common_word_share"] <= 1
    assert all(got[i]["n_words"] == 0 and got[i]["kind"] is None for i in (2, 3, 4)) and got[5]["kind"] == "junk"


def test_edges(spark, profiles):
    long = (SENTENCES + " ") * 3000
    different = " ".join(f"The river council opened the garden of Street number {i} near the old mill of {chr(97 + i % 26)}{i}." for i in range(20000))
    df = spark.createDataFrame([(1, different, "x"), (1, different, "x"), (2, long, "y"), (None, SENTENCES, None)], "doc_id long, text string, kind string")
    got = Q.statistics(df, profiles).collect()
    assert len(got) == 4 and {r["kind"] for r in got if r["doc_id"] == 1} == {"prose"}
    assert [r["kind"] for r in got if r["doc_id"] == 2] == ["junk"]  # the same words over and over
    assert Q.statistics(df.where("false"), profiles).count() == 0


def test_no_profiles(spark):
    none = Q.fit_profiles(spark.createDataFrame([], "text string, lang string"), table(spark, SF, "languages"))
    row = Q.statistics(spark.createDataFrame([(1, SENTENCES)], "doc_id long, text string"), none).first()
    assert row["nearest_lang"] is None and row["word_divergence"] == 1.0


def test_divergence():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert Q.divergence(p, p) == 0 and Q.divergence(p, q) == pytest.approx(0.5) and Q.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


def test_profiles_count_all_documents(spark, profiles):
    texts = [r["text"] for r in table(spark, SF, "documents").where("lang = 'en' and text is not null").select("text").collect()]
    every = sum((Q.words_of(t) for t in texts), Counter())
    at = profiles.words["en"].index("the")
    assert profiles.share["en"][at] == pytest.approx(every["the"] / every.total())
    assert profiles.share["en"].sum() == pytest.approx(1) and set(profiles.words["en"]) <= profiles.known


def test_words_and_ends():
    assert Q.words_of("Don't STOP_x 12a ², ½Ⅷ été") == Counter(["don", "t", "stop", "x", "a", "²", "½ⅷ", "été"])
    assert [Q.ends_sentence(x) for x in ("", "a.", 'a."', "a”", "a!)", "a")] == [False, True, True, False, True, False]


def test_the_nearest_profile_decides(spark, profiles):
    """Other profiles of the kinds, or of the languages, give other kinds."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    fitted = Q.fit_kinds(Q.measure(df, profiles))
    kinds = lambda p, k: {r["doc_id"]: r["kind"] for r in Q.statistics(df, p, kinds=k).collect()}
    true = kinds(profiles, fitted)
    order = fitted.names
    swapped = Q.Kinds(fitted.classes, dict(zip(order, fitted.spread[[1, 0, 2, 3]], strict=True)), dict(zip(order, fitted.far, strict=True)))
    assert kinds(profiles, swapped) != true
    undecided, half = np.array([[0.5, 0.5, 0, 0]] * 2), dict(zip(order, map(tuple, fitted.spread), strict=True))
    k = Q.Kinds(fitted.classes, half, Q.DIVERGENCES)
    assert [order[i] for i in k.of(undecided, np.array([[0.1, 0.02], [0.45, 0.6]]))] == ["prose", "list"]  # words and characters decide
    foreign = Q.Profiles({"xx": {"zzz": 0.5}}, {"xx": (0.2, 0.3)}, profiles.known)
    far = [r["word_divergence"] for r in Q.statistics(df, foreign).collect()]
    assert np.mean(far) > np.mean([r["word_divergence"] for r in Q.statistics(df, profiles).collect()]) + 0.05

"""Per-language analysis of texts: words, stop-words, stems, compound parts, chunks."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X

#: A few function words of each language; pass a fuller table where it matters.
STOP_WORDS = {
    "en": "a an and at by for in is it near of on that the to was were who with",
    "fr": "a au aux dans de des du en est et la le les par pour près que qui sur un une",
    "de": "am an auf bei das dass dem den der die ein eine einen es für im in und von zu zum",
    "es": "a al con de del el en la las lo los para por que se un una y",
    "it": "a al alla che con da dal del della di e gli ha i il in la le lo nel per si un una",
    "ar": "أن إلى بين على عن في كان ما مع من هل و",
    "ko": "그 것을 누가 및 수 이 있었나",
}


@dataclass(frozen=True)
class Analyzer:
    """How one language's texts become terms: ``clean`` and ``split`` are expressions, ``lemma`` maps a word's Column."""

    clean: Callable[[Column], Column] = X.clean_lexical
    split: Callable[[Column], Column] = X.split_words
    lemma: Callable[[Column], Column] | None = None

    def terms(self, text: Column) -> Column:
        plain = self.clean is X.clean_lexical and self.split is X.split_words
        words = X.lexical_words(text) if plain else self.split(self.clean(text))
        if self.lemma is None:
            return words
        return F.filter(F.transform(words, self.lemma), lambda w: w != "")


ANALYZERS = {"ar": Analyzer(clean=X.normalize_arabic)}
PLAIN = Analyzer()


def tokenize(documents: DataFrame, text: str = "text", lang: str = "lang", analyzers: dict[str, Analyzer] | None = None) -> DataFrame:
    """Adds ``tokens``: the terms of each text by its language's analyzer, duplicates and order kept."""
    chosen = PLAIN.terms(F.col(text))
    for code, analyzer in (ANALYZERS if analyzers is None else analyzers).items():
        chosen = F.when(F.col(lang) == code, analyzer.terms(F.col(text))).otherwise(chosen)
    return documents.withColumn("tokens", chosen)


def stop_word_table(spark: SparkSession, words: dict[str, str] | None = None) -> DataFrame:
    """``lang, word`` rows."""
    rows = [(lang, w) for lang, line in (words or STOP_WORDS).items() for w in line.split()]
    return spark.createDataFrame(rows, "lang string, word string")


def read_stop_words(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """One word a line, for one language; empty lines are dropped."""
    return spark.read.text(path).where("value <> ''").select(F.lit(lang).alias("lang"), F.col("value").alias("word")).distinct()


def remove_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Filters ``tokens`` by the language's words, duplicates and order kept.

    stop_words: ``lang, word``, grouped into one row a language; languages are few, so
    that table is joined by broadcast if it is small.
    """
    lists = stop_words.groupBy(F.col("lang").alias("_lang")).agg(F.collect_set("word").alias("_stop"))
    joined = tokens.join(lists, tokens["lang"] == lists["_lang"], "left")
    kept = F.filter("tokens", lambda w: ~F.coalesce(F.array_contains(F.col("_stop"), w), F.lit(False)))
    return joined.withColumn("tokens", kept).drop("_lang", "_stop")


def split_compounds(tokens: Column, split: Callable[[Column], Column], longer_than: int = 5) -> Column:
    """Replaces words longer than ``longer_than`` by their parts."""
    return F.flatten(F.transform(tokens, lambda w: F.when(F.length(w) > longer_than, split(w)).otherwise(F.array(w))))


def halves_at_vowels(word: Column) -> Column:
    """Parts of a word, cut behind a vowel that a consonant and a vowel follow; a stand-in for hyphenation."""
    return F.split(F.regexp_replace(word, "([aeiouyäöü])([^aeiouyäöü][aeiouyäöü])", "$1\u0001$2"), "\u0001")


def chunk_bounds(words: list[str], size: int = 270, overlap: int = 130, trim: int = 30) -> list[tuple[int, int]]:
    """Half-open word ranges of overlapping chunks that prefer to begin and end at sentences.

    A chunk spans ``size`` words. If a sentence ends within the first ``trim`` words (not in the first
    chunk), the chunk begins behind it; if the last sentence's end leaves at most ``trim`` words of
    ``size``, the chunk ends there. The next chunk begins ``overlap`` words before that end.
    """
    if not 0 <= overlap < size - trim + 1 - trim:
        raise ValueError("the overlap is too large for the chunk")
    ends = [i for i, w in enumerate(words) if w.endswith((".", "!", "?"))]  # rising, so a range of them is found by halving
    n, start, out = len(words), 0, []
    while start < n:
        if start:
            at = bisect.bisect_left(ends, start)
            if at < len(ends) and ends[at] - start < trim:
                start = ends[at] + 1
                if start >= n:
                    break
        end = start + size
        at = bisect.bisect_left(ends, end) - 1
        if at >= 0 and ends[at] > start and end - ends[at] <= trim:
            end = ends[at] + 1
        out.append((start, min(end, n)))
        if end >= n:
            break
        start = end - overlap
    return out


def chunk_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 270, overlap: int = 130, trim: int = 30) -> DataFrame:
    """``doc_id, chunk_no, start_word, end_word, chunk`` of the densely cleaned texts; an empty text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b[doc_id], b["_clean"], strict=True):
                words = t.split(" ") if t else []
                rows += [(i, no, s, e, " ".join(words[s:e])) for no, (s, e) in enumerate(chunk_bounds(words, size, overlap, trim), 1)]
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_no", "start_word", "end_word", "chunk"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, X.clean_dense(F.col(text)).alias("_clean")).mapInPandas(run, f"`{doc_id}` {kind}, chunk_no int, start_word int, end_word int, chunk string")


def subword_ids(texts: DataFrame, doc_id: str, text: str, encode: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """``doc_id, ids``: ids of a pluggable tokenizer without special tokens; ``encode`` makes it in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = encode()
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], "ids": [of(t) if t else [] for t in b[text]]})

    kind = texts.schema[doc_id].dataType.simpleString()
    return texts.select(doc_id, text).mapInPandas(run, f"`{doc_id}` {kind}, ids array<int>")

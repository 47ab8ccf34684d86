"""Problem 2: the language of each record, and of each stretch of a mixed one.

Interpolated Kneser-Ney character models, one per language, over the letters of a word
between its edges. All models share one sorted array of n-gram hashes; a row of the table
beside it holds the log probability in every language, so that one binary search serves
all. A word whose best cross-entropy a character is above a calibrated limit belongs to no
language (invented names, codes). A stretch gets the language with the least length-
normalised cross-entropy over its words.

The models are fitted on all labelled records: words are counted where the texts lie, and what
is common in a language, vocabularies, reaches the driver.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.plans.staging import Stage, checked_broadcast, spread

LANGUAGES = ("ar", "de", "en", "es", "fr", "it", "ko")
ORDER = 5
PER = 300  # records of a language, of which counts are told if it has more
MIN_RECORDS = 3  # a word in fewer of ``PER`` records of a language, or of all if these are fewer, isn't learned
MOST_REPEATED = 1_000_000  # ids of repeated records that are broadcast
NAME_COST = 8.0  # words lost that an invented name counted as a word is worth, when the limits are set
SHORT, SHORT_LIMIT = 3, 3.5  # words of so few letters tell little a character; this is their limit
MIN_SHARE = 0.2  # of the words of any language: a language with less isn't one of the text's
HOME_BONUS = 3.0  # nats by which a stretch keeps to the text's main language
SWITCH_COST = 9.0  # nats for changing the language inside a stretch; one that loses no more to a single language can't gain by it
MOST_KNOWN = 400_000  # words that a worker remembers before it starts afresh
STEP = 1000  # texts whose words are looked up at once

_START, _END = 1, 2
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?؟…]")
_ENDS = re.compile(r"[.!?…؟。:;/|–—«»“”\"]")
_SENTENCE_MARKS, _MARKS = frozenset(".!?؟…"), frozenset(".!?؟…,;:")  # behind a word
_PRIME = 0x100000001B3


def fold(word: str) -> str:
    """Lower case without accents; Hangul becomes its letters."""
    s = word.casefold()
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKD", s)
    return s if s.isascii() else "".join(c for c in s if not unicodedata.combining(c))


def words_of(chunk: str) -> list[str]:
    """The words in a stretch without spaces; one with a digit or an address has none."""
    if chunk.isalpha():
        return [chunk]
    if chunk[-1:] in _MARKS and chunk[:-1].isalpha() and chunk != "www.":
        return [chunk[:-1]]
    if any(map(str.isdigit, chunk)) or "://" in chunk or chunk.startswith("www.") or "@" in chunk:
        return []
    return _WORD.findall(chunk)


class KneserNey:
    """``logp``: rows of n-grams, columns of languages; ``gamma``: what a context leaves to the next shorter one; ``floor``: an
    unknown character; ``limit``: most nats a character of a word. In every language the probabilities after a context sum to
    1 over ``4 * alphabet`` characters, three quarters of which no word has.
    """

    def __init__(self, langs: tuple[str, ...], keys: np.ndarray, logp: np.ndarray, gamma: np.ndarray, floor: np.ndarray, limit: np.ndarray):
        self.langs, self.keys, self.logp, self.gamma, self.floor, self.limit = langs, keys, logp, gamma, floor, limit

    @classmethod
    def fit(cls, counts: dict[str, Counter], langs: tuple[str, ...]) -> KneserNey:
        """counts: for each language its folded words and how often each occurs."""
        rows: dict[tuple[int, ...], int] = {}
        raw = [defaultdict(float) for _ in langs]
        for j, lang in enumerate(langs):
            for word, n in counts.get(lang, {}).items():
                s, weight = (_START, *map(ord, word), _END), 1 + math.log2(n)
                for i in range(1, len(s)):
                    for k in range(1, min(ORDER, i + 1) + 1):
                        raw[j][s[i - k + 1 : i + 1]] += weight
        rows[_START,] = 0  # a context, though never predicted
        for r in raw:
            for g in r:
                rows.setdefault(g, len(rows))
        grams = sorted(rows, key=lambda g: (len(g), g))
        rows = {g: i for i, g in enumerate(grams)}
        n, width = len(grams), len(langs)
        seen = np.zeros((n, width))  # counts; below the highest order, of different characters before
        for j, r in enumerate(raw):
            for g, c in r.items():
                if len(g) == ORDER or g[0] == _START:
                    seen[rows[g], j] += c
                if len(g) > 1 and g[1:] in rows:
                    seen[rows[g[1:]], j] += 1
        total, kinds = np.zeros((n + 1, width)), np.zeros((n + 1, width))  # of a context; the last is the empty one
        context = np.array([rows.get(g[:-1], -1) if len(g) > 1 else n for g in grams], dtype=np.int64) if n else np.zeros(0, np.int64)
        known = context >= 0
        np.add.at(total, context[known], seen[known])
        np.add.at(kinds, context[known], (seen[known] > 0).astype(float))
        alphabet = max(2, len({g[-1] for g in grams} - {_START}))
        size = np.array([len(g) for g in grams], dtype=np.int64)
        logp, uniform = np.full((n, width), -math.log(4 * alphabet)), 1 / (4 * alphabet)
        gamma = np.zeros((n + 1, width))
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(size == k)
            if not len(own):
                continue
            s = seen[own]
            once, twice = (s == 1).sum(), (s == 2).sum()
            d = min(0.95, max(0.3, once / max(1, once + 2 * twice)))
            lower = np.exp(logp[[rows[grams[i][1:]] for i in own]]) if k > 1 else np.full((len(own), width), uniform)
            c = context[own]
            t, v = total[c], kinds[c]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(t > 0, (np.maximum(s - d, 0) + d * v * lower) / t, lower)
                before = np.unique(c)  # all contexts of this order
                gamma[before] = np.where(total[before] > 0, np.log(d * kinds[before] / total[before]), 0.0)
            logp[own] = np.log(np.maximum(p, 1e-12))
        floor, gamma = gamma[n] + math.log(uniform), gamma[:n]
        keys = np.array([_hash(g) for g in grams], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        return cls(langs, keys[order], logp[order].astype(np.float32), gamma[order].astype(np.float32), floor.astype(np.float32), np.full(width, np.inf))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each folded word in each language, and the number of characters predicted."""
        p, at, size = self.each(words)
        return np.add.reduceat(p, at, axis=0) if len(words) else np.zeros((0, len(self.langs)), np.float32), size - 1

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of each character, 0 for the start of a word; where each word starts, and its characters with start and end."""
        size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        total, at = int(size.sum()), np.concatenate(([0], np.cumsum(size)))[:-1]
        chars = np.empty(total, np.uint64)
        chars[at] = _START
        chars[at + size - 1] = _END
        inner = np.ones(total, bool)
        inner[at] = inner[at + size - 1] = False
        chars[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.arange(total) - np.repeat(at, size)
        width = len(self.langs)
        p = np.empty((total, width), np.float32)
        p[:] = self.floor
        before = np.full(total, -1, np.int64)  # row of the n-gram one shorter that ends here
        back_by = [np.roll(chars, back) for back in range(ORDER)]
        for k in range(1, ORDER + 1):
            h = np.full(total, k, np.uint64)
            for back in range(k - 1, -1, -1):
                h = (h ^ back_by[back]) * np.uint64(_PRIME)
                h ^= h >> np.uint64(29)
            ok = place >= k - 1
            row = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = ok & (self.keys[row] == h) if len(self.keys) else np.zeros(total, bool)
            if k > 1:
                context = np.roll(before, 1)
                off = ok & ~found & (context >= 0)
                p[off] += self.gamma[context[off]]
            p[found] = self.logp[row[found]]
            before = np.where(found, row, -1)
        p[at] = 0
        return p, at, size

    def each_char(self, words: list[str], j: int) -> np.ndarray:
        """Nats a character of each word in language ``j``."""
        one = KneserNey(self.langs[j : j + 1], self.keys, self.logp[:, j : j + 1], self.gamma[:, j : j + 1], self.floor[j : j + 1], self.limit[j : j + 1])
        s, n = one.score(words)
        return np.round(-s[:, 0] / n, 4)

    def calibrate(self, real: dict[str, Counter], invented: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """For each language the limit that parts its words from invented ones, of which it takes ``each_char`` and how many have it."""
        for j, lang in enumerate(self.langs):
            good = [w for w in real.get(lang, {}) if len(w) > SHORT]
            if not good:
                self.limit[j] = -1.0  # a language without words claims none
                continue
            x = np.sort(self.each_char(good, j))
            values, times = invented.get(lang, (np.zeros(0), np.zeros(0)))
            if not len(values):
                self.limit[j] = x[-1]
                continue
            order = np.argsort(values)
            y, upto = values[order], np.concatenate(([0.0], np.cumsum(times[order])))
            cuts = np.unique(np.concatenate((x, y)))
            kept, wrong = np.searchsorted(x, cuts, "right") / len(x), upto[np.searchsorted(y, cuts, "right")] / upto[-1]
            gain = kept - NAME_COST * wrong
            best = np.flatnonzero(gain >= gain.max() - 1e-9)
            low = cuts[best[0]]
            self.limit[j] = (low + (cuts[best[-1] + 1] if best[-1] + 1 < len(cuts) else cuts[best[-1]])) / 2


def _hash(gram: tuple[int, ...]) -> int:
    h, full = len(gram), (1 << 64) - 1
    for c in gram:
        h = ((h ^ c) * _PRIME) & full
        h ^= h >> 29
    return h


class WordCounts:
    """How often each folded word occurs, and in how many records, by label; with ``model`` only in sentences that it gives to their label."""

    def __init__(self, langs: tuple[str, ...], model: KneserNey | None):
        self.langs, self.model = langs, model
        self.clear()

    def clear(self) -> None:
        width = len(self.langs)
        self.chunk: dict[str, int] = {}
        self.word: dict[str, int] = {}
        self.first, self.size, self.breaks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a chunk: its words in inside, ends of sentences
        self.inside, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)  # words, and the ends of sentences before them in their chunk
        self.score = np.zeros((0, width), np.float32)
        self.times, self.held, self.records = np.zeros((width, 0), np.int64), np.zeros((width, 0), np.int64), np.zeros(width, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        size, breaks, inside, after, before = [], [], [], [], len(self.word)
        for c in chunks:
            self.chunk[c] = len(self.chunk)
            bare = c[:-1] if c[-1] in _MARKS else c
            if bare.isalpha():
                size.append(1)
                breaks.append(c[-1] in _SENTENCE_MARKS)
                inside.append(self.word.setdefault(fold(bare), len(self.word)))
                after.append(0)
                continue
            parts = _SENTENCE.split(c)
            words = [(i, fold(w)) for i, part in enumerate(parts) for w in words_of(part)]
            size.append(len(words))
            breaks.append(len(parts) - 1)
            inside += [self.word.setdefault(w, len(self.word)) for _, w in words]
            after += [i for i, _ in words]
        size, start = np.array(size, np.int64), len(self.inside)
        add = lambda x, y: np.concatenate((x, np.array(y, np.int64)))
        self.first, self.size, self.breaks = add(self.first, start + np.cumsum(size) - size), add(self.size, size), add(self.breaks, breaks)
        self.inside, self.after = add(self.inside, inside), add(self.after, after)
        if fresh := list(itertools.islice(self.word, before, None)):
            more = np.zeros((len(self.langs), len(fresh)), np.int64)
            self.times, self.held = np.hstack((self.times, more)), np.hstack((self.held, more))
            if self.model is not None:
                self.score = np.concatenate((self.score, self.model.score(fresh)[0]))

    def add(self, label: np.ndarray, texts: list[str], step: int = STEP) -> None:
        """``label``: the number of each record's language."""
        for i in range(0, len(texts), step):
            self._add(label[i : i + step], texts[i : i + step])

    def _add(self, label: np.ndarray, texts: list[str]) -> None:
        split = [t.replace("\n", " . ").split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(itertools.chain.from_iterable(split))
        rows = np.fromiter(map(self.chunk.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        if len(fresh := np.flatnonzero(rows < 0)):
            names = [flat[i] for i in fresh.tolist()]
            self._learn(list(dict.fromkeys(names)))
            rows[fresh] = [self.chunk[c] for c in names]
        many, text = self.size[rows], np.repeat(np.arange(len(split)), size)
        breaks = np.cumsum(self.breaks[rows]) - self.breaks[rows] + text  # a text begins a sentence
        at = np.repeat(self.first[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        word, record, sentence = self.inside[at], np.repeat(text, many), np.repeat(breaks, many) + self.after[at]
        if self.model is not None and len(word):
            begin = np.flatnonzero(np.diff(sentence, prepend=-1))
            own = np.add.reduceat(self.score[word], begin, axis=0).argmax(1) == label[record[begin]]
            keep = np.repeat(own, np.diff(begin, append=len(word)))
            word, record = word[keep], record[keep]
        if not len(word):
            return
        width = len(self.word)
        pairs, times = np.unique(record * width + word, return_counts=True)
        record = pairs // width
        cell = label[record] * width + pairs % width
        np.add.at(self.times.reshape(-1), cell, times)
        np.add.at(self.held.reshape(-1), cell, 1)
        self.records += np.bincount(label[record[np.flatnonzero(np.diff(record, prepend=-1))]], minlength=len(self.langs))

    def table(self) -> pa.RecordBatch:
        """``lang, word, times, records``; records of a language without a word."""
        lang, word = np.nonzero(self.held)
        codes = pa.array(self.langs).take(pa.array(np.concatenate((lang, np.arange(len(self.langs))))))
        words = pa.array(list(self.word), pa.string()).take(pa.array(np.concatenate((word, np.full(len(self.langs), -1))), mask=np.arange(len(word) + len(self.langs)) >= len(word)))
        return pa.RecordBatch.from_arrays([codes, words, pa.array(np.concatenate((self.times[lang, word], np.zeros(len(self.langs), np.int64)))), pa.array(np.concatenate((self.held[lang, word], self.records)))], names=["lang", "word", "times", "records"])


def _least(n: int) -> int:
    return max(MIN_RECORDS, math.ceil(MIN_RECORDS * n / PER))


def _fit(rows: pa.Table, records: dict[str, int], langs: tuple[str, ...]) -> tuple[KneserNey, dict[str, Counter]]:
    """A model of ``lang, word, times``, and its words with their counts of ``PER`` records."""
    real = {lang: Counter() for lang in langs}
    for lang, word, times in sorted(zip(*(rows[c].to_pylist() for c in ("lang", "word", "times")), strict=True)):
        real[lang][word] = max(1.0, times * min(1.0, PER / max(1, records[lang])))
    return KneserNey.fit(real, langs), real


def fit_models(rows: list[tuple[str, str]], langs: tuple[str, ...] = LANGUAGES) -> KneserNey:
    """Models from (label, text) rows whose labels may be wrong and whose texts may be mixed; a row is a record.

    Fitted on all rows first, then again on the sentences that the first models give to
    their label.
    """
    rows, model = [(lang, text) for lang, text in rows if lang in langs and text], None
    for _ in range(2):
        counts = WordCounts(langs, model)
        counts.add(np.array([langs.index(lang) for lang, _ in rows], np.int64), [text for _, text in rows])
        t = pa.Table.from_batches([counts.table()])
        n = dict(zip(langs, counts.records.tolist(), strict=True))
        t = t.filter(pc.is_valid(t["word"]))
        held = zip(t["lang"].to_pylist(), t["records"].to_pylist(), strict=True)
        common = t.filter(pa.array([r >= _least(n[lang]) for lang, r in held], pa.bool_()))
        model, real = _fit(common if common.num_rows else t, n, langs)  # too little to tell names from words: all
    learnt, invented = set().union(*real.values()), {lang: [] for lang in langs}
    for lang, word, r in zip(*(t[c].to_pylist() for c in ("lang", "word", "records")), strict=True):
        if r <= max(1, n[lang] // PER) and word not in learnt and len(word) > SHORT:
            invented[lang].append(word)
    model.calibrate(real, {lang: np.unique(model.each_char(words, j), return_counts=True) for (j, lang), words in zip(enumerate(langs), invented.values(), strict=True) if words})
    return model


def labelled_once(records: DataFrame, keys: tuple[str, ...], langs: tuple[str, ...], stage: Stage) -> DataFrame:
    """``label, text`` of every record that has a label of ``langs`` and a text; of rows with the same ``keys`` the least. Only these move."""
    some = records.where(F.col("label").isin(*langs) & (F.length("text") > 0)).select(*keys, "label", "text", F.xxhash64(*keys).alias("_id"))
    twice = stage.write(some.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "twice")
    twice = checked_broadcast(twice, MOST_REPEATED)
    one = some.join(twice, "_id", "left_semi").groupBy(*keys).agg(F.min(F.struct("label", "text")).alias("x")).select("x.label", "x.text")
    return some.join(twice, "_id", "left_anti").select("label", "text").unionByName(one)


def fit_records(records: DataFrame, keys: tuple[str, ...] = ("rec_id",), langs: tuple[str, ...] = LANGUAGES) -> KneserNey:
    """``fit_models`` of all records of ``keys, label, text``, each once. Counts by word stay distributed; what a language has in
    one of ``PER / MIN_RECORDS`` records at least, so at most that many times the words of an average record, reaches the driver."""
    stage, sc, model = Stage(records.sparkSession, "langid"), records.sparkSession.sparkContext, None
    once = stage.write(labelled_once(records.select(*keys, "label", "text"), keys, langs, stage), "once")

    def counted(model: KneserNey | None) -> DataFrame:
        shipped = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = WordCounts(langs, shipped.value)
            for b in batches:
                counts.add(np.asarray(pc.index_in(b.column(0), value_set=pa.array(langs)), np.int64), b.column(1).to_pylist())
                if len(counts.chunk) > MOST_KNOWN:
                    yield counts.table()
                    counts.clear()
            yield counts.table()

        return spread(once).mapInArrow(run, "lang string, word string, times bigint, records bigint").groupBy("lang", "word").agg(F.sum("times").alias("times"), F.sum("records").alias("records"))

    def limit(of: Callable[[int], int]) -> Column:
        return F.coalesce(*[F.when(F.col("lang") == lang, F.lit(of(n[lang]))) for lang in langs])

    for i in range(2):
        t = stage.write(counted(model), f"words{i}")
        n = dict.fromkeys(langs, 0) | {r["lang"]: r["records"] for r in t.where("word is null").collect()}
        t = t.where("word is not null")
        common = t.where(F.col("records") >= limit(_least)).toArrow()
        model, real = _fit(common if common.num_rows else t.toArrow(), n, langs)  # too little to tell names from words: all
    shipped = sc.broadcast((model, set().union(*real.values())))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learnt = shipped.value
        for b in batches:
            of: dict[str, list[str]] = defaultdict(list)
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if word not in learnt and len(word) > SHORT:
                    of[lang].append(word)
            for lang, words in of.items():
                x, many = np.unique(model.each_char(words, langs.index(lang)).astype(float), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(x), pa.array(many)], names=["lang", "x", "n"])

    rare = t.where(F.col("records") <= limit(lambda n: max(1, n // PER))).select("lang", "word").mapInArrow(measured, "lang string, x double, n bigint")
    told = rare.groupBy("lang", "x").agg(F.sum("n").alias("n")).toArrow()  # x has 4 digits
    each = {lang: told.filter(pc.equal(told["lang"], lang)) for lang in langs}
    model.calibrate(real, {lang: (np.asarray(x["x"]), np.asarray(x["n"], float)) for lang, x in each.items()})
    for name in ("twice", "once", "words0", "words1"):
        stage.drop(name)
    return model


class Reader:
    """Finds the stretches of texts; remembers the words it has scored."""

    def __init__(self, model: KneserNey):
        self.model, self.width = model, len(model.langs)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.loglik = np.zeros((1024, self.width), np.float32)
        self.best = np.zeros(1024, np.float32)  # of a row of loglik
        self.count = np.zeros(1024, np.int32)
        self.ends = np.zeros(1024, bool)

    def _learn(self, chunks: list[str]) -> None:
        first, spread, words = len(self.row), [], []
        for i, chunk in enumerate(chunks):
            self.row[chunk] = first + i
            for w in words_of(chunk):
                spread.append(i)
                words.append(w)
        need = first + len(chunks)
        if need > len(self.count):
            grow = max(need, 2 * len(self.count)) - len(self.count)
            self.loglik = np.concatenate((self.loglik, np.zeros((grow, self.width), np.float32)))
            self.best = np.concatenate((self.best, np.zeros(grow, np.float32)))
            self.count = np.concatenate((self.count, np.zeros(grow, np.int32)))
            self.ends = np.concatenate((self.ends, np.zeros(grow, bool)))
        self.ends[first:need] = [not c.isalpha() and _ENDS.search(c[-2:]) is not None for c in chunks]
        if words:
            folded = [fold(w) or w for w in words]
            kinds = list(dict.fromkeys(folded))
            at = {w: i for i, w in enumerate(kinds)}
            s, n = self.model.score(kinds)
            pick = np.fromiter((at[w] for w in folded), np.int64, len(folded))
            limit = np.where(n[:, None] > SHORT + 1, self.model.limit, np.where(self.model.limit > 0, SHORT_LIMIT, -1.0))
            counts = ((-s / n[:, None]) <= limit).any(1)[pick]
            rows = first + np.asarray(spread, np.int64)
            np.add.at(self.loglik, rows[counts], s[pick[counts]])
            self.count[rows[counts]] = 1
        self.best[first:need] = self.loglik[first:need].max(1)

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all stretches in order: text number, first chunk, chunk behind the last, language number (-1: none), words counted, confidence."""
        if len(self.row) > MOST_KNOWN:
            self.clear()
        split = [t.split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(itertools.chain.from_iterable(split))
        n = len(flat)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z, z, z, np.zeros(0)
        rows = np.fromiter(map(self.row.get, flat, itertools.repeat(-1)), np.int64, n)
        if len(fresh := np.flatnonzero(rows < 0)):
            names = [flat[i] for i in fresh.tolist()]
            self._learn(list(dict.fromkeys(names)))
            rows[fresh] = [self.row[c] for c in names]
        text = np.repeat(np.arange(len(split)), size)
        ll, cnt = self.loglik[rows], self.count[rows].astype(np.int64)
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = self.ends[rows[:-1]] | (text[1:] != text[:-1])
        begin = np.flatnonzero(cut)
        until = np.append(begin[1:], n)
        total = np.add.reduceat(ll, begin, axis=0)
        words = np.add.reduceat(cnt, begin)
        owner = text[begin]
        whole = np.zeros((len(split), self.width), np.float64)
        np.add.at(whole, owner, total)
        home = whole.argmax(1)
        total = total.astype(np.float64)
        loss = np.add.reduceat(self.best[rows], begin) - total.max(1)
        total[np.arange(len(begin)), home[owner]] += HOME_BONUS
        lang = np.where(words > 0, total.argmax(1), -1)
        top = np.sort(total, axis=1)
        sure = 1 / (1 + np.exp(-np.clip((top[:, -1] - top[:, -2]) / np.sqrt(np.maximum(words, 1)) if self.width > 1 else np.full(len(begin), 30.0), 0, 30)))
        odd = np.flatnonzero(loss > SWITCH_COST)
        if not len(odd):
            return owner, begin, until, lang, words, sure
        out, last = [], 0
        for i in odd:
            out.append((owner[last:i], begin[last:i], until[last:i], lang[last:i], words[last:i], sure[last:i]))
            a, b = begin[i], until[i]
            path = self._viterbi(ll[a:b])
            turns = np.flatnonzero(np.diff(path)) + 1
            starts, stops = np.concatenate(([0], turns)), np.append(turns, b - a)
            w = np.add.reduceat(cnt[a:b], starts)
            out.append((np.full(len(starts), owner[i]), a + starts, a + stops, np.where(w > 0, path[starts], -1), w, np.full(len(starts), sure[i])))
            last = i + 1
        out.append((owner[last:], begin[last:], until[last:], lang[last:], words[last:], sure[last:]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _viterbi(self, ll: np.ndarray) -> np.ndarray:
        s, came = ll[0].tolist(), []
        for row in ll[1:].tolist():
            top = max(s)
            jump = top - SWITCH_COST
            if jump > min(s):
                j = s.index(top)
                came.append([j if jump > x else i for i, x in enumerate(s)])
                s = [(jump if jump > x else x) + y for x, y in zip(s, row, strict=True)]
            else:
                came.append(None)  # each language stays
                s = [x + y for x, y in zip(s, row, strict=True)]
        path = np.empty(len(ll), np.int64)
        path[-1] = at = s.index(max(s))
        for i in range(len(ll) - 2, -1, -1):
            if came[i] is not None:
                at = came[i][at]
            path[i] = at
        return path

    def languages(self, texts: list[str]) -> tuple[list[list[str]], list[list[float]], list[list[float]]]:
        """For each text its languages by falling share, their shares and their confidence; ``und`` if it has no words."""
        size, codes, shares, sures = self.found(texts)
        names, cuts = [*self.model.langs, "und"], np.concatenate(([0], np.cumsum(size))).tolist()
        lists = [names[j] for j in codes.tolist()], shares.tolist(), sures.tolist()
        return tuple([x[i:j] for i, j in itertools.pairwise(cuts)] for x in lists)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same flat: how many languages each text has, and their numbers (-1: ``und``), shares and confidences."""
        parts = [self._found(texts[i : i + STEP]) for i in range(0, max(1, len(texts)), STEP)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, _, _, lang, words, sure = self.stretches(texts)
        share, trust = np.zeros((len(texts), self.width)), np.zeros((len(texts), self.width))
        has = lang >= 0
        np.add.at(share, (owner[has], lang[has]), words[has])
        np.add.at(trust, (owner[has], lang[has]), sure[has] * words[has])
        trust /= np.maximum(share, 1)
        share /= np.maximum(share.sum(1, keepdims=True), 1)
        order = np.argsort(-share, axis=1, kind="stable")
        share, trust = np.take_along_axis(share, order, 1), np.take_along_axis(trust, order, 1)
        keep = share >= MIN_SHARE
        none = ~keep[:, 0]
        order[none, 0], share[none, 0], trust[none, 0], keep[none, 0] = -1, 0.0, 0.0, True
        return keep.sum(1), order[keep], share[keep], trust[keep]


def sample(records: DataFrame, rec_id: str, code: Column, text: str, n: int, langs: tuple[str, ...]) -> list[tuple[str, str]]:
    """At most ``n`` labelled records of each language, the same ones whatever the partitioning."""
    ids = records.select(F.col(rec_id).alias("_id"), code.alias("_code"), F.length(text).alias("_n"))
    ids = ids.where(F.col("_code").isin(*langs) & (F.col("_n") > 0)).groupBy("_id").agg(F.min("_code").alias("_code"))
    order = Window.partitionBy("_code").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id")
    ids = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).select("_id", "_code")
    rows = records.join(F.broadcast(ids), F.col(rec_id) == F.col("_id"), "inner").select("_id", "_code", F.col(text).alias("_text")).dropDuplicates(["_id"]).collect()
    return [(r["_code"], r["_text"]) for r in sorted(rows, key=lambda r: str(r["_id"]))]


def identify(records: DataFrame, model: KneserNey, rec_id: str = "rec_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``rec_id``, ``keep`` and ``langs``, ``shares``, ``confidences`` of every row, without a shuffle.

    Null and blank texts get empty lists; a text without words of any language gets
    ``und``. Repeated rows give repeated results; other columns are left out.
    """
    cols = [rec_id, *keep]
    shape = records.select(*cols).schema
    shipped = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(shipped.value), pa.array([*shipped.value.langs, "und"])
        for b in batches:
            texts = b.column(len(cols)).to_pylist()
            full = [i for i, t in enumerate(texts) if t is not None and not t.isspace() and t != ""]
            size, codes, shares, sures = reader.found([texts[i] for i in full])
            cuts = np.zeros(len(texts) + 1, np.int32)
            cuts[np.array(full, np.int64) + 1] = size
            cuts = pa.array(np.cumsum(cuts), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (names.take(pa.array(codes % len(names))), pa.array(shares), pa.array(sures))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *lists], names=[*cols, "langs", "shares", "confidences"])

    out = T.StructType([*shape.fields, T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("confidences", T.ArrayType(T.DoubleType()))])
    return spread(records.select(*cols, text)).mapInArrow(run, out)


def segments(records: DataFrame, model: KneserNey, rec_id: str = "rec_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a stretch of one language: ``rec_id, *keep, seg_no, lang, n_words, confidence, segment``.

    Neighbouring stretches of one language are joined, stretches without words go with
    the one before. Null and blank texts have none; a text without words has one, ``und``.
    """
    shape = records.select(rec_id, *keep).schema
    shipped = records.sparkSession.sparkContext.broadcast(model)
    names = [*shape.names, "seg_no", "lang", "n_words", "confidence", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shipped.value)
        for b in batches:
            texts = [t or "" for t in b.column(len(shape)).to_pylist()]
            owner, begin, until, lang, words, sure = reader.stretches(texts)
            first = np.concatenate(([0], np.cumsum([len(t.split()) for t in texts])))
            rows: list[list] = []
            for o, a, z, j, w, s in zip(owner.tolist(), begin.tolist(), until.tolist(), lang.tolist(), words.tolist(), sure.tolist(), strict=True):
                if rows and rows[-1][0] == o and (j < 0 or rows[-1][1] in (j, -1)):
                    r = rows[-1]
                    r[5] += s * w
                    r[1], r[3], r[4] = max(r[1], j), z, r[4] + w
                else:
                    rows.append([o, j, a, z, w, s * w])
            number, ids = Counter(), []
            nos, split = [], {o: texts[o].split() for o in {r[0] for r in rows}}
            for r in rows:
                number[r[0]] += 1
                nos.append(number[r[0]])
                ids.append(r[0])
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(i).take(pa.array(ids, pa.int64())) for i in range(len(shape))],
                    pa.array(nos, pa.int32()),
                    pa.array(["und" if r[1] < 0 else model_langs[r[1]] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([r[5] / r[4] if r[4] else 0.0 for r in rows], pa.float64()),
                    pa.array([" ".join(split[r[0]][r[2] - first[r[0]] : r[3] - first[r[0]]]) for r in rows], pa.string()),
                ],
                names=names,
            )

    model_langs = model.langs
    out = T.StructType([*shape.fields, T.StructField("seg_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("segment", T.StringType())])
    return spread(records.select(rec_id, *keep, text)).mapInArrow(run, out)


def relabel(records: DataFrame, model: KneserNey, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``rec_id, label, text`` with a non-blank text: its ``langs``, ``shares``, ``confidences`` and ``problem``.

    ``label`` is a code or null. ``problem`` is ``missing`` (no label), ``mixed`` (several
    languages), ``wrong`` (the label is not the text's language) or null.
    """
    found = identify(records, model, keep=("label", *keep)).where(F.size("langs") > 0)
    return found.withColumn("problem", F.when(F.col("label").isNull(), "missing").when(F.size("langs") > 1, "mixed").when(F.col("label") != F.col("langs")[0], "wrong"))

"""Problem 9: text statistics of each document, and whether it is prose, list, table or junk.

Every language has a prose profile: the shares of its commonest (function) words, of other known words and of
unknown ones, and its distribution over classes of characters. A text is measured by the Jensen-Shannon divergence
of its own two distributions from those of the nearest language, and by counts: how its words are spread
over four structures (in sentences, in short items, in rows of fields, in noise).

Each kind's structural profile holds these three as distributions: the spread over structures, and how near words and
characters are to prose. The profiles begin as the spreads of ``STRUCTURES``; the documents nearest to
them give the mean of each. A document is of the kind whose profile is at the least sum of
divergences over the three.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.labels import code_of
from quernstone.plans.staging import Stage, spread

FUNCTION_WORDS = 100  # commonest words of a language by documents
SENTENCE_WORDS = 7  # a stretch with fewer words and no sentence's end is an item
FIELDS = 3  # a row has so many fields at least
WRAPPED_CHARS = 40  # a line that long without a sentence's end goes on in the next line, if that isn't an item
LEAST_KNOWN = 0.2  # share of common words under which nothing in a text can be read
MANY_WORDS = 12  # in a text with as many words or more,
FEW_WORDS = 5.0  # so few effective words (the exponential of their entropy) are the same over and over,
FEW_DIFFERENT = 0.3  # (looked for where no more of the words than this are different)
FEW_SENTENCES = 0.1  # and so is such a share of different sentences among ten or more
BROKEN = 0.03  # share of letters that are bytes of another encoding

PRIOR = 10.0  # documents that the profiles below count for
MOST_COUNTED = 300_000  # different words that a task counts before it hands them on

#: Shares of words in sentences, items, fields and noise with which the kinds' profiles begin.
STRUCTURES = {"prose": (0.85, 0.08, 0.04, 0.03), "list": (0.10, 0.80, 0.05, 0.05), "table": (0.05, 0.15, 0.75, 0.05), "junk": (0.05, 0.05, 0.05, 0.85)}
#: Divergences of words and of characters from a language's prose with which they begin.
DIVERGENCES = {"prose": (0.15, 0.05), "list": (0.35, 0.30), "table": (0.40, 0.50), "junk": (0.60, 0.75)}
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line break", "sentence end", "separator", "other")

_ENDS = frozenset(".!?…؟。")
_CLOSERS = "\"'»”)]"
_SENTENCE = re.compile(r"(?<=[.!?…؟。])[\"'»”)\]]*\s+")
_BULLET = re.compile(r"^\s*(?:[-*•·–—+>▪◦‣]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)\]])\s+")
_ITEM_SEPARATORS = re.compile(r"\s*[|;•·,،؛/]\s+|\s+[-–—]\s+|\t")
_STRONG_SEPARATORS = re.compile(r"\s+[|•·/]\s+|\s*[;؛]\s+|\t|\s{3,}")
_STRONG_MARK = re.compile(r"[|;•·؛/\t]|\s[-–—]\s|\s{3}")
_ROW_SEPARATORS = ("|", "\t", ";", "  ", ",", "،")
_COLUMNS = re.compile(r"\s{2,}")
_PARTS = re.compile(r"[\s|;,،\"%]+")
_LEADERS = frozenset("._…")
_LEADER = re.compile(r"\.{3,}|_{3,}|…{2,}|(?:\. ){3,}")
_NUMBER = re.compile(r"^[\W_]*\d[\d.,:/%\-\s]*[\W_]*$")
_MARKS_CODE = re.compile(r"[&{}<$%\[]")
_MARKUP = re.compile(r"&[#\w]+;|\{\{|\}\}|</?\w+>|\$\w+|%[sd]\b|\[object")
_LOST = re.compile("[\x7f-\x9f\ufffd]")  # control characters and marks of lost ones
_OTHER_BYTES = re.compile("[\xc2-\xd9][\x80-\xbf]")  # two bytes of UTF-8 that were read as two letters
_HEX = re.compile(r"^[0-9a-f]{2,}$|^[0-9A-F]{2,}$")


class _Letters(dict):
    """A table for str.translate that leaves letters and turns the rest into spaces; filled as characters come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c.isalnum() and not c.isdecimal() else " "
        return self[code]


_LETTERS = _Letters()


def words_of(text: str) -> Counter:
    """The runs of letters of a text in lower case, counted."""
    return Counter(text.lower().translate(_LETTERS).split())


def ends_sentence(part: str) -> bool:
    """Whether the last character, but for closing quotes and brackets, ends a sentence."""
    return part.rstrip(_CLOSERS)[-1:] in _ENDS if part else False


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of distributions along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.maximum((a + b) / 2, 0)


_CLASS_OF = np.zeros(0, np.uint8)


def _class(c: str) -> int:
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if c.isalpha():
        return 0 if c.islower() else 1 if c.isupper() else 2
    if c.isdigit():
        return 3
    return 6 if c in ".!?…؟。" else 7 if c in "|;,،؛:-•'’«»\"()" else 8


def char_classes(texts: list[str]) -> np.ndarray:
    """Counts of CLASSES in each text, by a table over the code points below 65,536; others are letters or other."""
    global _CLASS_OF
    if not len(_CLASS_OF):
        _CLASS_OF = np.array([_class(chr(i)) for i in range(1 << 16)], np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS_OF[np.minimum(code, (1 << 16) - 1)].astype(np.int64)
    for i in np.flatnonzero(code >= 1 << 16):
        kind[i] = _class(chr(code[i]))
    kind += np.repeat(np.arange(len(texts)) * len(CLASSES), size)
    return np.bincount(kind, minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES)).astype(float)


class Profiles:
    """Of each language the shares of its function words, other known words and unknown ones; and all known words."""

    def __init__(self, shares: dict[str, dict[str, float]], others: dict[str, tuple[float, float]], known: set[str]):
        self.langs = sorted(shares)
        self.words = {lang: sorted(shares[lang]) for lang in self.langs}
        self.share = {lang: np.array([*(shares[lang][w] for w in self.words[lang]), *others[lang]]) for lang in self.langs}
        self.known = known
        self.place: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for j, lang in enumerate(self.langs):
            for i, w in enumerate(self.words[lang]):
                self.place[w].append((j, i))

    def nearest(self, words: list[Counter]) -> tuple[list[str | None], np.ndarray]:
        """Of each text the language nearest by its words and the divergence from it; a text without words is at 1."""
        n = len(words)
        if not self.langs:
            return [None] * n, np.ones(n)
        hits: list[list[list[int]]] = [[[], [], []] for _ in self.langs]
        total, read = np.zeros(n), np.zeros(n)
        for r, counted in enumerate(words):
            total[r] = counted.total()
            read[r] = sum(counted[w] for w in counted.keys() & self.known)
            for w in counted.keys() & self.place.keys():
                for j, i in self.place[w]:
                    hits[j][0].append(r)
                    hits[j][1].append(i)
                    hits[j][2].append(counted[w])
        d = np.ones((n, len(self.langs)))
        for j, lang in enumerate(self.langs):
            x = np.zeros((n, len(self.share[lang])))
            x[hits[j][0], hits[j][1]] = hits[j][2]
            x[:, -2] = read - x[:, :-2].sum(1)
            x[:, -1] = total - read
            d[:, j] = np.where(total > 0, divergence(x / np.maximum(total[:, None], 1), self.share[lang]), 1.0)
        best = d.argmin(1)
        return [self.langs[j] for j in best], d[np.arange(n), best]


def fit_profiles(documents: DataFrame, languages: DataFrame, text: str = "text", lang: str = "lang", known_share: float = 0.002, known_least: int = 3) -> Profiles:
    """Words of each language, counted over all documents labelled with a code of ``languages``.

    A word is known if ``known_share`` of its language's documents have it, and ``known_least`` at least: a language has at
    most as many known words as a document has different words on average, divided by ``known_share``. Only these, and
    sums a language, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_lang", "_word", "_docs", "_times"]
        seen: dict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def counted() -> Iterator[pa.RecordBatch]:
            for code, (docs, times) in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(times), pa.string()), pa.array(list(times), pa.string()), pa.array([docs[w] for w in times], pa.int64()), pa.array(list(times.values()), pa.int64())], names=names)
            seen.clear()

        for b in batches:
            for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                words[""] += 1  # the document itself
                docs, times = seen[code]
                docs.update(words.keys())
                times.update(words)
            if sum(len(times) for _, times in seen.values()) > MOST_COUNTED:
                yield from counted()
        yield from counted()

    stage = Stage(documents.sparkSession, "words")
    codes = languages.select(F.col("code").alias("_lang")).where("code is not null").distinct()
    labelled = documents.select(code_of(F.col(lang), languages).alias("_lang"), F.col(text).alias("_text")).where(F.col("_lang").isin([r[0] for r in codes.collect()]) & F.col("_text").isNotNull())
    counts = spread(labelled).mapInArrow(run, "_lang string, _word string, _docs long, _times long").groupBy("_lang", "_word").agg(F.sum("_docs").alias("_docs"), F.sum("_times").alias("_times"))
    counts = stage.write(counts, "counts")
    sums = {r["_lang"]: (r["docs"], r["times"]) for r in counts.groupBy("_lang").agg(F.max(F.when(F.col("_word") == "", F.col("_docs"))).alias("docs"), F.sum(F.when(F.col("_word") != "", F.col("_times"))).alias("times")).collect()}
    wanted = F.lit(False)
    for code, (docs, times) in sums.items():
        if docs and times:
            wanted |= (F.col("_lang") == code) & (F.col("_docs") >= max(known_least, docs * known_share))
    each: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
    for r in counts.where(wanted & (F.col("_word") != "")).collect():
        each[r["_lang"]].append((-r["_docs"], r["_word"], r["_times"]))
    shares, others = {}, {}
    for code, rows in each.items():
        all_, rows = sums[code][1], sorted(rows)
        shares[code] = {w: n / all_ for _, w, n in rows[:FUNCTION_WORDS]}
        rest = sum(n for _, _, n in rows[FUNCTION_WORDS:]) / all_
        others[code] = rest, max(0.0, 1 - rest - sum(shares[code].values()))
    return Profiles(shares, others, {w for rows in each.values() for _, w, _ in rows})


def _fields(line: str, sep: str) -> list[str]:
    return _COLUMNS.split(line.strip()) if sep == "  " else (line.strip().strip("|") if sep == "|" else line).split(sep)


def _table_lines(lines: list[str]) -> tuple[set[int], float]:
    """Numbers of the lines that are rows of fields, and the words of their fields.

    Separator by separator, the one of most rows first: lines of FIELDS short fields or more, of which
    two at least have about as many fields as is usual. Blank fields may leave a row shorter.
    """
    taken: set[int] = set()
    words = 0.0
    for _ in range(len(_ROW_SEPARATORS)):
        best: tuple[str, list[int]] = ("", [])
        for sep in _ROW_SEPARATORS:
            rows = [i for i, x in enumerate(lines) if i not in taken and sep in x and len(_fields(x, sep)) >= FIELDS]
            if len(rows) > len(best[1]):
                best = sep, rows
        sep, rows = best
        if len(rows) < 2:
            break
        split = {i: _fields(lines[i], sep) for i in rows}
        usual = Counter(map(len, split.values())).most_common(1)[0][0]
        comma = sep in (",", "،")
        alike = [i for i in rows if abs(len(split[i]) - usual) <= (0 if comma else 2)]
        full = [f for i in alike for f in split[i] if f.strip()]
        short = bool(full) and sum(len(f.split()) for f in full) <= 6 * len(full)
        if len(alike) < 2 or not short or (comma and sum(ends_sentence(lines[i]) for i in alike) > len(alike) / 2):
            break
        if sep in ("  ", "\t"):
            first, last = min(alike), max(alike)
            alike += [i for i, x in enumerate(lines) if i not in taken and i not in split and not ends_sentence(x) and (len(_fields(x, sep)) > 1 or (first < i < last and len(x.split()) < SENTENCE_WORDS))]
        taken.update(alike)
        words += sum(len(f.split()) for i in alike for f in _fields(lines[i], sep))
    return taken, words


def structure(text: str, known: set[str]) -> tuple[dict[str, float], Counter]:
    """Words in sentences, items, fields and noise, and the counted words of the text in lower case.

    A single sentence beside items or rows introduces them and counts for less; three or
    more make a text of which a list or table is a part, and count for more.
    """
    words = words_of(text)
    chunks = text.split()
    out = {"sentence": 0.0, "item": 0.0, "field": 0.0, "noise": 0.0}
    if not chunks:
        return out, words
    if _noise(text, words, chunks, known):
        out["noise"] = float(len(chunks))
        return out, words
    lines = [x for x in (y.rstrip("\r ") for y in text.split("\n")) if x.strip()]
    if len(lines) > 1:
        taken, out["field"] = _table_lines(lines)
        lines = [x for i, x in enumerate(lines) if i not in taken]
    merged: list[str] = []
    open_line = False
    for x in lines:
        if open_line and not _BULLET.match(x):
            merged[-1] += " " + x.strip()
        else:
            merged.append(x)
        open_line = len(x) >= WRAPPED_CHARS and not ends_sentence(x) and not (_LEADERS & set(x) and _LEADER.search(x))
    sentences = 0
    for x in merged:
        mark = _BULLET.match(x)
        body = x[mark.end() :] if mark else x
        if _LEADERS & set(body) and _LEADER.search(body):
            body = _LEADER.sub(" ", body)
        strong_mark = _STRONG_MARK.search(body) is not None
        for part in _SENTENCE.split(body):
            n = len(part.split())
            if not n:
                continue
            if strong_mark or part.count(",") + part.count("،") >= 3:
                strong = [i for i in _STRONG_SEPARATORS.split(part) if i.strip()]
                if len(strong) >= 2 and all(len(i.split()) < SENTENCE_WORDS for i in strong) and not ends_sentence(part):
                    out["item"] += n
                    continue
                sizes = sorted(len(i.split()) for i in _ITEM_SEPARATORS.split(part) if i.strip())
                if len(sizes) >= 4 and sizes[len(sizes) // 2] <= 6 and sizes[-1] <= 2 * SENTENCE_WORDS:
                    out["item"] += n
                    continue
            if n >= SENTENCE_WORDS or (n >= 3 and ends_sentence(part)):
                out["sentence"] += n
                sentences += 1
            else:
                out["item"] += n
    out["sentence"] *= 0.6 if sentences == 1 else 2.5 if sentences >= 3 else 1.0
    return out, words


def _noise(text: str, words: Counter, chunks: list[str], known: set[str]) -> bool:
    """Whether no reader could understand the text: symbols, codes, broken letters, the same words over and over."""
    n = len(chunks)
    solid = sum(map(len, chunks))
    n_words = words.total()
    letters = sum(len(w) * k for w, k in words.items())
    if "\x7f" in text or not text.isascii():
        if len(_LOST.findall(text)) > 0.01 * solid or 2 * len(_OTHER_BYTES.findall(text)) > BROKEN * solid:
            return True
    if n >= MANY_WORDS and list(map(len, chunks)).count(1) > 0.6 * n and sum(len(c) == 1 and c.isalpha() for c in chunks) > 0.6 * n:
        return True
    if n >= 4 and _MARKS_CODE.search(text) and sum(map(len, _MARKUP.findall(text))) > 0.15 * solid:
        return True
    if n_words >= MANY_WORDS and len(words) <= max(MANY_WORDS, FEW_DIFFERENT * n_words):
        often = np.array(list(words.values()), float) / n_words
        if np.exp(-(often * np.log(often)).sum()) <= FEW_WORDS:
            return True
        sentences = [x for line in text.split("\n") for x in _SENTENCE.split(line) if len(x) > 20]
        if len(sentences) >= 10 and len(set(sentences)) <= FEW_SENTENCES * len(sentences):
            return True
    # a word or two of letters may be anything; longer ones are weighed by their letters
    long = {w: k for w, k in words.items() if len(w) > 2 or not w.isascii()}
    readable = sum(len(w) * long[w] for w in long.keys() & known)
    unread = sum(long.values()) >= 3 and readable < LEAST_KNOWN * sum(len(w) * k for w, k in long.items())
    if unread or (letters >= 0.6 * solid and n_words >= 3):
        return unread
    # much of it isn't letters: numbers are fine, codes and symbols aren't
    hexed = [c for c in chunks if _HEX.match(c)]
    if n >= 4 and len(hexed) > 0.8 * n and any(not c.isalpha() for c in hexed):
        return True
    parts = [x for x in _PARTS.split(text) if x]
    odd = sum(not _NUMBER.match(x) and 2 * sum(map(str.isalpha, x)) < len(x) for x in parts)
    return odd > 0.5 * len(parts) or not parts


NEEDED = "n_words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_word_share double, nearest_lang string, word_divergence double, class_divergence double, sentence_share double, item_share double, field_share double, noise_share double, kind string"
_MEASURED = "n_words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_word_share double, nearest_lang string, word_divergence double, classes array<double>, shares array<double>"


def _measured(texts: list[str], p: Profiles, common: set[str]) -> list[tuple]:
    """The columns of _MEASURED of texts that aren't blank."""
    read = [structure(t, p.known) for t in texts]
    classes = char_classes(texts)
    langs, d = p.nearest([words for _, words in read])
    spread_ = np.array([[s[k] for k in ("sentence", "item", "field", "noise")] for s, _ in read]).reshape(-1, 4)
    total = spread_.sum(1, keepdims=True)
    share = np.where(total > 0, spread_ / np.maximum(total, 1e-9), [0, 0, 0, 1.0])
    solid = classes.sum(1) - classes[:, 4] - classes[:, 5]
    symbols = classes[:, 6:].sum(1)
    out = []
    for i, t in enumerate(texts):
        words, lines = read[i][1], [x for x in t.split("\n") if x.strip()]
        n = words.total()
        out.append((n, sum(len(w) * k for w, k in words.items()) / n if n else None, float(symbols[i] / solid[i]) if solid[i] else None, sum(ends_sentence(x.rstrip()) for x in lines) / len(lines), sum(words[w] for w in words.keys() & common) / n if n else None, langs[i], float(d[i]), classes[i].tolist(), share[i].tolist()))
    return out


class Kinds:
    """The prose classes of characters of each language, and each kind's structural profile.

    spreads: kind -> shares of words over structures; divergences: kind -> those of words and of characters.
    """

    def __init__(self, classes: dict[str | None, np.ndarray], spreads: dict[str, tuple], divergences: dict[str, tuple]):
        self.classes, self.names = classes, list(spreads)
        self.spread = np.array([spreads[k] for k in self.names], float)
        self.far = np.array([divergences[k] for k in self.names], float)

    def class_divergence(self, langs: list[str | None], classes: np.ndarray) -> np.ndarray:
        """From the classes of characters of each text's language; 1 where the language has none."""
        out, share = np.ones(len(langs)), classes / np.maximum(classes.sum(1, keepdims=True), 1)
        for lang, own in self.classes.items():
            at = [i for i, x in enumerate(langs) if x == lang]
            out[at] = divergence(share[at], own)
        return out

    def of(self, spreads: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Number of the nearest profile: the least sum of the divergences of the spread, of the words' and of the characters' nearness."""
        total = divergence(spreads[:, None, :], self.spread[None])
        for j in range(far.shape[1]):
            near, own = np.stack((1 - far[:, j], far[:, j]), -1), np.stack((1 - self.far[:, j], self.far[:, j]), -1)
            total = total + divergence(near[:, None, :], own[None])
        return total.argmin(1)


def _numbers(b: pa.RecordBatch, width: int, name: str) -> np.ndarray:
    return np.asarray(b.column(name).flatten()).reshape(-1, width)


def fit_kinds(measured: DataFrame) -> Kinds:
    """The kinds' profiles from all measured documents; a row a language and one a kind reach the driver.

    The documents nearest to STRUCTURES by their spread alone give each kind's means, and those of prose the
    languages' classes of characters. STRUCTURES and DIVERGENCES count for ``PRIOR`` documents.
    """
    names, first = list(STRUCTURES), np.array(list(STRUCTURES.values()))
    full = measured.where("shares is not null").select("nearest_lang", "word_divergence", "classes", "shares")

    def grouped(keys: list, rows: np.ndarray) -> pa.RecordBatch:
        sums: dict = defaultdict(lambda: np.zeros(rows.shape[1] + 1))
        for k, r in zip(keys, rows, strict=True):
            sums[k][0] += 1
            sums[k][1:] += r
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["key", "x"])

    def seeds(b: pa.RecordBatch) -> list[str]:
        return [names[k] for k in divergence(_numbers(b, 4, "shares")[:, None, :], first[None]).argmin(1)]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [i for i, k in enumerate(seeds(b)) if k == "prose"]
            langs = b.column("nearest_lang").to_pylist()
            yield grouped([langs[i] for i in at], _numbers(b, len(CLASSES), "classes")[at])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = own.class_divergence(b.column("nearest_lang").to_pylist(), _numbers(b, len(CLASSES), "classes"))
            yield grouped(seeds(b), np.column_stack((_numbers(b, 4, "shares"), np.asarray(b.column("word_divergence")), e)))

    def summed(run, width: int) -> dict[str | None, np.ndarray]:
        each = full.mapInArrow(run, "key string, x array<double>").select("key", F.posexplode("x").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x"))
        out: dict = defaultdict(lambda: np.zeros(width + 1))
        for r in each.collect():
            out[r["key"]][r["i"]] = r["x"]
        return out

    own = Kinds({k: x[1:] / max(1.0, x[1:].sum()) for k, x in summed(classes, len(CLASSES)).items()}, STRUCTURES, DIVERGENCES)
    found = summed(means, 6)
    mean = {k: (found[k][1:] + PRIOR * np.array([*STRUCTURES[k], *DIVERGENCES[k]])) / (found[k][0] + PRIOR) for k in names}
    return Kinds(own.classes, {k: tuple(x[:4]) for k, x in mean.items()}, {k: tuple(x[4:]) for k, x in mean.items()})


def measure(documents: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of _MEASURED for every row, without a shuffle; all null but ``n_words`` for a null or blank text."""
    shape = documents.select(doc_id).schema
    names = [doc_id, *(x.split()[0] for x in _MEASURED.split(", "))]
    shipped = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        common = {w for lang in p.langs for w in p.words[lang]}
        for b in batches:
            texts = b.column(1).to_pylist()
            full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            rows: list[tuple] = [(0, *[None] * 8)] * len(texts)
            for at in range(0, len(full), 500):  # bounds the matrices of a step
                for i, row in zip(full[at : at + 500], _measured([texts[i] for i in full[at : at + 500]], p, common), strict=True):
                    rows[i] = row
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds_of = [pa.int64(), *[pa.float64()] * 4, pa.string(), pa.float64(), *[pa.list_(pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds_of, strict=True))], names=names)

    return spread(documents.select(doc_id, text)).mapInArrow(run, f"`{doc_id}` {shape[0].dataType.simpleString()}, {_MEASURED}")


def statistics(documents: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text", kinds: Kinds | None = None) -> DataFrame:
    """``doc_id`` and the columns of NEEDED for every row, without a shuffle of texts.

    A null or blank text has no words, null ratios and the kind null. Repeated rows give
    repeated results; other columns are left out. Texts are read whole, and once. ``kinds`` are fitted to the documents unless given.
    """
    measured = Stage(documents.sparkSession, "quality").write(measure(documents, profiles, doc_id, text), "measured")
    kinds = kinds or fit_kinds(measured)
    names = [doc_id, *(x.split()[0] for x in NEEDED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = np.asarray(b.column("shares").is_valid())
            x = b.filter(pa.array(full))
            shares, far = _numbers(x, 4, "shares"), np.column_stack((np.asarray(x.column("word_divergence")), kinds.class_divergence(x.column("nearest_lang").to_pylist(), _numbers(x, len(CLASSES), "classes"))))
            kind = kinds.of(shares, far)

            def whole(values: np.ndarray, t: pa.DataType) -> pa.Array:
                out = np.full(len(full), None, object)
                out[full] = values
                return pa.array(out.tolist(), t)

            yield pa.RecordBatch.from_arrays([*b.columns[:8], whole(far[:, 1], pa.float64()), *(whole(shares[:, j], pa.float64()) for j in range(4)), whole(np.array([kinds.names[k] for k in kind], object), pa.string())], names=names)

    return measured.mapInArrow(run, f"`{doc_id}` {measured.schema[doc_id].dataType.simpleString()}, {NEEDED}")

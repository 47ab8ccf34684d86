"""Problem 5: questions of the evaluation splits that also stand in training, exactly or nearly.

Every question becomes a bag of folded words; equal bags form a class. Classes with a
record in training meet those with one in evaluation in the buckets of banded minwise
hashes, verified first by exact Jaccard similarity and then word by word.

TESTDATA.md's notion of the same question replaces five-word shingles: word places don't
count, so shingles are letter trigrams inside words (Hangul as letters), without digits.
Numbers must be equal, so the numbers are part of each bucket's key. Two slips and a small
word leave questions above ``SHORT`` letters with a similarity of about one half or more, which is
``MIN_JACCARD``. Pairs with a shorter question meet in exact keys instead, whatever their
similarity: sums of random numbers, one a letter, so that a key without a letter is a subtraction; with up to
two letters and up to one small word taken away. All letters together are a key of every question,
in which those meet that only set their spaces otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.staging import Stage, spread

BANDS, ROWS = 20, 4
MIN_JACCARD = 0.5
SHORT = 32  # letters of a question up to which bands don't suffice
MOST_SLIPS = 2  # letters, in all words together
MOST_SMALL = 1  # words added or left out
RARE = 3  # a word in fewer classes may be anyone's slip
RATIO = 20  # a slip is at least so many times rarer, in its language, than the word that was meant
OPTIONAL = 0.1  # share of a word's classes that also stand without it, three at least, which makes it a small word
MOST_KNOWN = 300_000  # words whose signature a worker remembers before it starts afresh

#: Small words: articles, prepositions, pronouns, conjunctions, auxiliaries and particles, folded (fixed values).
SMALL_WORDS = {
    "en": "a an the of in on at to for from by with and or is are was were do does did it that this there then so just really actually exactly please",
    "fr": "le la les l un une des du de d en au aux a et ou est sont ce il elle y dans pour par alors donc bien vraiment exactement",
    "de": "der die das den dem des ein eine einen und oder in im am zu zum von mit es ist denn doch mal nun wohl genau bitte eigentlich wirklich",
    "es": "el los las lo una unos del al y o es por con se que entonces pues realmente exactamente",
    "it": "il gli i uno di da nel e ed che si con per allora proprio davvero esattamente",
    "ar": "من في على الى عن ان هل ما و اذن حقا تماما",
    "ko": "그 이 저 좀 정말 정말로 정확히 도대체 과연 그럼",
}

_DIGITS = re.compile(r"\d+")
_PRIME = (1 << 61) - 1
_A = np.random.default_rng(5).integers(1, _PRIME, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


class _Plain(dict):
    """A table for str.translate: digits as 0-9, marks and invisible characters dropped, spaces for what belongs to no word; filled as characters come."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        drop = not c.isspace() and (unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc") or c == "ـ")
        self[code] = None if drop else str(unicodedata.decimal(c)) if c.isdecimal() else c if c.isalnum() else " "
        return self[code]


_PLAIN = _Plain()


def bag(question: str) -> list[str]:
    """The words without case, accents, punctuation and invisible characters, digits as 0-9, sorted."""
    s = question.lower() if question.isascii() else unicodedata.normalize("NFKD", question.casefold())
    s = s.translate(_PLAIN)
    return sorted((s if s.isascii() else unicodedata.normalize("NFC", s).lower()).split())


SMALL = frozenset(w for line in SMALL_WORDS.values() for w in bag(line))


def numbers(words: list[str]) -> str:
    return " ".join(sorted(_DIGITS.findall(" ".join(words))))


def shingles(word: str) -> list[str]:
    """Letter trigrams of a word with its edges; none for a number."""
    w = _DIGITS.sub("", word)
    if not w:
        return []
    w = f"<{w if w.isascii() else unicodedata.normalize('NFD', w)}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _letters(words: list[str]) -> str:
    return _DIGITS.sub("", "".join(words))


class _Numbers(dict):
    """A random 64-bit number for each letter."""

    def __missing__(self, c: str) -> np.uint64:
        self[c] = np.uint64(int.from_bytes(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=8).digest()))
        return self[c]


_NUMBER = _Numbers()


def _without(letters: str, start: np.uint64, most: int = MOST_SLIPS) -> np.ndarray:
    """Sums of the letters' numbers without up to ``most`` (two at most) of them."""
    held = Counter(letters)
    each = np.fromiter((_NUMBER[c] for c in held), np.uint64, len(held))
    count = np.fromiter(held.values(), np.uint64, len(held))
    total = start + (each * count).sum(dtype=np.uint64)
    if most < 2:
        return np.concatenate((total[None], total - each))
    i, j = np.triu_indices(len(each))
    ok = (i != j) | (count[i] > 1)
    return np.concatenate((total[None], total - each, total - each[i[ok]] - each[j[ok]]))


def exact_keys(words: list[str], number: np.uint64) -> np.ndarray:
    """Keys of which any two questions with ``number`` have one in common that ``compare`` may take for the same and one of which is short.

    A slip changes one letter of the bag of letters, a swap or another space none. A word that isn't in SMALL_WORDS is
    taken away with one slip beside. The key of all letters, which every question has, comes from the Signer.
    """
    letters = _letters(words)
    keys = [_without(letters, number)[1:]] if len(letters) <= SHORT + MOST_SLIPS else []
    for w in set(words):
        if SHORT + MOST_SLIPS >= len(letters) - len(w) > 0 and not _DIGITS.search(w):  # numbers are the same on both sides
            at = words.index(w)
            keys.append(_without(_letters(words[:at] + words[at + 1 :]), number, MOST_SLIPS if w in SMALL else 1))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = {s for w in a for s in shingles(w)}, {s for w in b for s in shingles(w)}
    return len(x & y) / len(x | y) if x or y else 1.0


def slips(a: str, b: str, most: int = MOST_SLIPS) -> int:
    """Letters inserted, dropped, changed or swapped with the next one; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def compare(a: list[str], b: list[str]) -> list[tuple[str, str]] | None:
    """None for different questions, else the words that would make them different if both were real words.

    A pair (word, "") is a word that one side has more.
    """
    if numbers(a) != numbers(b):
        return None
    x, y = Counter(a), Counter(b)
    left, right = list((x - y).elements()), list((y - x).elements())
    if not left and not right:
        return []
    if len(left) > len(right):
        left, right = right, left
    if len(right) > MOST_SLIPS + MOST_SMALL or len(right) - len(left) > MOST_SMALL:
        return [] if _spaced(left, right) else None
    best: tuple[int, list[tuple[str, str]]] | None = None
    for order in itertools.permutations(right, len(left)):
        cost = 0
        for p, q in zip(left, order, strict=True):
            cost += slips(p, q) if _DIGITS.findall(p) == _DIGITS.findall(q) else 99
            if cost > MOST_SLIPS:
                break
        if cost <= MOST_SLIPS and (best is None or cost < best[0]):
            rest = Counter(right) - Counter(order)
            best = cost, [*zip(left, order, strict=True), *((w, "") for w in rest)]
    if best is None or any(not q and _DIGITS.search(p) for p, q in best[1]):
        return [] if _spaced(left, right) else None
    return best[1]


def _spaced(left: list[str], right: list[str]) -> bool:
    """Whether the same letters stand with other spaces between, in some order of the words."""
    if sorted("".join(left)) != sorted("".join(right)):
        return False
    x, y = Counter(left), Counter(right)
    seen: set = set()

    def laid(rest: str, own: Counter, other: Counter) -> bool:
        """Whether the words of ``other`` go on where those of ``own`` are ``rest`` letters ahead."""
        if not rest:
            if not other:
                return True
            w = min(own)  # some word of one side begins
            own[w] -= 1
            done = laid(w, +own, other)
            own[w] += 1
            return done
        state = (rest, tuple(sorted(own.items())), tuple(sorted(other.items())))
        if state in seen:
            return False
        seen.add(state)
        for w in list(other):
            if w.startswith(rest) or rest.startswith(w):
                fewer = other.copy()
                fewer[w] -= 1
                if laid(rest[len(w) :], own, +fewer) if rest.startswith(w) else laid(w[len(rest) :], +fewer, own):
                    return True
        return False

    return laid("", x, y)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' shingles, and where each word's begin; a word without shingles has one that is the largest."""
    edged = []
    for w in words:
        letters = w if w.isalpha() else _DIGITS.sub("", w)
        edged.append(f"<{letters if letters.isascii() else unicodedata.normalize('NFD', letters)}>" if letters else "<>?")
    size = np.fromiter(map(len, edged), np.int64, len(edged))
    chars = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    count = size - 2
    start = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(count.sum()) - np.repeat(start, count) + np.repeat(first, count)
    h = (chars[at] * np.uint64(0x9E3779B1) + chars[at + 1]) * np.uint64(0x85EBCA77) + chars[at + 2]
    h ^= h >> np.uint64(15)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    bare = np.fromiter((e == "<>?" for e in edged), bool, len(edged))
    h[start[bare]] = np.uint64((1 << 64) - 1)
    return h, start


def _least(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of each group's ``rows``, column by column; groups of one size are taken together."""
    out = np.empty((len(size), rows.shape[1]), rows.dtype)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for some in np.array_split(own, 1 + len(own) * int(n) // 20_000):  # bounds what is gathered at once
            out[some] = rows[at[some][:, None] + np.arange(n)].min(1)
    return out


class Signer:
    """Keys of bags; remembers what it needs of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, BANDS * ROWS), np.uint32)
        self.sums, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the letters' numbers; of letters

    def _learn(self, fresh: list[str]) -> None:
        hashes, start = _hashes(fresh)
        mixed = hashes[:, None] * _A
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        for i, w in enumerate(fresh):
            self.known[w] = len(self.rows) + i
        self.rows = np.concatenate((self.rows, _least((mixed >> np.uint64(32)).astype(np.uint32), start, np.diff(np.append(start, len(hashes))))))
        letters = [_letters([w]) for w in fresh]
        self.sums = np.concatenate((self.sums, np.fromiter((sum(map(_NUMBER.__getitem__, x), np.uint64(0)) for x in letters), np.uint64, len(fresh))))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, letters), np.int64, len(fresh))))

    def keys(self, bags: list[list[str]], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of each bag that isn't empty, one a band and one of all letters, and whether it has more of ``exact_keys``.

        ``number`` is of each bag's numbers.
        """
        if len(self.known) > MOST_KNOWN:
            self.__init__()
        fresh = [w for w in dict.fromkeys(itertools.chain.from_iterable(bags)) if w not in self.known]
        if fresh:
            self._learn(fresh)
        size = np.fromiter(map(len, bags), np.int64, len(bags))
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        rows = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(bags)), np.int64, int(size.sum()))
        low = np.empty((len(bags), BANDS * ROWS), np.uint32)
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for some in np.array_split(own, 1 + len(own) * int(n) // 20_000):
                low[some] = self.rows[rows[at[some][:, None] + np.arange(n)]].min(1)
        low = low.reshape(len(bags), BANDS, ROWS).astype(np.uint64)
        key = number[:, None] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            key = (key ^ low[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        letters = np.add.reduceat(self.sizes[rows], at)
        short = letters - np.maximum.reduceat(self.sizes[rows], at) <= SHORT + MOST_SLIPS
        return np.column_stack((key, number + np.add.reduceat(self.sums[rows], at))), short


_NUMBERS: dict[str, int] = {}


def _number(words: list[str]) -> int:
    """A 64-bit number for the numbers in a bag."""
    n = numbers(words)
    if n not in _NUMBERS:
        if len(_NUMBERS) > MOST_KNOWN:
            _NUMBERS.clear()
        _NUMBERS[n] = int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest())
    return _NUMBERS[n]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [" ".join(bag(q)) if q else "" for q in b.column(4).to_pylist()]
        keys = [hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() if w else None for w in words]
        t = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(keys, pa.binary()), pa.array(words, pa.string())], names=["query_id", "split", "source", "lang", "class", "words"])
        yield t.filter(pa.array([w != "" for w in words], pa.bool_()))


def buckets(bags: list[list[str]], signer: Signer) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bags, none of them empty, in one array, and where each bag's end."""
    number = np.fromiter(map(_number, bags), np.uint64, len(bags))
    with np.errstate(over="ignore"):
        first, short = signer.keys(bags, number)
        more = {i: exact_keys(bags[i], number[i]) for i in np.flatnonzero(short).tolist()}
    size = np.full(len(bags), first.shape[1])
    for i, k in more.items():
        size[i] += len(k)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(bags) else 0, np.uint64)
    out[(ends - size)[:, None] + np.arange(first.shape[1])] = first
    for i, k in more.items():
        out[ends[i] - len(k) : ends[i]] = k
    return out.view(np.int64), ends


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()
    for b in batches:
        if b.num_rows:
            keys, ends = buckets([w.split(" ") for w in b.column(3).to_pylist()], signer)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], names=["class", "in_train", "in_eval", "buckets"])


def similar(x: list[str], y: list[str]) -> tuple[float, list[tuple[str, str]]] | None:
    """The similarity of two bags and the words to be checked; None for different questions."""
    p, q = set(x), set(y)
    same_letters = len(p - q) > MOST_SLIPS + MOST_SMALL or len(q - p) > MOST_SLIPS + MOST_SMALL
    if same_letters and sorted("".join(x)) != sorted("".join(y)):
        return None  # compare() rejects them whatever their similarity
    sim = jaccard(x, y)
    if sim < MIN_JACCARD and min(len(_letters(x)), len(_letters(y))) > SHORT and not same_letters:
        return None
    doubt = compare(x, y)
    return None if doubt is None else (sim, doubt)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, sims, doubts = [], [], []
        for i, (p, q) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if found := similar(p.split(" "), q.split(" ")):
                keep.append(i)
                sims.append(found[0])
                doubts.append([{"p": u, "q": v} for u, v in found[1]])
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sims, pa.float64()), pa.array(doubts, pa.list_(pa.struct([("p", pa.string()), ("q", pa.string())])))], names=["train_class", "eval_class", "similarity", "doubts"])


def same_questions(train: DataFrame, evaluation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes and the classes' members.

    train: ``query_id, query, source, lang``; evaluation: these and ``split``. ``lang`` only tells in which questions a
    word is common; it may be null or lacking. Other columns are
    ignored, null and wordless queries match nothing, repeated rows count once. Returns
    ``train_class, eval_class, similarity`` (a class pairs with itself at 1.0 where both
    sides have members) and ``query_id, split, source, class``. All members of a pair's
    classes overlap; copies aren't expanded into pairs.
    """
    spark = train.sparkSession
    stage = Stage(spark, "overlap")
    train, evaluation = (x if "lang" in x.columns else x.withColumn("lang", F.lit(None).cast("string")) for x in (train, evaluation))
    every = train.select("query_id", F.lit("train").alias("split"), "source", "lang", "query").unionByName(evaluation.select("query_id", "split", "source", "lang", "query"))
    members = stage.write(spread(every).mapInArrow(_bags, "query_id long, split string, source string, lang string, class binary, words string"), "members")
    classes = members.groupBy("class").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"), F.first("words").alias("words"), F.max("lang").alias("lang"))
    classes = stage.write(classes, "classes")
    banded = stage.write(spread(classes.select("class", "in_train", "in_eval", "words")).mapInArrow(_band, "class binary, in_train boolean, in_eval boolean, buckets array<long>"), "bands")
    left = banded.where("in_train").select(F.col("class").alias("train_class"), F.explode("buckets").alias("bucket"))
    right = banded.where("in_eval").select(F.col("class").alias("eval_class"), F.explode("buckets").alias("bucket"))
    met = left.join(right, "bucket").where("train_class <> eval_class").select("train_class", "eval_class").distinct()
    words = classes.select("class", "words")
    met = met.join(words.select(F.col("class").alias("train_class"), F.col("words").alias("p")), "train_class").join(words.select(F.col("class").alias("eval_class"), F.col("words").alias("q")), "eval_class")
    pairs = stage.write(met.select("train_class", "eval_class", "p", "q").mapInArrow(_verify, "train_class binary, eval_class binary, similarity double, doubts array<struct<p:string,q:string>>"), "pairs")
    stage.drop("bands")
    # a pair of words that are both common in the language, or a word more that isn't small, makes another question
    lang = F.coalesce("lang", F.lit(""))
    words = classes.select(lang.alias("lang"), F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    doubts = pairs.select("train_class", "eval_class", F.explode("doubts").alias("d")).select("train_class", "eval_class", F.col("d.p").alias("p"), F.col("d.q").alias("q"))
    doubts = stage.write(doubts.join(classes.select(F.col("class").alias("eval_class"), lang.alias("lang")), "eval_class"), "doubts")
    asked = doubts.select("lang", F.explode(F.array("p", "q")).alias("word")).where("word <> ''").distinct()
    often = stage.write(words.join(asked, ["lang", "word"], "left_semi").groupBy("lang", "word").agg(F.count("*").alias("n")), "often")
    doubts = doubts.join(often.select("lang", F.col("word").alias("p"), F.col("n").alias("np")), ["lang", "p"], "left").join(often.select("lang", F.col("word").alias("q"), F.col("n").alias("nq")), ["lang", "q"], "left")
    left_out = doubts.where("q = ''").select("lang", "p", F.greatest("train_class", "eval_class").alias("class")).distinct().groupBy("lang", "p").agg(F.count("*").alias("n_without"))
    doubts = doubts.join(left_out, ["lang", "p"], "left")
    low, high = F.least("np", "nq"), F.greatest("np", "nq")
    small = F.col("p").isin(*sorted(SMALL)) | ((F.col("n_without") >= RARE) & (F.col("n_without") >= F.col("np") * OPTIONAL))
    other = F.when(F.col("q") == "", ~small).otherwise((low >= RARE) & (low * RATIO >= high))
    wrong = doubts.where(other).select("train_class", "eval_class").distinct()
    near = pairs.join(wrong, ["train_class", "eval_class"], "left_anti").select("train_class", "eval_class", "similarity")
    exact = classes.where("in_train and in_eval").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"), F.lit(1.0).alias("similarity"))
    return near.unionByName(exact), members.select("query_id", "split", "source", "class").distinct()


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records: ``train_id, train_source, eval_id, split, source, similarity``."""
    train = members.where("split = 'train'").select(F.col("query_id").alias("train_id"), F.col("source").alias("train_source"), F.col("class").alias("train_class"))
    rest = members.where("split <> 'train'").select(F.col("query_id").alias("eval_id"), "split", "source", F.col("class").alias("eval_class"))
    return pairs.join(rest, "eval_class").join(train, "train_class").select("train_id", "train_source", "eval_id", "split", "source", "similarity")


def report(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """For each split and source: its records, those that overlap with training, and the pairs they form.

    Counts of pairs are sums of class sizes' products; nothing is expanded.
    """
    sizes = members.where("split = 'train'").groupBy("class").agg(F.countDistinct("query_id").alias("n_train")).withColumnRenamed("class", "train_class")
    hit = pairs.join(sizes, "train_class").groupBy(F.col("eval_class").alias("class")).agg(F.sum("n_train").alias("n_pairs"))
    rest = members.where("split <> 'train'").dropDuplicates(["split", "query_id"]).join(hit, "class", "left")
    return rest.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))

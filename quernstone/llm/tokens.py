"""Token counts: of the tokenizer given by a table of pieces, and of public byte-pair vocabularies."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLIC_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that cuts a text before byte pairs are merged (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MOST_PIECES = 2_000_000
MOST_KNOWN = 500_000  # chunks that a worker remembers before it starts afresh
CHUNK_CHARS = 1 << 16

# U+001C to U+001F are white space for this library, but not for the pattern's
_CHUNK = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]")


class Pieces:
    """The tokenizer of a vocabulary table: whitespace ends words, ``▁`` begins them, longest piece from the left."""

    def __init__(self, rows: list[tuple[int, str, bool]]):
        self.special = {i for i, _, s in rows if s}
        self.piece = dict(sorted((i, p) for i, p, _ in rows))
        self.known = {p for _, p, s in rows if not s}
        self.longest = max(map(len, self.known), default=1)
        self.count: dict[str, int] = {}

    @classmethod
    def of(cls, vocab: DataFrame) -> Pieces:
        """Reads ``token_id, piece, is_special``; a vocabulary above MOST_PIECES is refused."""
        rows = vocab.select("token_id", "piece", F.coalesce("is_special", F.lit(False)).alias("special")).where("token_id is not null and piece is not null").distinct().limit(MOST_PIECES + 1).collect()
        if len(rows) > MOST_PIECES:
            raise ValueError("the vocabulary is too long")
        return cls([(r["token_id"], r["piece"], r["special"]) for r in rows])

    def word(self, w: str) -> int:
        """Tokens of one word; an unknown character is one."""
        n, i, w = 0, 0, "▁" + w
        while i < len(w):
            for j in range(min(len(w), i + self.longest), i, -1):
                if w[i:j] in self.known:
                    break
            else:
                j = i + 1
            i, n = j, n + 1
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a text; a line break is one. Counts of words are remembered."""
        if len(self.count) > MOST_KNOWN:
            self.count.clear()
        total, count = text.count("\n"), self.count
        for w in text.split():
            n = count.get(w)
            if n is None:
                n = count[w] = self.word(w)
            total += n
        return total


class BytePairs:
    """Counts of a public byte-pair vocabulary.

    A text is cut before single spaces and around runs of white space, where the public
    pattern cuts as well, so the counts of these chunks add up to the text's and can be
    remembered.
    """

    def __init__(self, path: str = PUBLIC_VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.count: dict[str, int] = {}

    def tokens(self, text: str) -> int:
        if len(self.count) > MOST_KNOWN:
            self.count.clear()
        count, total = self.count, 0
        for c in _CHUNK.findall(text):
            n = count.get(c)
            if n is None:
                n = count[c] = len(self.encoding.encode_ordinary(c))
            total += n
        return total


def chunked(df: DataFrame, doc_id: str, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, chunk_no, chunk``: texts cut only in front of white space that follows a word.

    Both tokenizers treat what lies on either side of such a place independently, so
    counts of chunks add up. A stretch without white space is never cut. Null and empty
    texts have no chunk.
    """

    def cut(t: str) -> list[str]:
        if len(t) <= size:
            return [t] if t else []
        out, i = [], 0
        space = re.compile(r"(?<=\S)\s(?=\S)")
        while len(t) - i > size:
            m = None
            for m in space.finditer(t, i + size // 2, i + size + 1):
                pass
            m = m or space.search(t, i + size)
            if m is None:
                break
            out.append(t[i : m.start()])
            i = m.start()
        return [*out, t[i:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [cut(t) if t else [] for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([i for p in parts for i in range(len(p))], pa.int32()), pa.array([c for p in parts for c in p], pa.string())], names=[doc_id, "chunk_no", "chunk"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, chunk_no int, chunk string")


def count_tokens(df: DataFrame, doc_id: str, text: str, counter: Callable[[], object], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, keep…, n_tokens`` of every row without a shuffle; null and empty texts have 0 tokens.

    counter: makes an object with ``tokens(text)`` in each worker.
    """
    cols = list(dict.fromkeys([doc_id, *keep]))
    shape = df.select(*cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter()
        for b in batches:
            n = [c.tokens(t) if t else 0 for t in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(n, pa.int64())], names=[*cols, "n_tokens"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape), "n_tokens bigint"])
    return df.select(*cols, F.col(text).alias("_text")).mapInArrow(run, fields)

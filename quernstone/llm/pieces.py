"""Problem 3: items longer than a model's window, cut at natural boundaries with an overlap.

Atomic segments lie between natural boundaries (a line break, or the mark that ends a
sentence). Neighbours wait in a heap; the pair with the weakest boundary is merged first,
as long as its size and the overlap fit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.tokens import Pieces

LIMIT, OVERLAP = 510, 64
ENDS = (".", "!", "?", "…", "؟")  # marks that end a sentence in front of a space, a line break or the end
CLOSING = ('"', "'", "»", "”", "’", ")", "]")  # marks that may stand between
FORCED, SENTENCE, LINE, PARAGRAPH = range(4)  # strengths of boundaries
STRENGTHS = ("forced", "sentence", "line", "paragraph")


class Marks:
    """What each token id of a vocabulary means for cutting."""

    def __init__(self, pieces: Pieces):
        top = max(pieces.piece, default=0) + 1
        self.special, self.begins, self.breaks, self.ends, self.closes = (np.zeros(top + 1, bool) for _ in range(5))
        for i, p in pieces.piece.items():
            if i < 0:
                continue
            self.special[i] = i in pieces.special
            self.begins[i] = p.startswith("▁")
            self.breaks[i] = p == "\n"
            self.ends[i] = p.lstrip("▁") in ENDS
            self.closes[i] = p in CLOSING
        self.top = top

    def real(self, ids: np.ndarray) -> np.ndarray:
        """Ids without special tokens; unknown ids are one ordinary token each."""
        ids = np.where((ids < 0) | (ids >= self.top), self.top, ids)
        return ids[~self.special[ids]]


def boundaries(ids: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind natural boundaries and their strengths; the end of the item is one."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks, closes = marks.breaks[ids], marks.closes[ids]
    free = np.append(marks.begins[ids[1:]] | breaks[1:], True)  # a space, a break or nothing follows
    before = np.maximum.accumulate(np.where(~closes, np.arange(n), -1))
    sentence = free & (before >= 0) & marks.ends[ids[np.maximum(before, 0)]]
    strength = np.where(breaks, LINE, np.where(sentence, SENTENCE, -1))
    strength[1:][breaks[1:] & breaks[:-1]] = PARAGRAPH
    strength[-1] = PARAGRAPH
    at = np.flatnonzero(strength >= 0)
    return at + 1, strength[at]


def cut(ids: np.ndarray, marks: Marks, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces as (first own token, end, shared tokens in front, strength of its end), and the longest natural stretch."""
    stops, strengths = boundaries(ids, marks)
    n = len(ids)
    if not n:
        return [(0, 0, 0, PARAGRAPH)], 0
    longest = int(np.diff(stops, prepend=0).max())
    if n <= limit:
        return [(0, n, 0, PARAGRAPH)], longest
    atoms: list[list[int]] = []  # start, end, strength of the end
    start = 0
    for stop, strength in zip(stops.tolist(), strengths.tolist(), strict=True):
        while stop - start > (limit if start == 0 else limit - overlap):
            room = start + (limit if start == 0 else limit - overlap)
            words = np.flatnonzero(marks.begins[ids[start + 1 : room + 1]])  # between words, if there are any
            end = start + 1 + int(words[-1]) if len(words) and words[-1] > 0 else room
            atoms.append([start, end, FORCED])
            start = end
        if stop > start:
            atoms.append([start, stop, strength])
            start = stop
    left, right = list(range(-1, len(atoms) - 1)), [*range(1, len(atoms)), -1]
    alive = [True] * len(atoms)

    def fits(i: int, j: int) -> bool:
        return atoms[j][1] - atoms[i][0] + (overlap if atoms[i][0] else 0) <= limit

    heap = [(atoms[i][2], atoms[i + 1][1] - atoms[i][0], i, atoms[i][1], atoms[i + 1][1]) for i in range(len(atoms) - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, end, far = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or atoms[i][1] != end or atoms[j][1] != far or not fits(i, j):
            continue
        atoms[i][1:] = atoms[j][1:]
        alive[j] = False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else -1
            if b >= 0 and fits(a, b):
                heapq.heappush(heap, (atoms[a][2], atoms[b][1] - atoms[a][0], a, atoms[a][1], atoms[b][1]))
    return [(s, e, min(overlap, s), k) for ok, (s, e, k) in zip(alive, atoms, strict=True) if ok], longest


def split_items(items: DataFrame, pieces: Pieces, item_id: str = "item_id", ids: str = "tokens.input_ids", limit: int = LIMIT, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """Every item's pieces in order, without a shuffle: ``item_id, n_item_tokens, cut_kind, piece_no, first_token, n_tokens, n_shared, ends_at``.

    Positions count real tokens, those whose piece isn't special; ``n_tokens`` holds the
    ``n_shared`` tokens of the piece before. ``cut_kind`` is ``whole`` for an item within the
    limit, ``forced`` if a stretch above the limit has no natural boundary inside, else
    ``natural``. An item of special tokens only has one empty piece, one without tokens
    (null) has none. Repeated rows give repeated results; other columns are left out.
    ``with_ids`` adds the pieces' ``input_ids``.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half of the limit")
    shipped = items.sparkSession.sparkContext.broadcast(Marks(pieces))
    kind = items.schema[item_id].dataType.simpleString()
    fields = f"`{item_id}` {kind}, n_item_tokens int, cut_kind string, piece_no int, first_token int, n_tokens int, n_shared int, ends_at string" + ", input_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shipped.value
        for b in batches:
            rows: list[tuple] = []
            lists = []
            col = b.column(1)
            for i in range(len(col)):
                if not col[i].is_valid:
                    continue
                x = marks.real(np.asarray(col[i].values.drop_null().cast(pa.int64())))
                found, longest = cut(x, marks, limit, overlap)
                how = "whole" if len(x) <= limit else "forced" if longest > limit else "natural"
                for no, (s, e, shared, strength) in enumerate(found, 1):
                    rows.append((i, len(x), how, no, s - shared, e - s + shared, shared, STRENGTHS[strength]))
                    if with_ids:
                        lists.append(x[s - shared : e])
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            out = [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=[f.split()[0].strip("`") for f in fields.split(", ")])

    return items.select(item_id, F.col(ids).alias("_ids")).where(F.col(item_id).isNotNull()).mapInArrow(run, fields)

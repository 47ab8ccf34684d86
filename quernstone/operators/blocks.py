"""Queries against blocks of whole documents: what a task adds up, in numpy.

A block has the postings of some documents sorted by word and document. Weights aren't negative, so terms whose largest
weights together stay under what a query still asks for bring no document in by themselves (MaxScore); nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DIGITS = 6
SLACK = 2e-6  # bounds are compared before rounding to DIGITS
SEEK = 12  # looking a document up in a term takes as long as adding so many postings, about


@dataclass
class Asks:
    """Queries as runs of words: query ``i`` has ``word[cuts[i]:cuts[i + 1]]``, each ``times`` times."""

    cuts: np.ndarray
    word: np.ndarray
    times: np.ndarray

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def part(self, first: int, end: int) -> Asks:
        """Queries ``first`` to ``end``."""
        at = slice(self.cuts[first], self.cuts[end])
        return Asks(self.cuts[first : end + 1] - self.cuts[first], self.word[at], self.times[at])


@dataclass
class Block:
    """Postings of word ``w``: ``doc[starts[w]:starts[w + 1]]``, rising, with ``weight``."""

    starts: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    n_docs: int
    order: np.ndarray

    @classmethod
    def of(cls, word: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_words: int, n_docs: int) -> Block:
        """Of postings in the order of their documents; ``word`` -1 is nobody's."""
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(n_words + 1))
        return cls(starts, doc[order], weight[order], n_docs, order)

    def largest(self) -> np.ndarray:
        """Of each word's weights."""
        out, some = np.zeros(len(self.starts) - 1), np.flatnonzero(self.starts[1:] > self.starts[:-1])
        if len(some):
            out[some] = np.maximum.reduceat(self.weight, self.starts[some])
        return out


def reach(block: Block, asks: Asks, least: np.ndarray, k: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``query, documents, scores`` of all scores of ``least`` of the query or more; with ``k`` the k best of these at least, ties by the lower
    document, and ``least`` rises to the k-th."""
    most, total, starts = block.largest(), np.zeros(block.n_docs), block.starts
    for q in range(len(asks)):
        at = slice(asks.cuts[q], asks.cuts[q + 1])
        word = asks.word[at]
        bound = most[word] * asks.times[at]
        met = starts[word + 1] > starts[word]
        if not met.all():
            word, bound, n = word[met], bound[met], asks.times[at][met]
        else:
            n = asks.times[at]
        if not len(word):
            continue
        order = np.argsort(-bound, kind="stable")
        rest = [*np.cumsum(bound[order][::-1])[::-1].tolist(), 0.0]
        floor, seen, late = least[q], [], []
        for i, j in enumerate(order.tolist()):
            a, b = starts[word[j]], starts[word[j] + 1]
            if rest[i] < floor - SLACK:
                late.append((i, a, b, n[j]))
                continue
            docs = block.doc[a:b]
            total[docs] += n[j] * block.weight[a:b]
            seen.append(docs)
            if k is not None and b - a >= k and i < 4:
                floor = max(floor, np.partition(total[docs], b - a - k)[b - a - k] - SLACK)
        if not seen:
            continue
        first = len(seen)
        if first == 1:
            some = seen[0][total[seen[0]] >= floor - rest[first] - SLACK]
        else:
            many = sum(map(len, seen))
            if many * 4 > block.n_docs:
                some = np.flatnonzero(total >= max(floor - rest[first] - SLACK, np.nextafter(0, 1)))
                if floor - rest[first] - SLACK <= 0:  # weights may be 0
                    some = np.union1d(some, np.concatenate([x[total[x] == 0] for x in seen]))
            else:
                some = np.concatenate(seen)
                some = np.unique(some[total[some] >= floor - rest[first] - SLACK])
        scores = total[some]
        for x in seen:
            total[x] = 0
        for i, a, b, times in late:
            if not len(some):
                break
            docs = block.doc[a:b]
            if b - a < len(some) * SEEK:
                total[docs] = block.weight[a:b]
                scores = scores + times * total[some]
                total[docs] = 0
            else:
                place = np.minimum(np.searchsorted(docs, some), b - a - 1)
                scores = scores + np.where(docs[place] == some, times * block.weight[a:b][place], 0.0)
            keep = scores >= floor - rest[i + 1] - SLACK
            if not keep.all():
                some, scores = some[keep], scores[keep]
        scores = np.round(scores, DIGITS)
        if k is None:
            keep = scores >= least[q]
            some, scores = some[keep], scores[keep]
        else:
            if len(some) > k:
                edge = np.partition(scores, len(some) - k)[len(some) - k]
                keep = np.flatnonzero(scores >= edge)
                keep = keep[np.argsort(-scores[keep], kind="stable")][:k]
                some, scores = some[keep], scores[keep]
            keep = scores >= least[q]
            some, scores = some[keep], scores[keep]
            if len(some) == k:
                least[q] = max(least[q], scores.min())
        if len(some):
            yield q, some, scores


def reach_grid(block: Block, length: np.ndarray, idf: np.ndarray, points: list[tuple[float, float]], asks: Asks, least: np.ndarray, enough: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """``query, counts``: how many documents score ``least`` of the query and point or more, at BM25's ``points``.

    ``block`` has counts of terms for weights, ``length`` the documents' lengths over their mean. ``reach`` tells what can score the lowest
    ``least`` by the largest weight that a posting has between all points; only that is scored at each of them, the likeliest first.
    A count above ``enough`` isn't carried on: it may be any number above it.
    """
    k1, b = np.array(points).T
    starts = block.starts
    if not len(block.doc):
        return
    by_word, dl = np.concatenate([np.zeros(starts[0]), np.repeat(idf, np.diff(starts))]), length[block.doc]

    def part(tf: np.ndarray, dl: np.ndarray, k1: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl))

    corners = {(x, y) for x in (k1.min(), k1.max()) for y in (b.min(), b.max())}  # a weight rises or falls all along with k1, and with b
    top = by_word * np.maximum.reduce([part(block.weight, dl, *c) for c in corners])

    largest, least_dl = block.largest(), np.zeros(len(starts) - 1)
    held = np.flatnonzero(starts[1:] > starts[:-1])
    least_dl[held] = np.minimum.reduceat(dl, starts[held])

    def count(q: int, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, where, want, x, y = np.zeros((len(at), len(docs))), length[docs], least[q, at, None], k1[at, None], b[at, None]
        own = slice(asks.cuts[q], asks.cuts[q + 1])
        met = starts[asks.word[own] + 1] > starts[asks.word[own]]
        word = asks.word[own][met]
        weight = asks.times[own][met] * idf[word]
        most = weight * part(largest[word], least_dl[word], x, y)
        order = np.argsort(-most.max(axis=0), kind="stable")
        rest = np.cumsum(most[:, order[::-1]], axis=1)[:, ::-1]
        for i, j in enumerate(order.tolist()):
            if i:
                keep = np.flatnonzero((total >= want - rest[:, i, None] - SLACK).any(axis=0))
                if len(keep) < 0.8 * len(docs):
                    total, docs, where = total[:, keep], docs[keep], where[keep]
                if not len(docs):
                    break
            first, end = starts[word[j]], starts[word[j] + 1]
            place = np.minimum(np.searchsorted(block.doc[first:end], docs), end - first - 1)
            has = np.flatnonzero(block.doc[first:end][place] == docs)
            total[:, has] += weight[j] * part(block.weight[first:end][place[has]], where[has], x, y)
        return (np.round(total, DIGITS) >= want).sum(axis=1)

    for q, docs, bound in reach(Block(starts, block.doc, top, block.n_docs, block.order), asks, least.min(axis=1) - SLACK):
        above, lots = np.zeros(len(points), np.int64), [docs]
        if enough is not None and len(docs) > (n := 4 * (enough + 1)):
            order = np.argpartition(-bound, n)
            lots = [docs[order[:n]], docs[np.sort(order[n:])]]
        for some in lots:
            at = np.flatnonzero(above <= enough) if enough is not None else np.arange(len(points))
            if len(at):
                above[at] += count(q, some, at)
        if above.any():
            yield q, above

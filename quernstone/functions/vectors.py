"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """At unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(as_doubles(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, inner_product(a, b) / n).otherwise(F.lit(0.0))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, element by element; zero if none is."""
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.transform(as_doubles(vectors[0]), lambda x: x * 0)
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, as_doubles(p["v"]), lambda x, y: x + y * p["m"]))
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-9)))


def first_vector(vectors: Column) -> Column:
    """The vector at the first position."""
    return F.try_element_at(vectors, F.lit(1))


def window_ids(ids: Column, width: int, first: int, last: int) -> Column:
    """Windows of ``width`` ids, each between ``first`` and ``last``; an empty array gives one empty window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(width))
    return F.transform(starts, lambda i: F.concat(F.array(F.lit(first)), F.slice(ids, i + 1, width), F.array(F.lit(last))))


def pad_ids(ids: Column, length: int, first: int, last: int, pad: int) -> Column:
    """``ids`` cut so that they fit between ``first`` and ``last``, filled up with ``pad`` to ``length``."""
    framed = F.concat(F.array(F.lit(first)), F.slice(ids, 1, length - 2), F.array(F.lit(last)))
    return F.concat(framed, F.array_repeat(F.lit(pad), F.lit(length) - F.size(framed)))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each position that ``pad_ids`` takes from ``ids`` or frames them with, else 0."""
    real = F.least(F.size(ids) + 2, F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))

"""Problem 1: the most similar vectors of every vector, by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a Hadamard transform; the axis
nearest to the result, with its sign, is one hash. A table's bucket is
that of ``hashes`` axes together. Each vector lies in one bucket a table and asks further ones of the
next nearest axes (multiprobe). Candidates of a bucket are ranked by their exact cosine.

Copies: equal unit vectors form one class, which is hashed once; a class is listed with its
first ``k + 1`` ids, which are all that any neighbour list can hold of it. Oversized
buckets aren't cut: their vectors and questions are split over a grid of blocks, so that
every pair is still compared, a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.staging import Stage

BLOCK = 2048  # vectors of a bucket that one task holds at once
MOST_BROADCAST = 50_000  # rows of the table of oversized buckets up to which it is broadcast
DIGITS = 6  # cosines are rounded to so many digits before ties are broken by id


def _hadamard(n: int) -> np.ndarray:
    """The orthonormal Hadamard matrix of a power of two."""
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.float32(np.sqrt(n))


_STEP = 64  # numbers that one matrix product transforms at once
_MATRIX = {1 << i: _hadamard(1 << i) for i in range(7)}


def transform(y: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row, ``_STEP`` numbers at a time."""
    n, width = y.shape
    step = min(width, _STEP)
    z = (y.reshape(-1, step) @ _MATRIX[step]).reshape(n, width // step, step)
    if width > step:
        z = transform(z.transpose(0, 2, 1).reshape(n * step, -1)).reshape(n, step, -1).transpose(0, 2, 1)
    return z.reshape(n, width)


class Rotations:
    """``tables * hashes`` pseudo-rotations of vectors of width ``dim``, padded to a power of two."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = 11):
        self.width, self.hashes = 1 << max(1, (dim - 1).bit_length()), hashes
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=(tables * hashes, 3, self.width))

    def turn(self, x: np.ndarray, r: int) -> np.ndarray:
        y = np.zeros((len(x), self.width), np.float32)
        y[:, : x.shape[1]] = x
        for signs in self.signs[r]:
            y = transform(y * signs)
        return y

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` likeliest buckets of each vector, the nearest first."""
        many = min(n, self.width)
        tops, gaps = [], []
        for h in range(self.hashes):
            y = self.turn(x, table * self.hashes + h)
            size = np.abs(y)
            top = self._largest(size, many)
            val = np.take_along_axis(size, top, 1)
            axis = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            tops.append(axis.astype(np.int64))
            gaps.append((val[:, :1] - val) ** 2)
        key, cost = tops[0], gaps[0]
        for axis, gap in zip(tops[1:], gaps[1:], strict=True):
            key = (key[:, :, None] * (2 * self.width) + axis[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(key, best, 1)


    def _largest(self, size: np.ndarray, n: int) -> np.ndarray:
        """Places of the ``n`` largest numbers of each row, the largest first."""
        if n > 3:
            top = np.argpartition(-size, n - 1, axis=1)[:, :n] if n < self.width else np.tile(np.arange(self.width), (len(size), 1))
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        left, rows, top = size.copy(), np.arange(len(size)), np.empty((len(size), n), np.int64)
        for i in range(n):
            top[:, i] = left.argmax(1)
            left[rows, top[:, i]] = -1
        return top


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and these at unit length: not null, ``dim`` wide, finite, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1))
    ok = np.flatnonzero(size == dim)
    if not len(ok):
        return ok, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(ok)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(len(ok), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    return ok[good], (x[good] / norm[good, None] + 0.0).astype(np.float32)


def unit_vectors(df: DataFrame, doc_id: str, vector: str, dim: int) -> DataFrame:
    """``id, class, unit``: a row for each row with a usable vector, as 4-byte floats; equal ones have one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b.column(1), dim)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "class", "unit"])

    return df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id string, class binary, unit binary")


def _hashed(units: DataFrame, dim: int, tables: int, hashes: int, probes: int) -> DataFrame:
    """``rep, unit, asks, home, further``: the buckets each vector lies in, one a table, and those that it asks besides."""
    turns = Rotations(dim, tables, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, dim)
            keys = np.stack([turns.probes(x, t, probes) * tables + t for t in range(tables)], 1)
            asks = np.asarray(b.column(2).to_pylist(), bool)
            more = keys[:, :, 1:].reshape(len(x), -1)
            ends = np.concatenate(([0], np.cumsum(asks * more.shape[1])))
            home = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(keys[:, :, 0].reshape(-1)))
            further = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more[asks].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, home, further], names=["rep", "unit", "asks", "home", "further"])

    return units.select("rep", "unit", "asks").mapInArrow(run, "rep string, unit binary, asks boolean, home array<long>, further array<long>")


def _rank(stored: np.ndarray, names: np.ndarray, asked: np.ndarray, askers: np.ndarray, k: int, least: float, out: list) -> None:
    """Appends each asker's ``k`` nearest stored vectors other than itself with a cosine of ``least`` or more."""
    cos = np.round((asked @ stored.T).astype(np.float64), DIGITS)
    cos[askers[:, None] == names[None, :]] = -2
    if cos.shape[1] > k:
        edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        q, s = np.nonzero((cos >= edge) & (cos >= least) & (cos > -2))
    else:
        q, s = np.nonzero((cos >= least) & (cos > -2))
    if len(q):
        c = cos[q, s]
        order = np.lexsort((names[s].astype(str), -c, q))
        q, s, c = q[order], s[order], c[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < k
        out.append((askers[q[keep]], names[s[keep]], c[keep]))


def _search(dim: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit of work, stored vectors before mere questions."""
        out: list = []
        current, held, names, waiting = None, [], [], []

        def answer() -> None:
            if waiting and held:
                _rank(np.concatenate(held), np.concatenate(names), np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), k, least, out)
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(c)], names=["rep", "near", "cosine"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.asarray(batch.column(0))
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, dim)
            rep = np.array(batch.column(1).to_pylist(), object)
            asks, stored = np.asarray(batch.column(2).to_pylist(), bool), np.asarray(batch.column(3).to_pylist(), bool)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1))
            for a, z in zip(starts, np.append(starts[1:], len(unit)), strict=True):
                if unit[a] != current:
                    answer()
                    current, held, names = unit[a], [], []
                    held.clear(), names.clear()
                s, q = stored[a:z], asks[a:z]
                if s.any():
                    held.append(x[a:z][s])
                    names.append(rep[a:z][s])
                if q.any():
                    waiting.append((x[a:z][q], rep[a:z][q]))
                    if not s.any() and sum(len(w[1]) for w in waiting) > BLOCK:
                        answer()
            if sum(len(o[0]) for o in out) > 20_000:
                yield from flush()
        answer()
        yield from flush()

    return run


def nearest(df: DataFrame, doc_id: str, vector: str, k: int = 10, least: float = -1.0, dim: int = 64, tables: int = 8, hashes: int = 2, probes: int = 2, asking: str = "true") -> DataFrame:
    """``id, near_id, cosine, rank``: of each document the ``k`` nearest others found, by falling cosine, then id.

    Two hashes a bucket find 0.99 of the vectors with a cosine of 0.90 and more of nearer ones; one
    hash and more probes are for neighbours as far as 0.5 (recall in the README).

    asking: SQL over ``id`` that tells whose neighbours are sought; all vectors are
    searched. Rows with a vector that is null, of another width, zero or not finite are
    neither asked nor found. Repeated ids count once (the least class if their vectors
    differ). Ties of the rounded cosine go to the smaller id. Other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "neighbours")
    rows = stage.write(unit_vectors(df, doc_id, vector, dim), "rows")
    docs = stage.write(rows.groupBy("id").agg(F.min("class").alias("class")).withColumn("asks", F.expr(asking)), "docs")
    reps = docs.groupBy("class").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"), F.count("*").alias("copies"))
    units = stage.write(rows.groupBy("class").agg(F.first("unit").alias("unit")).join(reps, "class"), "units")
    stage.drop("rows")
    placed = stage.write(_hashed(units, dim, tables, hashes, probes), "placed")
    own, further = placed.select(F.explode("home").alias("bucket"), "rep", "asks", F.lit(True).alias("stored"), "unit"), placed.select(F.explode("further").alias("bucket"), "rep", "asks", F.lit(False).alias("stored"), "unit")
    hashed = own.unionByName(further)

    sizes = placed.select(F.explode("home").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = stage.write(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("bucket", "blocks"), "large")
    n_large = large.count()
    if n_large:
        hashed = hashed.join(F.broadcast(large) if n_large <= MOST_BROADCAST else large, "bucket", "left")
        blocks = F.coalesce(F.col("blocks"), F.lit(1))
        # a stored vector belongs to one column of the grid and every row of it, a question to one row and every column
        own, every = F.pmod(F.xxhash64("rep"), blocks), F.sequence(F.lit(0), blocks - 1)
        stored = hashed.where("stored").withColumn("row", F.explode(every)).withColumn("col", own).withColumn("asks", F.lit(False))
        asked = hashed.where("asks").withColumn("row", own).withColumn("col", F.explode(every)).withColumn("stored", F.lit(False))
        hashed = stored.unionByName(asked).where(F.coalesce(F.col("blocks"), F.lit(1)) > 1).unionByName(hashed.where("blocks is null").withColumns({"row": F.lit(0), "col": F.lit(0)}), allowMissingColumns=True)
        work = F.xxhash64("bucket", "row", "col")
    else:
        work = F.col("bucket")
    hashed = hashed.select(work.alias("work"), "rep", "asks", "stored", "unit")
    near = hashed.repartition("work").sortWithinPartitions("work", F.desc("stored")).mapInArrow(_search(dim, k, least), "rep string, near string, cosine double")
    near = near.groupBy("rep", "near").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "near")
    near = stage.write(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("rep", "near", "cosine"), "near")

    stage.drop("large")
    # every class with its first k + 1 ids
    ids = docs.join(units.select("class", "rep", "copies"), "class")
    first = Window.partitionBy("rep").orderBy("id")
    heads = ids.where("copies > 1").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    own = heads.select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("cosine"))
    listed = near.unionByName(own).join(heads.select(F.col("rep").alias("near"), "ids"), "near", "left")
    listed = listed.select("rep", "cosine", F.explode(F.coalesce("ids", F.array("near"))).alias("near_id"))
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "near_id")
    listed = listed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = listed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "near_id", "cosine"))).alias("found"))
    each = ids.where("asks").select("id", "rep").join(listed, "rep")
    others = F.slice(F.filter("found", lambda x: x["near_id"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(others).alias("rank", "x")).select("id", F.col("x.near_id").alias("near_id"), F.col("x.cosine").alias("cosine"), (F.col("rank") + 1).alias("rank"))

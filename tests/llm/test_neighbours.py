import math

import numpy as np
import pytest

from quernstone.llm import neighbours as N


def brute(x, ids, k, least):
    n = np.sqrt((x * x).sum(1))
    u = (x / n[:, None]).astype(np.float32)
    cos = np.round((u @ u.T).astype(float), N.DIGITS)
    out = {}
    for i, name in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))[:k]
        out[name] = [(ids[j], cos[i, j]) for j in order if cos[i, j] >= least]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["near_id"], round(r["cosine"], 6)))
    return out


def clustered(n, dim, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 10, dim))
    return centres[r.integers(0, len(centres), n)] + 0.15 * r.standard_normal((n, dim))


def frame(spark, rows, extra=()):
    return spark.createDataFrame(rows, "docid string, encode array<float>, class string, rep string")


def test_recall_of_near_and_far(spark):
    x = clustered(1500, 64)
    ids = [f"d{i:05}" for i in range(len(x))]
    df = frame(spark, [(i, v.tolist(), "x", "y") for i, v in zip(ids, x, strict=True)])
    want = brute(x, ids, 10, 0.9)
    got = found(N.nearest(df, "docid", "encode", 10, 0.9))
    pairs = {(a, b) for a in want for b, _ in want[a]}
    assert len(pairs & {(a, b) for a in got for b, _ in got[a]}) >= 0.99 * len(pairs)
    far = brute(x, ids, 10, -1)
    got = found(N.nearest(df, "docid", "encode", 10, tables=6, hashes=1, probes=8, asking="id < 'd00150'"))
    assert set(got) == set(ids[:150])
    assert sum(len({b for b, _ in far[a]} & {b for b, _ in got[a]}) for a in got) >= 0.9 * 1500


def test_copies_ties_and_repeats(spark):
    r = np.random.default_rng(3)
    a, b = r.standard_normal(64), r.standard_normal(64)
    rows = [(f"a{i:03}", a.tolist(), None, None) for i in range(200)] + [(f"s{i}", (a * 4).tolist(), None, None) for i in range(3)] + [("b", b.tolist(), None, None)] * 3
    got = found(N.nearest(frame(spark, rows), "docid", "encode", 10, 0.9))
    assert "b" not in got  # it has no neighbour as near
    assert got["a000"] == [(f"a{i:03}", 1.0) for i in range(1, 11)]
    assert got["a150"] == [(f"a{i:03}", 1.0) for i in range(10)]
    assert [i for i, _ in got["s1"]] == [f"a{i:03}" for i in range(10)]
    assert all(len(v) == 10 for v in got.values())


def test_unusable_vectors(spark):
    v = [1.0] * 64
    rows = [("a", v, None, None), ("b", v, None, None), ("n", None, None, None), ("z", [0.0] * 64, None, None), ("nan", [math.nan] * 64, None, None), ("w", [1.0] * 63, None, None), ("inf", [math.inf] + [1.0] * 63, None, None), ("e", [], None, None), (None, v, None, None), ("h", [None] + [1.0] * 63, None, None)]
    assert found(N.nearest(frame(spark, rows), "docid", "encode", 10)) == {"a": [("b", 1.0)], "b": [("a", 1.0)]}
    assert N.nearest(frame(spark, []), "docid", "encode").count() == 0


def test_oversized_bucket_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    r = np.random.default_rng(5)
    x = np.concatenate((r.standard_normal(64) + 0.05 * r.standard_normal((300, 64)), clustered(600, 64, 6)))
    ids = [f"d{i:04}" for i in range(len(x))]
    want = brute(x, ids, 5, 0.9)
    got = found(N.nearest(frame(spark, [(i, v.tolist(), None, None) for i, v in zip(ids, x, strict=True)]), "docid", "encode", 5, 0.9, tables=10))
    pairs = {(a, b) for a in want for b, _ in want[a]}
    assert len(pairs & {(a, b) for a in got for b, _ in got[a]}) >= 0.99 * len(pairs)


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).standard_normal((5, 48)).astype(np.float32)
    y = N.Rotations(48, 1, 1).turn(x, 0)
    assert y.shape == (5, 64) and np.allclose((x * x).sum(1), (y * y).sum(1), rtol=1e-4)


@pytest.mark.parametrize("hashes", [1, 2])
def test_first_probe_is_the_own_bucket(hashes):
    x = np.random.default_rng(2).standard_normal((50, 64)).astype(np.float32)
    t = N.Rotations(64, 2, hashes)
    assert (t.probes(x, 1, 1)[:, 0] == t.probes(x, 1, 6)[:, 0]).all()
    assert all(len(set(r)) == 6 for r in t.probes(x, 1, 6).tolist())

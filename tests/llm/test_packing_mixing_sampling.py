import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quernstone.llm import mixing, packing, sampling


# ---- containers


@pytest.mark.parametrize("seed", range(12))
def test_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 4096])
    sizes = Counter(min(capacity, 1 + int(r.lognormvariate(r.choice([1, 3, 6]), 1))) for _ in range(r.choice([1, 40, 3000])))
    matches, n = packing.best_fit(dict(sizes), capacity)
    load, ranks = Counter(), Counter()
    for size, rank, count, first in matches:
        for i in range(count):
            load[first + i] += size
            ranks[size, rank + i] += 1
    assert max(load.values()) <= capacity and sorted(load) == list(range(n))
    assert ranks == Counter((s, i) for s, k in sizes.items() for i in range(k))
    total = sum(s * k for s, k in sizes.items())
    # first fit decreasing on the same sizes, for comparison
    gaps = []
    for s in sorted(sizes.elements(), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= s
        else:
            gaps.append(capacity - s)
    assert n >= -(-total // capacity) and n <= len(gaps) * 1.03 + 2


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, container string, place string, source string")


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, r.choice([5, 5, 5, 30, 61, 100]), None, None, None) for i in range(900)] + [(1000, 250, None, None, None), (1001, 200, None, None, None), (1002, 0, None, None, None), (1003, None, None, None, None), (None, 5, None, None, None)]
    df = docs(spark, rows + rows[:50])
    packed = packing.pack(df, capacity=100).collect()
    by, parts = Counter(), {}
    for x in packed:
        by[x["container"]] += x["n_tokens"]
        parts.setdefault(x["doc_id"], []).append(x)
    assert max(by.values()) <= 100
    sizes = {i: n for i, n, *_ in rows if i is not None and n is not None}
    assert {i: sum(x["n_tokens"] for x in p) for i, p in parts.items()} == sizes
    assert all(len(p) == 1 or sizes[i] > 100 for i, p in parts.items())
    assert sorted(x["n_tokens"] for x in parts[1000]) == [50, 100, 100] and len(parts[1001]) == 2
    assert len({x["container"] for x in packed if x["n_tokens"] == 100 and x["doc_id"] >= 1000}) == 4
    fill = packing.fill(packing.pack(df, capacity=100), 100).first()
    assert fill["n_tokens"] == sum(sizes.values()) and fill["unused"] == fill["n_containers"] * 100 - fill["n_tokens"]
    assert packing.pack(df.where("false")).count() == 0
    assert sorted(map(tuple, packed)) == sorted(map(tuple, packing.pack(df.repartition(5), capacity=100).collect()))
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


# ---- mixes


@pytest.mark.parametrize("seed", range(30))
def test_knapsack(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(5)}
    budget = r.randint(0, 120)
    reach = {0}
    for s, n in counts.items():
        reach = {x + s * k for x in reach for k in range(n + 1)}
    take = mixing.knapsack(counts, budget)
    assert all(n <= counts[s] for s, n in take.items())
    assert sum(s * n for s, n in take.items()) == max(x for x in reach if x <= budget)


@pytest.mark.parametrize("seed", range(10))
def test_fit(seed):
    r = random.Random(seed)
    counts = dict(Counter(1 + int(r.lognormvariate(5, 1)) for _ in range(5000)))
    total = sum(s * n for s, n in counts.items())
    budget = r.randint(0, total)
    take = mixing.fit(counts, budget, seed)
    assert all(0 < n <= counts[s] for s, n in take.items()) and sum(s * n for s, n in take.items()) == budget


@pytest.mark.parametrize("seed", range(60))
def test_fit_reaches_what_the_programme_over_all_reaches(seed):
    r = random.Random(seed)
    counts = {r.choice([r.randint(1, 60), r.randint(1000, 20_000)]): r.randint(1, 8) for _ in range(r.randint(1, 6))}
    budget = r.randint(0, sum(s * n for s, n in counts.items()))
    size = lambda take: sum(s * n for s, n in take.items())
    assert size(mixing.fit(counts, budget, seed)) == size(mixing.knapsack(counts, budget)) <= mixing.ceiling(counts, budget) <= budget


def test_fit_takes_back_the_proportional_step_and_knows_gaps():
    assert mixing.fit({5000: 10, 7001: 10}, 40_000) == {5000: 8}
    assert sum(s * n for s, n in mixing.fit({1000: 10**6, 1: 3}, 5 * 10**8 + 500).items()) == 5 * 10**8 + 3


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, r.randint(1, 60), None, None, "big") for i in range(2000)] + [(5000 + i, 10, None, None, "small") for i in range(20)] + [(7000, 0, None, None, "small"), (7001, None, None, None, "small"), (7002, 5, None, None, None), (None, 5, None, None, "big")]
    df = docs(spark, rows + rows[:100])
    targets = spark.createDataFrame([(1, "big", 60, 1), (1, "small", 2, 10), (2, "big", 50, 3), (2, "small", 50, 4), (2, "absent", 5, 1), (3, None, 5, 1), (3, "small", None, 1), (1, "small", 2, 10)], "mix_id int, source string, weight_pct int, max_repeats int")
    used, report = mixing.mix(df, targets)
    sizes = {"big": sum(n for _, n, _, _, s in rows if s == "big" and _ is not None and n) - 0, "small": 200, "absent": 0}
    sizes["big"] = sum(n for i, n, _, _, s in rows if s == "big" and i is not None)
    got = {(x["mix_id"], x["source"]): x for x in report.collect()}
    assert set(got) == {(1, "big"), (1, "small"), (2, "big"), (2, "small"), (2, "absent")}
    size = sizes["big"] + 200
    for (m, s), x in got.items():
        assert x["target_tokens"] == pytest.approx(size * x["weight_pct"] / 100)
        assert x["short"] == (sizes[s] * x["max_repeats"] < x["target_tokens"])
        assert x["actual_tokens"] == (sizes[s] * x["max_repeats"] if x["short"] else math.ceil(x["target_tokens"])) or (s == "small" and x["actual_tokens"] >= x["target_tokens"] - 10)
    sums = {(x["mix_id"], x["source"]): (x["n"], x["m"]) for x in used.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n"), F.max("n_uses").alias("m")).collect()}
    for key, (n, most) in sums.items():
        assert n == got[key]["actual_tokens"] and most <= got[key]["max_repeats"]
    assert used.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    empty, none = mixing.mix(df.where("false"), targets)
    assert empty.count() == 0 and none.count() == 5


def test_short_is_a_source_without_uses_left(spark):
    df = docs(spark, [(i, 10, None, None, "abc"[i % 3]) for i in range(90)])
    targets = spark.createDataFrame([(1, "a", 90, 2), (1, "b", 5, 1), (1, "c", 5, 1)], "mix_id int, source string, weight_pct int, max_repeats int")
    short = lambda: {r["source"] for r in mixing.mix(df, targets)[1].where("short").collect()}
    assert short() == {"a"}
    left = mixing.mix(df, targets)[1].where("source = 'b'").first()
    assert left["actual_tokens"] == 40 and not left["short"]  # 45 can't be met with tens, but documents are left


# ---- samples


def demands(targets, sample):
    return {c: (Fraction(p * sample, 100), least) for c, (p, least) in targets.items()}


def test_quotas_keep_targets_and_floors():
    cells = {("en", "x"): 500, ("en", "y"): 500, ("fr", "x"): 10, ("fr", None): 5, (None, "x"): 100, ("de", "y"): 300}
    quota, demand, lacking = sampling.quotas(cells, demands({"en": (50, 1), "fr": (30, 1), "de": (10, 40), "pt": (10, 2)}, 199))
    by = Counter()
    for (c, _), q in quota.items():
        by[c] += q
    assert demand == {"en": 100, "fr": 60, "de": 40, "pt": 20}
    assert by == {"en": 100, "fr": 15, "de": 40} and lacking == {"en": 0, "fr": 45, "de": 0, "pt": 20}
    assert all(q <= cells[k] for k, q in quota.items())


@pytest.mark.parametrize("seed", range(8))
def test_quotas_are_proportional(seed):
    """Every cell within a row of its share of its category, every attribute within a row of the sum of its shares."""
    r = random.Random(seed)
    cells = {(c, a): r.randint(1, 500) for c in "pqrstuv" for a in range(12)}
    have = Counter()
    for (c, _), n in cells.items():
        have[c] += n
    targets = {c: (Fraction(r.randint(0, 11 * have[c]), 10), 0) for c in have}
    quota, demand, lacking = sampling.quotas(cells, targets, seed)
    columns, exact = Counter(), Counter()
    for (c, a), n in cells.items():
        share = (demand[c] - lacking[c]) * n / have[c]
        assert abs(quota[c, a] - share) < 1 + 1e-9 and quota[c, a] <= n
        columns[a] += quota[c, a]
        exact[a] += share
    for c in have:
        assert sum(q for (x, _), q in quota.items() if x == c) == demand[c] - lacking[c] == min(have[c], demand[c])
        assert (lacking[c] > 0) == (targets[c][0] > have[c])
    assert all(abs(columns[a] - exact[a]) < 1 + 1e-6 for a in columns)
    assert quota == sampling.quotas(cells, targets, seed)[0] and quota != sampling.quotas(cells, targets, seed + 100)[0]


def test_rounding_is_unbiased():
    exact = {("x", "a"): Fraction(1, 3), ("x", "b"): Fraction(2, 3), ("y", "a"): Fraction(7, 4), ("y", "b"): Fraction(1, 4)}
    got = Counter()
    for i in range(3000):
        got.update(sampling.rounded(exact, i))
    assert all(abs(got[k] / 3000 - x) < 0.04 for k, x in exact.items())


@pytest.mark.parametrize("seed", range(10))
def test_flow_against_brute_force(seed):
    """The cheapest of all greatest flows in small networks."""
    r = random.Random(seed)
    arcs = [("s", c, r.randint(0, 3), 0) for c in "pq"] + [(c, a, r.randint(0, 3), r.randint(0, 3)) for c in "pq" for a in "uv"] + [(a, "t", r.randint(0, 4), r.randint(0, 3)) for a in "uv"]
    flow = sampling.Flow()
    numbers = [flow.arc(*x) for x in arcs]
    flow.run("s", "t")
    carried = [flow.carried(e) for e in numbers]
    best = None
    for f in itertools.product(*(range(x[2] + 1) for x in arcs[2:6])):
        (pu, pv, qu, qv) = f
        if pu + pv <= arcs[0][2] and qu + qv <= arcs[1][2] and pu + qu <= arcs[6][2] and pv + qv <= arcs[7][2]:
            cost = sum(n * x[3] for n, x in zip(f, arcs[2:6], strict=True)) + (pu + qu) * arcs[6][3] + (pv + qv) * arcs[7][3]
            best = min(best or (1, 0), (-sum(f), cost))
    assert best == (-sum(carried[:2]), sum(n * x[3] for n, x in zip(carried, arcs, strict=True)))


def test_unmet_is_read_from_the_slack(spark, monkeypatch):
    records = spark.createDataFrame([(i, "en", "a") for i in range(10)], "rec_id long, category string, attribute string")
    targets = spark.createDataFrame([(1, 100, "en", 50, 1)], "plan_id int, sample_pct int, category string, target_pct int, min_rows int")
    assert not sampling.stratified(records, targets)[1].first()["unmet"]
    monkeypatch.setattr(sampling.Flow, "carried", lambda self, arc: self.room[arc])
    assert sampling.stratified(records, targets)[1].first()["unmet"]


def test_stratified(spark):
    rows = [(i, "en" if i % 3 else "fr", "ab"[i % 2], "q") for i in range(3000)] + [(5000 + i, None, "a", "q") for i in range(100)] + [(6000 + i, "ko", None, "q") for i in range(9)] + [(None, "en", "a", "q")]
    records = spark.createDataFrame(rows + rows[:200], "rec_id long, category string, attribute string, place string")
    targets = spark.createDataFrame([(1, 10, "en", 50, 5), (1, 10, "fr", 40, 5), (1, 10, "ko", 10, 5), (2, 20, "pt", 0, 3), (2, 20, "en", 100, 1), (3, None, "en", 1, 1), (1, 10, "en", 50, 5)], "plan_id int, sample_pct int, category string, target_pct int, min_rows int")
    sample, report = sampling.stratified(records, targets)
    got = {(r["plan_id"], r["category"]): r for r in report.collect()}
    assert {k: (r["n_available"], r["n_drawn"], r["short"], r["unmet"]) for k, r in got.items()} == {(1, "en"): (2000, 156, 0, False), (1, "fr"): (1000, 125, 0, False), (1, "ko"): (9, 9, 23, True), (2, "pt"): (0, 0, 3, True), (2, "en"): (2000, 622, 0, False)}
    drawn = sample.collect()
    assert Counter((r["plan_id"], r["category"]) for r in drawn) == Counter({k: r["n_drawn"] for k, r in got.items() if r["n_drawn"]})
    assert len({(r["plan_id"], r["rec_id"]) for r in drawn}) == len(drawn)
    again = sampling.stratified(records.repartition(6), targets)[0].collect()
    assert sorted((r["plan_id"], r["rec_id"]) for r in again) == sorted((r["plan_id"], r["rec_id"]) for r in drawn)
    none = sampling.stratified(records.where("false"), targets)
    assert none[0].count() == 0 and none[1].where("unmet").count() == 5
    assert sampling.stratified(records, targets.where("false"))[1].count() == 0

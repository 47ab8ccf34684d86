"""Problem 8: records of several sources mixed to target shares of the total size.

Documents are counted by source and exact length. A source's budget is met by whole
rounds of all its documents, then a subset: counts of each length in proportion, and
bounded-knapsack dynamic programming over the remaining budget. The programme may take back
what the proportional step took: it works on a window of the budget that grows until a total is
reached that no other can exceed, or the window holds the whole budget. One task of an executor fits one
source of a mix. The counts are drawn by a seeded rank inside each length.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.ranking import ranked
from quernstone.plans.staging import Stage, checked_broadcast

WINDOW = 16_384  # tokens of budget that the dynamic programme begins with
MOST_WINDOW = 1 << 24  # a window that misses the best total is not made wider than this
MOST_BROADCAST = 100_000  # sources whose names are broadcast


def knapsack(counts: dict[int, int], budget: int, goal: int | None = None) -> dict[int, int]:
    """How many of each length, at most ``counts``, so that the total is the largest up to ``budget``.

    goal: a total that is known to be the largest; what reaches it ends the programme.
    """
    goal = budget if goal is None else goal
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    step_of = np.full(budget + 1, -1, np.int32)  # the step that reached a total first
    for s, n in sorted(counts.items()):
        n = min(n, budget // s) if s > 0 else 0
        times = 1
        while n > 0 and not reach >> goal & 1:  # 1, 2, 4, … and the rest make every number up to n
            times = min(times, n)
            new = (reach << (s * times)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                step_of[np.flatnonzero(bits)] = len(steps)
                steps.append((s, times))
                reach |= new
            n -= times
            times *= 2
    total = goal if reach >> goal & 1 else reach.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    while total:
        s, times = steps[step_of[total]]
        out[s] += times
        total -= s * times
    return dict(out)


def ceiling(counts: dict[int, int], budget: int) -> int:
    """A total up to ``budget`` that none of the documents' sums up to it can exceed.

    All sums are, modulo the length that holds most tokens, sums of the other documents; the totals with such a
    remainder are the only ones possible.
    """
    main = max(counts, key=lambda s: (s * counts[s], s))
    full, reach = (1 << main) - 1, 1
    for s, n in counts.items():
        times = 1
        while n > 0 and s % main and not reach >> (budget % main) & 1:
            times = min(times, n)
            by = s * times % main
            reach |= (reach << by | reach >> (main - by)) & full
            n, times = (n - times, times * 2) if times < main else (0, 1)
    low = reach & ((1 << (budget % main + 1)) - 1)
    return budget - budget % main + (low.bit_length() - 1)


def fit(counts: dict[int, int], budget: int, seed: object = 0) -> dict[int, int]:
    """How many documents of each length to take once: the largest total up to ``budget``, over all lengths alike.

    The window doubles until the programme reaches the ``ceiling``, or nothing is left that the
    proportional step took, or it is ``MOST_WINDOW`` tokens wide.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return dict(counts)
    best = ceiling(counts, budget)
    order = sorted(counts)
    random.Random(str(seed)).shuffle(order)
    take = {s: n * budget // total for s, n in counts.items()}
    rest, window = budget - sum(s * n for s, n in take.items()), WINDOW
    for most in (1, budget):  # a document of each length, then as many as fit
        for s in order:
            more = max(0, min(counts[s] - take[s], (rest - window // 2) // s, most))
            take[s] += more
            rest -= s * more
    divisor = 0
    for s in sorted(counts, key=lambda s: (-counts[s], s)):  # without these few, sums may miss a remainder
        if math.gcd(divisor, s) != divisor:
            divisor, back = math.gcd(divisor, s), min(2, take[s])
            take[s] -= back
            rest += s * back
    while True:
        for part in (8, 2, 1):  # gives back an eighth of each length, a half, all
            for s in order:
                if rest < window and take[s]:
                    back = min(-(-take[s] // part), -(-(window - rest) // s))
                    take[s] -= back
                    rest += s * back
        found = knapsack({s: counts[s] - take[s] for s in counts}, rest, rest - (budget - best))
        left = rest - sum(s * n for s, n in found.items())
        if left == budget - best or not any(take.values()) or window >= MOST_WINDOW:
            for s, n in found.items():
                take[s] += n
            return {s: n for s, n in take.items() if n}
        window *= 2


def mix(documents: DataFrame, targets: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """The documents of every mix with their uses, and the report of actual shares.

    documents: ``doc_id, source, n_tokens``; targets: ``mix_id, source, weight_pct,
    max_repeats``. The size of a mix is that of all documents of all its sources used once.
    Repeated ids count once; documents without source or size are left
    out, those of size 0 are used in whole rounds only. Targets with a null or a negative
    number are left out; of a repeated (mix, source) the largest weight holds. Returns ``mix_id, source, doc_id,
    n_tokens, n_uses`` (uses above 0) and ``mix_id, source, weight_pct, max_repeats,
    available_tokens, target_tokens, actual_tokens, actual_pct, short``. The budget is the
    target rounded up, or all uses of the source; ``short`` says that the fitted documents
    stay under the exact target with no use of the source left.
    """
    stage = Stage(documents.sparkSession, "mixing")
    wanted = targets.where("mix_id is not null and source is not null and weight_pct >= 0 and max_repeats >= 0").groupBy("mix_id", "source").agg(F.max(F.struct("weight_pct", "max_repeats")).alias("x"))
    wanted = stage.write(wanted.select("mix_id", "source", F.col("x.weight_pct").cast("double").alias("weight_pct"), F.col("x.max_repeats").alias("max_repeats")), "targets")
    names = checked_broadcast(wanted.select("source").distinct(), MOST_BROADCAST)
    kept = documents.where("doc_id is not null and n_tokens >= 0").join(names, "source", "left_semi").groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("x"))
    kept = stage.write(kept.select("doc_id", "x.source", F.col("x.n_tokens").cast("long").alias("n_tokens")), "documents")
    counts = stage.write(kept.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "lengths")

    totals = counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("have"))
    sized = wanted.join(totals, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    sized = sized.withColumn("target", F.sum("have").over(Window.partitionBy("mix_id")).cast("decimal(20,0)") * F.col("weight_pct").cast("decimal(10,4)") / 100)
    sized = sized.withColumn("budget", F.least(F.ceil("target").cast("long"), F.col("have") * F.col("max_repeats")))
    sized = stage.write(sized.withColumn("rounds", F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("have")), "budgets")

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One source of one mix: a row for each of its different lengths."""
        found = fit(dict(zip(rows["n_tokens"].tolist(), rows["n"].tolist(), strict=True)), int(rows["rest"].iloc[0]), f"{seed} {key[0]} {key[1]}")
        return pd.DataFrame({"mix_id": key[0], "source": key[1], "n_tokens": pd.Series(list(found), dtype="int64"), "extra": pd.Series(list(found.values()), dtype="int64")})

    ids = f"mix_id {wanted.schema['mix_id'].dataType.simpleString()}, source string, n_tokens long, extra long"
    extra = sized.where("rest > 0").select("mix_id", "source", "rest").join(counts, "source").groupBy("mix_id", "source").applyInPandas(fitted, ids)
    quota = sized.select("mix_id", "source", "rounds").join(counts.drop("n"), "source").join(extra, ["mix_id", "source", "n_tokens"], "left")
    quota = stage.write(quota.select("mix_id", "source", "n_tokens", "rounds", F.coalesce("extra", F.lit(0)).alias("extra")).where("rounds > 0 or extra > 0"), "quotas")
    places = ranked(kept, ["source", "n_tokens"], ["doc_id"], seed)
    used = places.join(quota, ["source", "n_tokens"]).withColumn("n_uses", (F.col("rounds") + (F.col("place") < F.col("extra")).cast("int")).cast("int")).where("n_uses > 0")

    more = quota.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("extra")).alias("more"))
    made = sized.join(more, ["mix_id", "source"], "left").withColumn("actual_tokens", F.col("rounds") * F.col("have") + F.coalesce("more", F.lit(0)))
    none_left = F.col("actual_tokens") == F.col("have") * F.col("max_repeats")
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    made = made.withColumn("short", none_left & (F.col("actual_tokens").cast("decimal(20,0)") < F.col("target"))).withColumn("actual_pct", F.when(whole > 0, F.col("actual_tokens") * 100 / whole))
    made = made.select("mix_id", "source", "weight_pct", "max_repeats", F.col("have").alias("available_tokens"), F.col("target").cast("double").alias("target_tokens"), "actual_tokens", "actual_pct", "short")
    return used.select("mix_id", "source", "doc_id", "n_tokens", "n_uses"), made

"""Problem 4: samples whose shares of each category match target proportions.

Records are counted by category and a second attribute (cells). For each plan a min-cost
flow runs from the categories over their cells to the attributes: arcs carry the
categories' targets and floors and the cells' availability, and a dear slack arc of each
category carries what can't be met. What the flow serves of a category is spread over its
cells in proportion to their rows; each cell's quota is that share rounded down or up, drawn at random on
the network of the fractional parts, so that categories keep their sums and attributes theirs but for one row.
The rows of a quota are drawn by a seeded random rank inside each cell.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranking import ranked
from quernstone.plans.staging import Stage

MOST_CELLS = 200_000  # cells and targets that come to the driver


class Flow:
    """Min-cost flow by shortest augmenting paths."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.arcs: dict[int, list[int]] = defaultdict(list)
        self.names: dict[object, int] = {}

    def node(self, name: object) -> int:
        return self.names.setdefault(name, len(self.names))

    def arc(self, a: object, b: object, room: int, cost: int = 0) -> int:
        u, v = self.node(a), self.node(b)
        for x, y, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def carried(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: object, sink: object) -> None:
        """Sends all that fits, the cheapest first (costs aren't negative): blocking flows over the shortest paths of each cost."""
        s, t, n = self.node(source), self.node(sink), len(self.names)
        potential = [0] * n
        while True:
            dist: list[int | None] = [None] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.arcs[u]:
                    v = self.to[e]
                    if self.room[e] > 0:
                        far = d + self.cost[e] + potential[u] - potential[v]
                        if dist[v] is None or far < dist[v]:
                            dist[v] = far
                            heapq.heappush(heap, (far, v))
            if dist[t] is None:
                return
            far = max(d for d in dist if d is not None)
            for v in range(n):
                potential[v] += far if dist[v] is None else dist[v]
            while self._block(s, t, n, potential):
                pass

    def _block(self, s: int, t: int, n: int, potential: list[int]) -> bool:
        """Saturates the arcs without reduced cost level by level; False if they don't reach the sink."""
        level, todo = [-1] * n, [s]
        level[s] = 0
        for u in todo:
            for e in self.arcs[u]:
                v = self.to[e]
                if level[v] < 0 and self.room[e] > 0 and self.cost[e] + potential[u] == potential[v]:
                    level[v] = level[u] + 1
                    todo.append(v)
        if level[t] < 0:
            return False
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                amount = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
                while path and self.room[path[-1]] == 0:
                    path.pop()
                full = next((i for i, e in enumerate(path) if self.room[e] == 0), len(path))
                del path[full:]
                u = self.to[path[-1]] if path else s
            elif at[u] < len(self.arcs[u]):
                e = self.arcs[u][at[u]]
                v = self.to[e]
                if self.room[e] > 0 and level[v] == level[u] + 1 and self.cost[e] + potential[u] == potential[v]:
                    path.append(e)
                    u = v
                else:
                    at[u] += 1
            elif path:
                u = self.to[path.pop() ^ 1]
                at[u] += 1
            else:
                return True


def rounded(exact: dict[tuple, Fraction], seed: object = 0) -> dict[tuple, int]:
    """Each cell's exact number rounded down or up at random, up as often as its fraction says.

    The sums of each category are whole and stay as they are, those of each attribute are rounded down or up. On the
    network of the cells' fractions a cycle is raised and lowered in turn until one of its cells is whole, at random in
    the direction that keeps every cell's expectation; there is a cycle as long as a cell has a fraction.
    """
    out = {k: int(x) for k, x in exact.items()}
    ends, part, keys = [], [], []
    beyond: dict = defaultdict(Fraction)
    for k in sorted(exact, key=str):
        if f := exact[k] - out[k]:
            ends.append((("category", k[0]), ("attribute", k[1])))
            part.append(float(f))
            keys.append(k)
            beyond[k[1]] += f
    for a in sorted(beyond, key=str):  # makes the attributes' sums whole too
        if f := -beyond[a] % 1:
            ends.append(("rest", ("attribute", a)))
            part.append(float(f))
            keys.append(None)
    draw, tiny = random.Random(str(seed)), 1e-9
    open_ = [True] * len(ends)
    around: dict = defaultdict(list)
    for e, (u, v) in enumerate(ends):
        around[u].append(e)
        around[v].append(e)
    for edges in around.values():
        draw.shuffle(edges)

    def leave(node: object, came: int) -> int:
        """Another open edge of a node than the one that led there; -1 if there is none."""
        edges = around[node]
        for back in (1, 2):
            while len(edges) >= back and not open_[edges[-back]]:
                del edges[-back]
            if len(edges) >= back and edges[-back] != came:
                return edges[-back]
        return -1

    def settle(e: int) -> None:
        if part[e] <= tiny or part[e] >= 1 - tiny:
            part[e], open_[e] = float(round(part[e])), False

    for first in range(len(ends)):
        nodes, path, seen = [ends[first][0]], [], {ends[first][0]: 0}
        while nodes and open_[first]:
            e = leave(nodes[-1], path[-1] if path else -1)
            if e < 0:  # the rounding of the sums left one edge
                if not path:
                    break
                last = path.pop()
                seen.pop(nodes.pop())
                part[last], open_[last] = float(round(part[last])), False
                continue
            u, v = ends[e]
            node = v if u == nodes[-1] else u
            path.append(e)
            if node not in seen:
                seen[node] = len(nodes)
                nodes.append(node)
                continue
            start = seen[node]
            up, down = path[start::2], path[start + 1 :: 2]
            more = min(min(1 - part[x] for x in up), min(part[x] for x in down))
            less = min(min(part[x] for x in up), min(1 - part[x] for x in down))
            step = more if draw.random() * (more + less) < less else -less
            for sign, edges in ((1, up), (-1, down)):
                for x in edges:
                    part[x] += sign * step
                    settle(x)
            del path[start:]
            for x in nodes[start + 1 :]:
                del seen[x]
            del nodes[start + 1 :]
    for k, p in zip(keys, part, strict=True):
        if k is not None:
            out[k] += round(p)
    return out


def quotas(cells: dict[tuple, int], targets: dict[str, tuple[Fraction, int]], seed: object = 0) -> tuple[dict[tuple, int], dict[str, int], dict[str, int]]:
    """Quota of each cell (category, attribute), the categories' demands, and what each demand lacks.

    targets: category -> (exact rows, least rows). A demand is the exact number rounded up, or the least if that is more.
    """
    demand = {c: max(-(-x.numerator // x.denominator), least) for c, (x, least) in targets.items()}
    own = {k: n for k, n in cells.items() if k[0] in demand and n > 0}
    flow, slack, arcs = Flow(), {}, defaultdict(list)
    for c in sorted(demand):
        flow.arc("source", ("category", c), demand[c])
        slack[c] = flow.arc(("category", c), "sink", demand[c], 1)  # what isn't there
    for (c, a), n in sorted(own.items(), key=str):
        arcs[c].append(flow.arc(("category", c), ("attribute", a), n))
    rows: dict = defaultdict(int)
    for (c, a), n in own.items():
        rows["attribute", a] += n
        rows["category", c] += n
    for kind, a in sorted((x for x in rows if x[0] == "attribute"), key=str):
        flow.arc((kind, a), "sink", rows[kind, a])
    flow.run("source", "sink")
    served = {c: sum(map(flow.carried, arcs[c])) for c in demand}
    exact = {(c, a): Fraction(served[c] * n, rows["category", c]) for (c, a), n in own.items()}
    return rounded(exact, seed), demand, {c: flow.carried(e) for c, e in slack.items()}


def stratified(records: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The drawn records of every plan and the report on its targets.

    records: ``rec_id, category, attribute``, with null for "no category" (counted, never
    drawn) and for "no attribute" (an attribute of its own). targets: ``plan_id,
    sample_pct, category, target_pct, min_rows``. Repeated ids count once; rows of targets with a
    null are left out and of repeated ones the largest holds. A plan's size is ``sample_pct`` percent of all records. Returns
    ``plan_id, rec_id, category, attribute`` and ``plan_id, category, target_pct, min_rows,
    n_available, n_target, n_drawn, short, unmet``: the target is rounded up, or the floor; ``short`` is what
    the flow sends over the category's slack arc, and ``unmet`` whether it sends any there, which it does if and only
    if there are fewer records than the exact, unrounded target or the floor.
    """
    spark = records.sparkSession
    stage = Stage(spark, "sampling")
    once = records.where("rec_id is not null").groupBy("rec_id").agg(F.min(F.struct("category", "attribute")).alias("x")).select("rec_id", "x.category", "x.attribute")
    once = stage.write(once, "records")
    counted = once.groupBy("category", "attribute").count().limit(MOST_CELLS + 1).collect()
    rows = targets.where("plan_id is not null and sample_pct >= 0 and category is not null and target_pct >= 0 and min_rows >= 0").groupBy("plan_id", "category").agg(F.max(F.struct("sample_pct", "target_pct", "min_rows")).alias("x")).limit(MOST_CELLS + 1).collect()
    if max(len(counted), len(rows)) > MOST_CELLS:
        raise ValueError("too many cells or targets")
    cells = {(r["category"], r["attribute"]): r["count"] for r in counted}
    n = sum(cells.values())
    have: dict = defaultdict(int)
    for (c, _), k in cells.items():
        have[c] += k
    drawn, report = [], []
    plans: dict = defaultdict(dict)
    for r in rows:
        plans[r["plan_id"]][r["category"]] = r["x"]
    for plan in sorted(plans):
        exact = {c: (Fraction(x["target_pct"] * x["sample_pct"] * n, 10_000), x["min_rows"]) for c, x in plans[plan].items()}
        quota, demand, lacking = quotas(cells, exact, f"{seed} {plan}")
        drawn += [(plan, c, a, q) for (c, a), q in quota.items() if q]
        got: dict = defaultdict(int)
        for (c, _), q in quota.items():
            got[c] += q
        report += [(plan, c, x["target_pct"], x["min_rows"], have[c], demand[c], got[c], lacking[c], lacking[c] > 0) for c, x in plans[plan].items()]
    quota = spark.createDataFrame(drawn, "plan_id int, category string, attribute string, quota long")
    places = ranked(once.where("category is not null"), ["category", "attribute"], ["rec_id"], seed)
    same = places["category"].eqNullSafe(quota["category"]) & places["attribute"].eqNullSafe(quota["attribute"]) & (places["place"] < quota["quota"])
    sample = places.join(F.broadcast(quota) if len(drawn) <= MOST_CELLS else quota, same).select("plan_id", "rec_id", places["category"], places["attribute"])
    made = spark.createDataFrame(report, "plan_id int, category string, target_pct int, min_rows int, n_available long, n_target long, n_drawn long, short long, unmet boolean")
    return sample, made

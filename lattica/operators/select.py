"""Ordered selection by windows, and constrained selection by exact flows on the driver.

The programmes work on candidates: one row an eligible group with its taxon and observer.
Their number is bounded by the study, not by the fact table, and checked before anything
is collected (`most`).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import stable_hex
from lattica.operators.numbering import numbered


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; a rank filter, so partitions keep k rows before the exchange."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def compact_candidates(rows: DataFrame, observer: str, key: str, seed: int, cap: int) -> DataFrame:
    """One row an observer by one stable key, then the first `cap` by another."""
    one = top_per_group(rows, [observer], [stable_hex(F.lit(seed), F.lit("observer"), F.col(observer), F.col(key)), key], 1)
    return one.withColumn("order_key", stable_hex(F.lit(seed), F.lit("order"), F.col(key))).orderBy("order_key", key).limit(cap).drop("order_key")


def priority_rank(rows: DataFrame, current: DataFrame, name: str, near: str, far: str, key: str) -> DataFrame:
    """Rows not in current, 0 if they share `near` with it, 1 if `far`, else 2; place orders them by priority and key."""
    left = rows.join(current.select(name), name, "left_anti")
    nears = current.select(near).distinct().withColumn("is_near", F.lit(True))
    fars = current.select(far).distinct().withColumn("is_far", F.lit(True))
    ranked = left.join(nears, near, "left").join(fars, far, "left").withColumn("priority", F.when(F.col("is_near"), 0).when(F.col("is_far"), 1).otherwise(2)).drop("is_near", "is_far")
    return numbered(ranked, ["priority", key], "place")


class Flow:
    """Min-cost flow with integer costs, by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int, want: int) -> tuple[int, int]:
        """(flow, cost) of as much as possible up to want, at least cost."""
        n, flow, cost = len(self.out), 0, 0
        potential = [0] * n
        self._settle(source, potential)
        while flow < want:
            distance, came = [None] * n, [-1] * n
            distance[source] = 0
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > distance[x]:
                    continue
                for e in self.out[x]:
                    if self.left[e]:
                        y, nd = self.to[e], d + self.cost[e] + potential[x] - potential[self.to[e]]
                        if distance[y] is None or nd < distance[y]:
                            distance[y], came[y] = nd, e
                            heapq.heappush(heap, (nd, y))
            if distance[sink] is None:
                break
            for i, d in enumerate(distance):
                if d is not None:
                    potential[i] += d
            step, x = want - flow, sink
            while x != source:
                step = min(step, self.left[came[x]])
                x = self.to[came[x] ^ 1]
            x = sink
            while x != source:
                e = came[x]
                self.left[e] -= step
                self.left[e ^ 1] += step
                cost += step * self.cost[e]
                x = self.to[e ^ 1]
            flow += step
        return flow, cost

    def _settle(self, source: int, potential: list[int]) -> None:
        """Potentials where first costs are negative (Bellman-Ford); none are needed otherwise."""
        if not any(c < 0 and left for c, left in zip(self.cost, self.left, strict=True)):
            return
        far = [None] * len(potential)
        far[source] = 0
        for _ in range(len(potential)):
            moved = False
            for x, es in enumerate(self.out):
                if far[x] is not None:
                    for e in es:
                        if self.left[e] and (far[self.to[e]] is None or far[x] + self.cost[e] < far[self.to[e]]):
                            far[self.to[e]] = far[x] + self.cost[e]
                            moved = True
            if not moved:
                break
        for i, d in enumerate(far):
            potential[i] = d or 0


def bounded_selection(candidates: DataFrame, lower: dict[int, int], upper: dict[int, int], total: int, capacity: int, seed: int, most: int = 200_000) -> DataFrame:
    """The candidates (taxon, observer, observation) of least stable-key cost with lower to upper groups a taxon, `total` in all, at most `capacity` an observer. Taxa and observers make a network, so the flow's optimum is the programme's; raises if there is none. Of a taxon and observer no more than `capacity` are chosen, so only that many of least cost are collected, and `most` bounds those."""
    spark = candidates.sparkSession
    cost = F.conv(F.substring(stable_hex(F.lit(seed), F.col("observation")), 1, 8), 16, 10).cast("long")
    priced = candidates.select("taxon", "observer", "observation", cost.alias("cost"))
    rows = sorted(tuple(r) for r in top_per_group(priced, ["taxon", "observer"], ["cost", "observation"], capacity).limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates that can be chosen; an exact flow is meant for up to {most}")
    taxa, observers = sorted(upper), sorted({r[1] for r in rows})
    at = {("t", t): 2 + i for i, t in enumerate(taxa)} | {("o", o): 2 + len(taxa) + i for i, o in enumerate(observers)}
    must = -(1 << 44)  # a taxon's first `lower` groups come before any saving
    f = Flow(2 + len(at))
    firsts = [f.edge(0, at["t", t], lower[t], must) for t in taxa]
    for t in taxa:
        f.edge(0, at["t", t], upper[t] - lower[t], 0)
    for o in observers:
        f.edge(at["o", o], 1, capacity, 0)
    named = {f.edge(at["t", t], at["o", o], 1, c): (t, o, g) for t, o, g, c in rows if t in upper}
    flow, _ = f.run(0, 1, total)
    if flow < total or any(f.left[e] for e in firsts):
        raise ValueError("no selection meets the bounds")
    chosen = [x for e, x in named.items() if not f.left[e]]
    return spark.createDataFrame(sorted(chosen), "taxon long, observer long, observation long")


def balanced_selection(candidates: DataFrame, target: dict[int, int], capacity: int, seed: int) -> DataFrame:
    """Exactly target[taxon] groups of each taxon."""
    return bounded_selection(candidates, target, target, sum(target.values()), capacity, seed)


def targets(available: DataFrame, fixed: int | None, low: int, high: int) -> DataFrame:
    """taxon, lower, upper from the number of available groups: fixed for all, or low to high as far as there are any."""
    if fixed is not None:
        return available.select("taxon", F.lit(fixed).alias("lower"), F.lit(fixed).alias("upper"))
    return available.select("taxon", F.least(F.lit(low), "groups").cast("int").alias("lower"), F.least(F.lit(high), "groups").cast("int").alias("upper"))


def observer_split(groups: DataFrame, fractions: dict[str, float], seed: int, most: int = 200_000, rare: int = 50) -> DataFrame:
    """observer, split: whole observers, large ones first, each to the split whose taxon shares it brings closest to the wanted ones; then single moves while they help and leave every taxon in every split where it can be. A heuristic: no optimum is claimed. Beyond `most` cells of observer and taxon, observers are dealt to blocks of about that many, each split by itself in a task: shares that are near in every block are near in all. So that a taxon can come into every split, the observers of one with at most `rare` a block share a block (an observer's rarest taxon decides). groups: observer, taxon."""
    counts = groups.groupBy("observer", "taxon").agg(F.count("*").alias("n"))
    blocks = max(1, -(-counts.count() // most))
    kinds = counts.groupBy("taxon").agg(F.count("*").alias("observers"))
    own = counts.join(kinds, "taxon").groupBy("observer").agg(F.min(F.struct("observers", "taxon")).alias("rarest"), F.array_sort(F.collect_list(F.struct("taxon", "n"))).alias("cells"))
    block = F.when(F.col("rarest.observers") <= rare * blocks, F.xxhash64("rarest.taxon")).otherwise(F.xxhash64("observer"))
    kind = groups.schema["observer"].dataType.simpleString()

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("order_key")
        table = {o: {c["taxon"]: c["n"] for c in cells} for o, cells in zip(rows["observer"].to_pylist(), rows["cells"].to_pylist(), strict=True)}
        placed = dealt(table, fractions)
        return pa.table({"observer": pa.array(list(placed), rows.schema.field("observer").type), "split": pa.array(list(placed.values()), pa.string())})

    keyed = own.select("observer", "cells", stable_hex(F.lit(seed), F.col("observer")).alias("order_key"), F.pmod(block, F.lit(blocks)).alias("block"))
    return keyed.groupBy("block").applyInArrow(deal, f"observer {kind}, split string")


def dealt(table: dict[int, dict[int, int]], fractions: dict[str, float]) -> dict[int, str]:
    """The split of each observer; table: groups by observer and taxon, observers in the order in which equally large ones come."""
    order = sorted(table, key=lambda o: -sum(table[o].values()))
    total: dict[int, int] = {}
    for row in table.values():
        for t, n in row.items():
            total[t] = total.get(t, 0) + n
    have = {s: dict.fromkeys(total, 0) for s in fractions}
    miss = lambda s, t, x: abs(x / total[t] - fractions[s]) + (1.0 if x <= 0 else 0.0)
    change = lambda o, s, sign: sum(miss(s, t, have[s][t] + sign * n) - miss(s, t, have[s][t]) for t, n in table[o].items())

    def put(o: int, s: str, sign: int) -> None:
        for t, n in table[o].items():
            have[s][t] += sign * n

    placed: dict[int, str] = {}
    for o in order:
        s = min(fractions, key=lambda s: (change(o, s, 1), -fractions[s], s))
        placed[o] = s
        put(o, s, 1)
    for _ in range(10):
        moved = False
        for o in order:
            a = placed[o]
            out = change(o, a, -1)
            put(o, a, -1)
            b = min(fractions, key=lambda s: (change(o, s, 1), s))
            if change(o, b, 1) < -out - 1e-9:
                moved = moved or b != a
            else:
                b = a
            placed[o] = b
            put(o, b, 1)
        if not moved:
            break
    return placed

"""Queries on orders of every size against brute force: of one line, of more than five, and of more than are compiled."""

import itertools
import math
import random
from datetime import datetime

import pytest

from lattica.plans import lattice


def rounded(x):
    return math.floor((math.floor(x * 1e9 * 2) + 1) / 2) / 1e9


def tables(spark, folder, sizes):
    """Writes orders of so many lines; returns g: (label, the lines' vectors)."""
    draw, lines, orders, groups = random.Random(7), [], [], {}
    for g, n in enumerate(sizes):
        orders.append((g, g % 3, f"{g % 5 + 1}-X", "F", 1.0))
        groups[g] = g % 5, []
        for i in range(1, n + 1):
            part, quantity, discount, tax = draw.randrange(50), float(draw.randint(1, 50)), draw.randint(0, 10) / 100, draw.randint(0, 8) / 100
            lines.append((g, i, part, 1, quantity, 10.0, discount, tax, datetime(2020, 1, 1)))
            v = [quantity, 400.0 * discount, 500.0 * tax, 5.0 * i, float(part)]
            groups[g][1].append([rounded(x / sum(v)) for x in v])
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return groups


def right(label, vectors):
    total = [0.0] * 5
    for v in vectors:
        total = [a + b for a, b in zip(total, v)]
    mean = [rounded(x / len(vectors)) for x in total]
    return int(mean.index(max(mean)) == label)


def outcomes(label, vectors, sizes):
    return {m: right(label, [vectors[i] for i in m]) for k in sizes for m in itertools.combinations(range(len(vectors)), k)}


@pytest.fixture(scope="module")
def every(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("every"))
    groups = tables(spark, folder, [1, 2, 5, 6, 7, 8, 9, 11, 13])
    return folder, {g: (len(v), outcomes(y, v, range(1, len(v) + 1))) for g, (y, v) in groups.items()}


def test_harm_and_help(spark, every):
    folder, groups = every
    want = {}
    for n, found in groups.values():
        for k in range(1, n):
            steps = [(c, found[tuple(sorted((*m, i)))]) for m, c in found.items() if len(m) == k for i in set(range(n)) - set(m)]
            want[k] = [a + b for a, b in zip(want.get(k, [0, 0, 0]), (1, (1, 0) in steps, (0, 1) in steps))]
    assert {r.k: [r.groups, r.any_harmful, r.any_helpful] for r in lattice.harm_and_help(spark, folder).collect()} == want


def test_majority_correctness(spark, every):
    folder, groups = every
    want = {}
    for n, found in groups.values():
        for k in range(1, n + 1):
            xs = [c for m, c in found.items() if len(m) == k]
            want[k] = [a + b for a, b in zip(want.get(k, [0, 0]), (1, 2 * sum(xs) >= len(xs)))]
    assert {r.k: [r.groups, r.majority_correct] for r in lattice.majority_correctness(spark, folder).collect()} == want


def test_paired_budget_delta(spark, tmp_path):
    groups = tables(spark, str(tmp_path), [1, 2, 5, 6, 7, 70, 13, 8, 9])  # 70 have no masks
    want = {}
    for y, v in groups.values():
        if len(v) > 1:
            found = outcomes(y, v, (1, 2))
            mean = [sum(xs) / len(xs) for k in (1, 2) for xs in [[c for m, c in found.items() if len(m) == k]]]
            want.setdefault(y, []).append(mean[1] - mean[0])
    got = {r.label: r for r in lattice.paired_budget_delta(spark, str(tmp_path)).collect()}
    assert {y: r.groups for y, r in got.items()} == {y: len(ds) for y, ds in want.items()}
    for y, ds in want.items():
        assert got[y].delta == pytest.approx(sum(ds) / len(ds), abs=1e-8)
        assert (got[y].gains, got[y].losses) == (sum(d > 1e-12 for d in ds), sum(d < -1e-12 for d in ds))

"""Scores of a probability vector `p` (array of doubles) against a class index `y` (from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.scalars import total

EPS = 1e-12


def at(p: Column, y: Column) -> Column:
    return F.get(p, y.cast("int"))


def argmax(p: Column) -> Column:
    """First index of the largest member, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def correct(p: Column, y: Column) -> Column:
    return F.when(argmax(p) == y, F.lit(1.0)).otherwise(F.lit(0.0))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def nll(p: Column, y: Column) -> Column:
    return -F.log(F.greatest(F.lit(EPS), F.least(F.lit(1.0), at(p, y))))


def brier(p: Column, y: Column) -> Column:
    """Sum of squared differences from the one-hot vector."""
    return total(F.transform(p, lambda x: x * x)) - F.lit(2.0) * at(p, y) + F.lit(1.0)


def rank_of(p: Column, y: Column) -> Column:
    """1 + classes with a larger probability + equal ones of a smaller index: ties go by index."""
    ahead = F.filter(F.transform(p, lambda x, i: (x > at(p, y)) | ((x == at(p, y)) & (i < y))), lambda b: b)
    return F.size(ahead) + 1


def in_top(p: Column, y: Column, k: int) -> Column:
    return F.when(rank_of(p, y) <= F.least(F.lit(k), F.size(p)), F.lit(1.0)).otherwise(F.lit(0.0))


def top_classes(p: Column, k: int) -> Column:
    """The k likeliest class indices as 'a;b;c'; ties go by index."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.array_join(F.transform(F.slice(order, 1, k), lambda s: s["i"].cast("string")), ";")


def floor_bin(conf: Column, bins: int) -> Column:
    """min(int(conf * bins), bins - 1)."""
    return F.least(F.floor(conf * F.lit(float(bins))).cast("int"), F.lit(bins - 1))


def edge_bin(conf: Column, bins: int) -> Column:
    """Bin by equal-width edges i / bins: left-closed, the last one closed."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: e <= conf)) - 1


def faults(p: Column, prediction: Column, classes: int, tolerance: float = 1e-5) -> Column:
    """What is wrong with a stored vector and its prediction, as a sorted list of names."""
    bad = {
        "argmax": argmax(p) != prediction,
        "length": F.size(p) != classes,
        "not_finite": F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))),
        "outside": F.exists(p, lambda x: (x < 0) | (x > 1)),
        "sum": F.abs(total(p) - 1.0) > tolerance,
        "unreadable": p.isNull(),
    }
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(bad.items())])
    return F.filter(names, lambda x: x.isNotNull())

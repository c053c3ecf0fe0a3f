"""Fail-closed integrity gates: each returns violations as rows (gate, key, detail); no rows, no violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import clean_text


def violations(rows: DataFrame, gate: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def failing(rows: DataFrame, gate: str, key: str, bad: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which bad is true or null."""
    return violations(rows.filter(F.coalesce(bad, F.lit(True))), gate, F.col(key), detail if detail is not None else F.lit(gate))


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; null is a key as any other."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")
    return violations(many, "unique_" + "_".join(keys), F.concat_ws("|", *[clean_text(F.col(k).cast("string")) for k in keys]), F.col("times"))


def not_blank(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null or blank values, a row each."""
    found = F.filter(F.array(*[F.when(F.trim(clean_text(F.col(c).cast("string"))) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return violations(rows.select(key, F.explode(found).alias("c")), "not_blank", F.col(key), F.col("c"))


def constant_in_group(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Groups in which a column takes several values."""
    g = rows.groupBy(group).agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)])
    found = F.filter(F.array(*[F.when(F.col(f"n{i}") > 1, F.lit(c)) for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    return violations(g.select(group, F.explode(found).alias("c")), "constant_in_group", F.col(group), F.col("c"))


def size_between(rows: DataFrame, group: str, low: int, high: int) -> DataFrame:
    g = rows.groupBy(group).agg(F.count("*").alias("n")).filter(~F.col("n").between(low, high))
    return violations(g, "size_between", F.col(group), F.col("n"))


def disjoint(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Values of key that history holds as well."""
    return violations(rows.select(key).distinct().join(history.select(key), key, "left_semi"), f"disjoint_{key}", F.col(key), F.lit("in history"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_set(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Symmetric difference of a key."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return violations(a.join(b, key, "left_anti"), "same_set", F.col(key), F.lit("left only")).unionAll(violations(b.join(a, key, "left_anti"), "same_set", F.col(key), F.lit("right only")))


def matches(rows: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return failing(rows, f"matches_{column}", key, ~F.col(column).rlike(pattern), F.col(column))


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """Keys for which two stored metrics differ or one is missing."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), list(keys), "full")
    bad = both.filter(~F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))
    return violations(bad, f"within_{value}", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.concat_ws(" and ", clean_text(F.col("a").cast("string")), clean_text(F.col("b").cast("string"))))


def report(gates: Sequence[DataFrame]) -> DataFrame:
    """All violations together."""
    out = gates[0]
    for g in gates[1:]:
        out = out.unionAll(g)
    return out


def decision(gates: dict[str, DataFrame]) -> DataFrame:
    """One row: a flag a gate and the verdict, the first failing gate's name or PASS."""
    named = report([g.select(F.lit(n).alias("gate"), F.lit(1).alias("bad")) for n, g in gates.items()])
    counts = named.agg(*[F.coalesce(F.sum(F.when(F.col("gate") == n, 1)), F.lit(0)).alias(n) for n in gates])
    verdict = F.coalesce(*[F.when(F.col(n) > 0, F.lit(f"STOP_{n.upper()}")) for n in gates], F.lit("PASS"))
    return counts.select(*[(F.col(n) == 0).alias(n) for n in gates], verdict.alias("verdict"))


def require(gate: DataFrame) -> None:
    """Raises with the first violations if there are any."""
    found = gate.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.gate} {r.key}: {r.detail}" for r in found))


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, in the order given; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons])

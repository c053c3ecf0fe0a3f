"""Joins with their contracts: uniqueness, coverage and agreement are checked, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import gates


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], agree: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(left with right's columns, violations): right's keys must be unique, every left row must match, and shared columns must agree and come from the left."""
    on = list(on)
    renamed = right.select(*on, *[F.col(c).alias(f"other_{c}") for c in agree], *[c for c in right.columns if c not in on and c not in agree], F.lit(True).alias("matched"))
    both = left.join(renamed, on, "left")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    bad = [gates.unique(right, on), gates.violations(both.filter("matched IS NULL"), "unmatched", key, F.lit("no row"))]
    for c in agree:
        bad.append(gates.violations(both.filter(F.col("matched") & ~F.col(c).eqNullSafe(F.col(f"other_{c}"))), f"disagree_{c}", key, F.col(f"other_{c}")))
    return both.drop("matched", *[f"other_{c}" for c in agree]), gates.report(bad)


def with_fallback(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """Left join on the first key pair; if it leaves any row unmatched, all rows use the second pair."""
    a = right.groupBy(F.col(first[1]).alias("ka")).agg(F.first(value).alias("va"))
    b = right.groupBy(F.col(second[1]).alias("kb")).agg(F.first(value).alias("vb"))
    both = left.join(a, F.col(first[0]) == F.col("ka"), "left").join(b, F.col(second[0]) == F.col("kb"), "left")
    missed = both.agg(F.max(F.col("ka").isNull()).alias("missed"))
    return both.crossJoin(F.broadcast(missed)).withColumn(value, F.when(F.coalesce("missed", F.lit(False)), F.col("vb")).otherwise(F.col("va"))).drop("ka", "kb", "va", "vb", "missed")


def without_history(rows: DataFrame, history: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key no history table holds."""
    known = history[0].select(key)
    for h in history[1:]:
        known = known.unionAll(h.select(key))
    return rows.join(known.distinct(), key, "left_anti")


def seed_table(frames: Sequence[DataFrame], keys: Sequence[str], seeds: int) -> tuple[DataFrame, DataFrame]:
    """(union with `seed`, keys that do not occur once in each of the seeds)."""
    if len(frames) != seeds:
        raise ValueError(f"{len(frames)} frames for {seeds} seeds")
    out = frames[0].withColumn("seed", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("seed", F.lit(i)))
    bad = out.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("seed").alias("seen")).filter(f"rows <> {seeds} OR seen <> {seeds}")
    return out, bad


def expand(features: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """One feature row to each relation that names it."""
    return relations.join(features, key)


def relation_rows(measured: DataFrame, relations: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Measurements of unique items under every relation's own ids."""
    return relations.join(measured.select(key, *columns), key, "left")


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Two raters: n, agreement and unweighted kappa, null where chance agreement is 1; nulls are left out."""
    r = rows.select(a.cast("string").alias("a"), b.cast("string").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    cells = r.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side_a, side_b = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = side_a.join(side_b, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.crossJoin(F.broadcast(chance)).select(F.col("t").alias("n"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (F.lit(1.0) - pe)).alias("kappa"))


def weighted_kappa(rows: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """Quadratic kappa of whole ratings from low to high."""
    span = float((high - low) ** 2)
    r = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    s = r.agg(F.count("*").alias("n"), F.avg((F.col("a") - F.col("b")) ** 2 / span).alias("seen"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(F.col("a") ** 2).alias("aa"), F.avg(F.col("b") ** 2).alias("bb"))
    expected = (F.col("aa") + F.col("bb") - 2 * F.col("ma") * F.col("mb")) / span
    return s.select("n", F.when(expected > 0, 1.0 - F.col("seen") / expected).alias("kappa"))

"""Manual review of candidate pairs: binding, rules and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which verdicts a pair may get, by whether it is exact, within one group, and against history (fixed values).
RULES = [
    ("exact_duplicate", True, False, False), ("exact_duplicate", True, False, True), ("same_group", True, True, False), ("same_group", False, True, False),
    ("near_duplicate", False, False, False), ("near_duplicate", False, False, True), ("distinct", False, False, False), ("distinct", False, False, True), ("quarantine", False, False, True),
]


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))


def bound(pairs: DataFrame, decisions: DataFrame, digests: DataFrame) -> DataFrame:
    """Each pair with its decision and both files' digests, and `fault`: missing, stale, changed bytes, exactness that the bytes deny, or a verdict that no rule allows. pairs: pair_id, a, b, sha_a, sha_b, exact, same_group, history; decisions: pair_id, decision; digests: id, sha256."""
    rules = pairs.sparkSession.createDataFrame(RULES, "decision string, exact boolean, same_group boolean, history boolean").withColumn("allowed", F.lit(True))
    both = pairs.withColumn("there", F.lit(True)).join(decisions, "pair_id", "full")
    for x in ("a", "b"):
        both = both.join(digests.select(F.col("id").alias(x), F.col("sha256").alias(f"now_{x}")), x, "left")
    both = both.join(F.broadcast(rules), ["decision", "exact", "same_group", "history"], "left")
    changed = ~(F.col("sha_a").eqNullSafe(F.col("now_a")) & F.col("sha_b").eqNullSafe(F.col("now_b")))
    fault = F.when(F.col("there").isNull(), "stale").when(F.col("decision").isNull(), "missing").when(changed, "changed").when(F.col("exact") != (F.col("sha_a") == F.col("sha_b")), "exactness").when(F.col("allowed").isNull(), "not_allowed")
    return both.withColumn("fault", fault).drop("there", "allowed")


def status(reviewed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: missing and stale pairs, quarantined ones, and whether the review passes."""
    a = canonical(reviewed).select("low", "high", F.coalesce("decision", F.lit("")).alias("decision"))
    b = canonical(current).select("low", "high", F.lit(True).alias("now"))
    both = a.join(b, ["low", "high"], "full")
    one = both.agg(F.count_if(F.col("decision").isNull()).alias("missing"), F.count_if(F.col("now").isNull()).alias("stale"), F.count_if(F.col("decision") == "quarantine").alias("quarantined"))
    return one.withColumn("passes", (F.col("missing") + F.col("stale") + F.col("quarantined")) == 0)


def shared_differences(predictions: DataFrame, key: str, vector: str, expected: int = 2) -> DataFrame:
    """Predictions for the same image key: rows, and the largest absolute difference of two; other counts are flagged."""
    g = predictions.groupBy("budget", key).agg(F.collect_list(vector).alias("v")).filter(F.size("v") > 1)
    d = F.array_max(F.zip_with(F.get("v", F.lit(0)), F.get("v", F.lit(1)), lambda x, y: F.abs(x - y)))
    return g.select("budget", key, F.size("v").alias("rows"), F.when(F.size("v") == expected, d).alias("difference"))

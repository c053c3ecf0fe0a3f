"""Two-level means: group, then label, then the mean over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected(scored: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """The mean over a group's subsets of each size: group columns, k, metrics."""
    return scored.groupBy(*group, "k").agg(*[F.avg(m).alias(m) for m in metrics])


def macro(groups: DataFrame, by: list[str], metrics: list[str], label: str = "label") -> DataFrame:
    """Mean over labels of the label means; labels without a value of a metric do not count for it."""
    labels = groups.groupBy(*by, label).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("size"))
    return labels.groupBy(*by).agg(*[F.avg(m).alias(f"macro_{m}") for m in metrics], F.sum("size").alias("groups"), F.count("*").alias("labels"))


def micro(groups: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return groups.groupBy(*by).agg(*[F.avg(m).alias(f"micro_{m}") for m in metrics])


def standardised_gap(a: DataFrame, b: DataFrame, cells: list[str], metric: str) -> DataFrame:
    """Weighted mean over common cells of a's cell mean less b's, weights from b's counts; one row."""
    left = a.groupBy(*cells).agg(F.avg(metric).alias("x"))
    right = b.groupBy(*cells).agg(F.avg(metric).alias("y"), F.count("*").alias("w"))
    both = left.join(right, cells)
    return both.agg((F.sum((F.col("x") - F.col("y")) * F.col("w")) / F.sum("w")).alias("gap"), F.sum("w").alias("weight"), F.count("*").alias("cells"))


def grouped_ece(scored: DataFrame, group: list[str], by: list[str], bins: int = 15) -> DataFrame:
    """Calibration error over subset predictions in which every group weighs the same; needs correct, confidence, k, bin."""
    from pyspark.sql import Window

    w = F.lit(1.0) / F.count("*").over(Window.partitionBy(*group, "k"))
    rows = scored.withColumn("w", w)
    per_bin = rows.groupBy(*by, "bin").agg(F.sum(F.col("w") * (F.col("correct") - F.col("confidence"))).alias("gap"), F.sum("w").alias("weight"))
    return per_bin.groupBy(*by).agg((F.sum(F.abs("gap")) / F.sum("weight")).alias("ece"))

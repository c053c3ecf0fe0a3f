"""Places of rows in an order, by range partitions instead of one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder where neither the session nor the cluster names one."""
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "row_id") -> DataFrame:
    """Global row numbers from 0: each range partition is numbered within and moved by the sizes of those before it (one number a partition). The sorted rows are checkpointed, so that both uses see the same ranges."""
    checkpoints(rows.sparkSession)
    w = Window.partitionBy("part").orderBy(*order)
    placed = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("within", F.row_number().over(w) - 1).checkpoint()
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    return placed.join(F.broadcast(before), "part").withColumn(name, F.col("within") + F.col("before")).drop("part", "within", "before")


def places(rows: DataFrame, stratum: Sequence[str], order: Sequence[str], place: str = "i", size: str = "m") -> DataFrame:
    """Place (from 0) of each row in its stratum and the stratum's size; a stratum, however large, is many range partitions."""
    all_in = numbered(rows, [*stratum, *order], "_row")
    strata = all_in.groupBy(*stratum).agg(F.min("_row").alias("_first"), F.count("*").alias(size))
    return all_in.join(strata, list(stratum)).withColumn(place, (F.col("_row") - F.col("_first"))).drop("_row", "_first")

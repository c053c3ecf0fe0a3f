"""Folders for what a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where that is unset; it goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def one_file_a_row(rows: DataFrame, number: str, text: str, path: str, count: int) -> None:
    """Writes each row's text as a file of its own; number runs from 0 to count - 1, and count is small."""
    rows.select(number, text).repartitionById(count, number).select(text).write.text(path)

"""Scans with fixed schemas and their importers; nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.functions.scalars import whole_number
from lattica.operators import gates

#: The 20 columns of a member manifest, in order (fixed values).
MANIFEST = "row_id long, cohort string, observation_id long, observer_id long, taxon_id long, class_index int, scientific_name string, common_name string, observed_on string, created_at string, place_ids string, photo_id long, license_code string, attribution string, url string, local_path string, sha256 string, width int, height int, legacy_split string"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a stated schema; a malformed row raises."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, with empty fields as empty text, not null."""
    names = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")


def manifest(spark: SparkSession, path: str, whole: list[str]) -> DataFrame:
    """Text columns, of which `whole` must be exact whole numbers ('12' or '12.0'); any other value raises when read."""
    rows = csv_text(spark, path)
    for c in whole:
        n = whole_number(F.col(c))
        rows = rows.withColumn(c, F.when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no whole number: "), F.col(c))).cast("long")))
    return rows


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file under a stated schema; another root or a malformed file raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def nested_members(objects: DataFrame, groups: str, members: str, group_fields: list[str], member_fields: list[str]) -> DataFrame:
    """groups[].members[] as a row a member with its group's fields."""
    g = objects.select(F.explode(groups).alias("g")).select("g", F.explode(f"g.{members}").alias("m"))
    return g.select(*[F.col(f"g.{f}").alias(f) for f in group_fields], *[F.col(f"m.{f}").alias(f) for f in member_fields])


def annotated_images(objects: DataFrame) -> DataFrame:
    """One row an annotation of a three-table JSON (categories, images, annotations), with image file and category name."""
    categories = objects.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    images = objects.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    notes = objects.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id")
    return notes.join(images, "image_id").join(F.broadcast(categories), "category_id")


def binary(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def feature_matrix(spark: SparkSession, matrix: str, index: DataFrame, key: str) -> DataFrame:
    """key, feature: rows of .npy matrices named by index (key, feature_row, and `matrix`, the file's name, where the path holds several). A matrix is read by one task a file; export large ones as Parquet."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2 or 0 in x.shape:
                    raise ValueError(f"{path} is no matrix with rows and columns")
                for a in range(0, len(x), 4096):
                    yield pd.DataFrame({"matrix": path.rsplit("/", 1)[-1], "feature_row": np.arange(a, min(len(x), a + 4096)), "feature": [v.tolist() for v in x[a : a + 4096]]})

    files = spark.read.format("binaryFile").load(matrix)
    matrix_rows = files.select("path", "content").mapInPandas(rows, "matrix string, feature_row long, feature array<float>")
    named = ["matrix", "feature_row"] if "matrix" in index.columns else ["feature_row"]
    if len(named) == 1 and files.select("path").limit(2).count() > 1:
        raise ValueError("several matrices under one path need an index with their names")
    at = index.withColumn("feature_row", F.col("feature_row").cast("long"))
    return at.select(key, *named).join(matrix_rows, named).select(key, "feature")


def index_faults(index: DataFrame, rows: int, key: str) -> DataFrame:
    """What is wrong with an index of a matrix of so many rows: keys or rows named twice, rows outside, another length."""
    outside = gates.failing(index, "feature_row_outside", key, ~F.col("feature_row").between(0, rows - 1))
    n = gates.violations(index.agg(F.count("*").alias("n")).filter(F.col("n") != rows), "index_length", F.col("n"), F.lit(str(rows)))
    return gates.report([gates.unique(index, [key]), gates.unique(index, ["feature_row"]), outside, n])


def named_arrays(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """key, vector: two arrays of .npz files side by side; one task a file."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for f in frames:
            for content in f["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, x = z[key], z[vector]
                if len(ids) != len(x):
                    raise ValueError(f"{key} and {vector} differ in length")
                for a in range(0, len(x), 4096):
                    yield pd.DataFrame({key: ids[a : a + 4096].astype(np.int64), vector: [np.ravel(v).astype(float).tolist() for v in x[a : a + 4096]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"`{key}` long, `{vector}` array<double>")


def config(path: str) -> dict:
    """A JSON or YAML mapping with its path and digest; another root raises. The driver's, not a table."""
    import hashlib

    data = open(path, "rb").read()
    if path.endswith((".yaml", ".yml")):
        import yaml  # not everywhere

        out = yaml.safe_load(data)
    else:
        out = json.loads(data)
    if not isinstance(out, dict):
        raise ValueError(f"{path} is no mapping")
    return out | {"_config_path": path, "_config_hash": hashlib.sha256(data).hexdigest()}


def require_frozen(settings: dict, digests: dict[str, str]) -> None:
    """Raises unless the status is frozen and every pinned file has the digest recorded for it."""
    if str(settings.get("status", "")).strip().lower() != "frozen":
        raise ValueError("the protocol is not frozen")
    for path, want in settings.get("freeze", {}).items():
        if digests.get(path) != want:
            raise ValueError(f"{path} differs from the frozen one")

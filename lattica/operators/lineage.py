"""Hash-bound lineage: digests of artifacts, completion markers that resist drift, and the walk over a marker's ancestry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = "stage string, contract string, artifact string, sha256 string"


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, sha256, bytes of files; contents are read by executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def canonical_hash(rows: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row as JSON with its columns in sorted order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def frame_digest(rows: DataFrame) -> DataFrame:
    """rows, digest of a frame whatever its order: hashes of rows are summed, so a row more or less shows."""
    h = F.conv(F.substring(canonical_hash(rows, rows.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def drift(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Artifacts that are gone, new or changed. Frames: key, sha256."""
    both = expected.select(key, F.col("sha256").alias("want")).join(actual.select(key, F.col("sha256").alias("have")), key, "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def finish(markers: DataFrame | None, stage: str, contract: str, artifacts: DataFrame) -> DataFrame:
    """markers with the stage's artifacts (path, sha256) added; a stage that is there already raises."""
    new = artifacts.select(F.lit(stage).alias("stage"), F.lit(contract).alias("contract"), F.col("path").alias("artifact"), "sha256")
    if markers is None:
        return new
    if markers.filter(F.col("stage") == stage).limit(1).count():
        raise ValueError(f"{stage} has a marker")
    return markers.unionAll(new)


def resumable(markers: DataFrame, stage: str, contract: str, actual: DataFrame) -> bool:
    """Whether the stage is done: false without a marker; another contract or a drifted artifact raises."""
    own = markers.filter(F.col("stage") == stage)
    if not own.limit(1).count():
        return False
    if own.filter(F.col("contract") != contract).limit(1).count():
        raise ValueError(f"{stage} was made under another contract")
    bad = drift(own.select(F.col("artifact").alias("path"), "sha256"), actual.join(own.select(F.col("artifact").alias("path")), "path", "left_semi")).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].path} is {bad[0].state}")
    return True


def verify_tree(markers: DataFrame, digests: DataFrame, root: str, most_depth: int = 64) -> DataFrame:
    """artifact, state of all that a root marker rests on: an artifact that is a stage's own marker is followed. One join a level; a level is small against the table, and each is checkpointed."""
    known = digests.select(F.col("path").alias("artifact"), F.col("sha256").alias("have"))
    level = markers.filter(F.col("stage") == root).select("artifact", "sha256").distinct()
    seen = level
    for _ in range(most_depth):
        deeper = markers.join(level.select(F.col("artifact").alias("stage")), "stage").select("artifact", "sha256").distinct()
        level = deeper.join(seen, ["artifact", "sha256"], "left_anti").checkpoint()
        if not level.limit(1).count():
            break
        seen = seen.unionAll(level).checkpoint()
    state = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("sha256"), "changed").otherwise("ok")
    return seen.join(known, "artifact", "left").select("artifact", state.alias("state"))

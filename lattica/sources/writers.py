"""Sinks that do not overwrite: Spark's committer makes a job's output appear as a whole."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def parquet(rows: DataFrame, path: str, replace: bool = False, partition: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite" if replace else "errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def csv(rows: DataFrame, path: str, replace: bool = False) -> None:
    rows.write.mode("overwrite" if replace else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def json(rows: DataFrame, path: str, replace: bool = False) -> None:
    """JSON lines with columns in sorted order and nulls kept."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite" if replace else "errorifexists").option("ignoreNullFields", False).json(path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose joins and groupings by key need no exchange."""
    rows.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def matrices(rows: DataFrame, path: str, key: str, vector: str, most_rows: int = 65_536) -> DataFrame:
    """Writes vectors as .npy matrices of at most most_rows rows, by the executors that hold them, and returns their index: key, matrix (file name), feature_row. A repeated attempt leaves a file that the index does not name; persist the index, as running it writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(path)
        keys, held = [], []

        def flush() -> pa.RecordBatch:
            name, body = f"{uuid.uuid4().hex}.npy", io.BytesIO()
            np.save(body, np.asarray(held, np.float32))
            with disk.open_output_stream(f"{root}/{name}") as out:
                out.write(body.getvalue())
            return pa.RecordBatch.from_pydict({key: keys, "matrix": [name] * len(keys), "feature_row": list(range(len(keys)))}, schema=schema)

        schema = None
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(0).type), ("matrix", pa.string()), ("feature_row", pa.int64())])
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                held.append(v)
                if len(held) == most_rows:
                    yield flush()
                    keys, held = [], []
        if held:
            yield flush()

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, matrix string, feature_row long")

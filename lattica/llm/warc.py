"""WARC archives: a deterministic sharded writer and a reader.

write_archive(): records are dealt to shards by ranges of their id and, for rows that share
an id or have none, of their payload's digest. The ranges come from rows chosen by hash
(some a shard, at most a million in all), so the same rows always give the same shards and
a shard is a partition. A task sorts its shards by id, regenerates
headers and digests, compresses each record as a gzip member without a time stamp and
starts a new file whenever one reaches roll_bytes compressed. Files get temporary names
with the attempt's own random part; the driver renames those that successful tasks
reported, then writes the manifest, itself through a temporary name. What lost
executors or repeated attempts leave is removed with the temporary folder.

Of records with equal payloads of at least least_shared bytes the one with the smallest
id is a response and the others are revisits without a payload. Ties on the smallest id
are all responses. A null payload is empty; a record with a null id is never the first
of its payload unless no other is; extra columns are ignored; no rows give an empty
manifest and an empty result.

The folder is written with pyarrow's file systems (local and shared mounts, HDFS, S3,
GCS by its URI) on executors, and renamed with Hadoop's on the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, small_batches, table

LEAST_SHARED = 100
ROLL_BYTES = 8 << 20
SHARD_ROWS = 4000
#: Sampled rows a shard, and the most shards: at most a million ids reach the driver.
SHARD_SAMPLE = 20
MOST_SHARDS = 50_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, temp string, file string, records long, bytes long, first_id string, last_id string, sha256 string"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def one_line(x: str | None) -> str:
    return " ".join((x or "").split())


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record: response with its payload behind an HTTP head, or revisit with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one gzip member after the other."""
    data, reader, parts = b"", zlib.decompressobj(31), []
    while data or (data := stream.read(chunk)):
        parts.append(reader.decompress(data))
        data = reader.unused_data
        if reader.eof:
            yield b"".join(parts)
            reader, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload; both digests must hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError("payload digest differs")
    return fields, payload


def revisits(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """page_id, digest, refers_to of the records that repeat a payload; no payload is exchanged."""
    base = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    ids = base.filter(F.length("payload") >= least_shared).select("page_id", F.sha2("payload", 256).alias("digest"))
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    again = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    return ids.join(shared, "digest").filter(again).select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()


def ranges(pages: DataFrame, shard_rows: int = SHARD_ROWS) -> list[tuple]:
    """Sorted lower ends (id is null, id, digest) of the shards after the first, from rows that a hash chooses: some a shard, so that shards stay alike at any size."""
    n = pages.count()
    shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
    if shards == 1:
        return []
    every = max(1, n // (shards * SHARD_SAMPLE))
    drawn = pages.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(every)) == 0)
    found = drawn.select("page_id", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest")).collect()
    chosen = sorted((r.page_id is None, 0 if r.page_id is None else r.page_id, r.digest) for r in found)
    return sorted({chosen[len(chosen) * k // shards] for k in range(1, shards)}) if chosen else []


def place(splits: list[tuple], ids: pd.Series, digests: pd.Series) -> np.ndarray:
    """How many lower ends are not above each (id, digest); only ids that are an end themselves need their digest."""
    first_null = bisect_left(splits, (True,))
    ends = np.array([x[1] for x in splits[:first_null]])
    out, there = np.full(len(ids), first_null, np.int32), ids.notna().to_numpy()
    if there.any() and len(ends):
        values = ids[there].to_numpy()
        low, high = np.searchsorted(ends, values, side="left"), np.searchsorted(ends, values, side="right")
        out[there] = high
        exact = np.flatnonzero(there)[low < high]
    else:
        out[there] = 0
        exact = np.zeros(0, int)
    for i in [*exact.tolist(), *np.flatnonzero(~there).tolist()]:
        out[i] = bisect_right(splits, (False, ids.iloc[i], digests.iloc[i]) if there[i] else (True, 0, digests.iloc[i]))
    return out


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the archive and returns its manifest: a row a file."""
    spark = pages.sparkSession
    small_batches(spark)
    splits = ranges(pages, shard_rows)
    held = spark.sparkContext.broadcast(splits)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(place(held.value, ids, digests))

    shard = shard_of("page_id", "digest") if splits else F.lit(0)
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    records = base.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    # what a record refers to stands before it in the sort, so payloads are exchanged once
    marks = revisits(pages).select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    dealt = records.unionAll(marks).withColumn("shard", shard)
    order = ["shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url"]
    placed = dealt.repartitionById(len(splits) + 1, "shard").sortWithinPartitions(*order)
    temp = f"{folder.rstrip('/')}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, current, shard, seq, mark = uuid.uuid4().hex, None, {}, None, 0, None
        disk, root = filesystem(temp)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                row = current | {"sha256": current["sha256"].hexdigest()}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.string()), ("last_id", pa.string()), ("sha256", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    mark = r
                    continue
                page, payload = None if r["page_id"] is None else str(r["page_id"]), r["payload"]
                again = mark is not None and mark["page_id"] == r["page_id"] and mark["digest"] == r["digest"]
                data = gzip_member(record(page, r["url"], payload, r["digest"], len(payload), str(mark["refers_to"]) if again else None))
                if out is not None and (r["shard"] != shard or current["bytes"] + len(data) > roll_bytes):
                    yield from close()
                    seq = seq + 1 if r["shard"] == shard else 0
                if out is None:
                    seq = seq if r["shard"] == shard else 0
                    shard = r["shard"]
                    disk.create_dir(root, recursive=True)
                    name = f"part-{shard:06d}-{seq:06d}.warc.gz"
                    current = {"shard": shard, "seq": seq, "temp": f"{name}.{attempt}", "file": name, "records": 0, "bytes": 0, "first_id": page, "last_id": None, "sha256": hashlib.sha256()}
                    out = disk.open_output_stream(f"{root}/{current['temp']}", compression=None)
                out.write(data)
                current["sha256"].update(data)
                current |= {"records": current["records"] + 1, "bytes": current["bytes"] + len(data), "last_id": page}
        yield from close()

    files = sorted(placed.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.file)
    commit(spark, folder, temp, files)
    return spark.createDataFrame(files, MANIFEST).drop("temp")


def commit(spark: SparkSession, folder: str, temp: str, files: list) -> None:
    """Renames what successful tasks reported, writes the manifest last, and removes the rest."""
    jvm = spark.sparkContext._jvm
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join(x))
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    for f in files:
        if not store.rename(path(temp, f.temp), path(folder, f.file)):
            raise OSError(f"{f.temp} can't be renamed")
    listed = json.dumps([{k: v for k, v in f.asDict().items() if k != "temp"} for f in files], indent=0).encode()
    out = store.create(path(folder, "_manifest.json.tmp"), True)
    out.write(listed)
    out.close()
    store.rename(path(folder, "_manifest.json.tmp"), path(folder, "manifest.json"))
    store.delete(path(temp), True)


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id (as text), url, payload (null on revisits), payload_bytes, payload_digest, record_type, refers_to (as text)."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        disk, root = filesystem(folder)
        for name in batch.column(0).to_pylist():
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            held = 0
            with disk.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in read_members(stream):
                    fields, payload = parse(data)
                    kind = fields["WARC-Type"]
                    values = (fields.get("X-Page-Id"), fields["WARC-Target-URI"], payload if kind == "response" else None, len(payload) if kind == "response" else int(fields["payload_bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, fields.get("X-Refers-To-Page"))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                    held += len(payload)
                    if held > 8 << 20:
                        yield typed(out)
                        out, held = {k: [] for k in out}, 0
            if out["url"]:
                yield typed(out)

    def typed(out: dict[str, list]) -> dict:
        return {k: pa.array(v, pa.binary() if k == "payload" else pa.int64() if k == "payload_bytes" else pa.string()) for k, v in out.items()}

    names = manifest.select("file").repartition(max(1, manifest.count()))
    return map_arrow(names, work, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_dir(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    back = read_archive(write_archive(pages, folder), folder)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= {LEAST_SHARED} GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

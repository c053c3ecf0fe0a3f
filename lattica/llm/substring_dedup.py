"""Repeated substrings by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix count, so a suffix is a window and equal groups
are exactly the repeated windows. Passes go from the most significant digit to the least,
and a suffix that stands alone leaves the sort:

1. The distributed digit of a window is the smallest hash among its 40-byte grams. It
   depends on the window's bytes alone, so equal windows share it, and neighbouring
   windows mostly share it too: a row stands for a whole run of windows. Runs whose digit
   no other run has leave here, which is most text.
2. Runs of one digit with equal bytes in two places are repeated as a whole; of each
   distinct content one run goes on, and only if its digit has another content.
3. Within a digit the remaining windows are sorted by five digits of 40 bytes, most
   significant first, in bounded batches. A digit whose contents have more than `most`
   bytes, which a very common passage brings about, is not gathered in one task: its
   windows become rows and are grouped by all digits at once, with partial counts.

Digits are 64-bit fingerprints. Documents are joined by the two 64-bit hashes of their
text, so copies are sorted once; a text that has a copy is repeated as a whole.

Null texts are empty; texts shorter than a window have nothing repeated. A row in, a row
out, repeated rows (copies of each other) included; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, discard, map_arrow, table, written

LENGTH = 200
GRAM = 40
#: Bytes of one digit's contents up to which a task gathers them.
MOST = 2 << 20
#: Bytes of text that are worked on at once.
SEGMENT = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(3)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit fingerprint of the size bytes from each position, by doubling."""
    powers, hashes = {1: BASE}, {1: BYTE_VALUES[data]}
    step = 1
    while step * 2 <= size:
        h = hashes[step]
        hashes[2 * step] = h[:-step] * powers[step] + h[step:]
        with np.errstate(over="ignore"):
            powers[2 * step] = powers[step] * powers[step]
        if not size & step:
            del hashes[step]  # only lengths that add up to size are needed
        step *= 2
    out, covered, n = hashes[step], step, len(data) - size + 1
    out = out[:n]
    while covered < size:
        step = max(s for s in hashes if s <= size - covered)
        out = out * powers[step] + hashes[step][covered : covered + n]
        covered += step
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width neighbours, by doubling."""
    n, step = len(h) - width + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:n], h[width - step : width - step + n])


def text_runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(text, start, windows, digit, content, whether the digit's gram recurs within) of each run."""
    gram = min(GRAM, length)
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return
    joined = b"".join(texts[i] for i in long)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(long)), sizes)
    h = gram_hashes(data, gram)
    low = least_of(h, length - gram + 1)
    n = len(low)
    valid = np.arange(n) + length <= ends[owner[:n]]
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (owner[1:n] != owner[: n - 1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], n)
    keep = valid[starts]
    starts, stops = starts[keep], stops[keep]
    begin = (ends - sizes)[owner[starts]]
    digest = xxhash.xxh3_64_intdigest
    reach = length - gram + 1
    for s, e, o, b, d in zip(starts.tolist(), stops.tolist(), owner[starts].tolist(), begin.tolist(), low[starts], strict=True):
        again = e - s > reach or np.count_nonzero(h[s : e + reach - 1] == d) > 1
        yield long[o], s - b, e - s, int(d), digest(joined[s : e + length - 1]), bool(again)


def text_keys(doc: str = "text") -> list[Column]:
    return [F.xxhash64(doc).alias("k1"), F.xxhash64(F.lit(1), doc).alias("k2")]


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, rid, start, n, digit, content, again: a row a run."""
    rows = docs.select("text", *text_keys(), "rid")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(0))
        # a long text goes in segments that share no window start, so that a block stays small
        parts = [(i, o) for i, t in enumerate(texts) for o in range(0, max(1, len(t) - length + 1), SEGMENT)]
        cut = [texts[i][o : o + SEGMENT + length - 1] for i, o in parts]
        for a, b in blocks([len(t) for t in cut], SEGMENT):
            found = list(text_runs(cut[a:b], length))
            if found:
                at, start, n, digit, content, again = zip(*found, strict=True)
                start = [s + parts[a + i][1] for i, s in zip(at, start, strict=True)]
                at = pa.array([parts[a + i][0] for i in at])
                signed = lambda x: np.array(x, np.uint64).view(np.int64)
                yield {"k1": batch.column(1).take(at), "k2": batch.column(2).take(at), "rid": batch.column(3).take(at), "start": np.array(start, np.int32), "n": np.array(n, np.int32), "digit": signed(digit), "content": signed(content), "again": list(again)}

    return map_arrow(rows, work, "k1 long, k2 long, rid long, start int, n int, digit long, content long, again boolean")


def radix(group: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes at `at` in data, the indices of those whose first length bytes another of their group has."""
    gram = min(GRAM, length)
    h = gram_hashes(data, gram)
    left, part = np.arange(len(at)), group
    for depth in range(0, length, gram):
        digit = h[at[left] + min(depth, length - gram)]
        order = np.lexsort((digit, part))
        left, digit, part = left[order], digit[order], part[order]
        new = np.ones(len(left), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (part[1:] != part[:-1])
        name = np.cumsum(new) - 1
        several = np.bincount(name, minlength=1)[name] > 1 if len(left) else np.zeros(0, bool)
        left, part = left[several], name[several]
        if not len(left):
            break
    return left


def intervals(rows: np.ndarray, rel: np.ndarray, length: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(row, span starts, span ends) of the bytes under windows at rel."""
    order = np.lexsort((rel, rows))
    rows, rel = rows[order], rel[order]
    if not len(rows):
        return
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (rel[1:] > rel[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    out: dict[int, tuple[list[int], list[int]]] = {}
    for r, a, b in zip(rows[first].tolist(), rel[first].tolist(), rel[last].tolist(), strict=True):
        spans = out.setdefault(r, ([], []))
        spans[0].append(a)
        spans[1].append(b + length)
    for r, (a, b) in out.items():
        yield r, a, b


def windows_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, row, place in the joined bytes) of every window of the contents."""
    sizes = np.array([len(t) for t in texts])
    count = np.maximum(sizes - length + 1, 0)
    offset = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offset[row]
    return np.frombuffer(b"".join(texts), np.uint8), row, at


def sorted_batches(parts: DataFrame, length: int) -> DataFrame:
    """digit, content, a, b: repeated spans of contents that share a digit; parts: digit, content, data."""
    dealt = parts.repartition("digit").sortWithinPartitions("digit", "content")

    def settle(digits: list[int], contents: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        data, row, at = windows_of(texts, length)
        if not len(at):
            return None
        _, group = np.unique(np.array(digits), return_inverse=True)
        hit = radix(group[row], data, at, length)
        offset = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
        found = list(intervals(row[hit], at[hit] - offset[row[hit]], length))
        if not found:
            return None
        return pa.RecordBatch.from_pydict({"digit": [digits[r] for r, _, _ in found], "content": [contents[r] for r, _, _ in found], "a": pa.array([a for _, a, _ in found], pa.list_(pa.int32())), "b": pa.array([b for _, _, b in found], pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, contents, texts, held = [], [], [], 0
        for batch in batches:
            for d, c, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held > SEGMENT and d != digits[-1]:
                    if (done := settle(digits, contents, texts)) is not None:
                        yield done
                    digits, contents, texts, held = [], [], [], 0
                if digits and digits[-1] == d and contents[-1] == c:
                    continue  # the same run from a repeated row
                digits.append(d)
                contents.append(c)
                texts.append(t)
                held += len(t)
        if texts and (done := settle(digits, contents, texts)) is not None:
            yield done

    return dealt.mapInArrow(run, "digit long, content long, a array<int>, b array<int>")


def counted_windows(parts: DataFrame, length: int) -> DataFrame:
    """The same for digits with many windows: a row a window, grouped by all digits at once."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        every = as_bytes(batch.column(2))
        for a, b in blocks([len(t) for t in every], SEGMENT):
            texts = every[a:b]
            data, row, at = windows_of(texts, length)
            if not len(at):
                continue
            gram = min(GRAM, length)
            h = gram_hashes(data, gram)
            w1 = np.zeros(len(at), np.uint64)
            w2 = np.zeros(len(at), np.uint64)
            for depth in range(0, length, gram):
                digit = h[at + min(depth, length - gram)]
                w1 = w1 * BASE + digit
                w2 = (w2 ^ digit) * np.uint64(0x94D049BB133111EB) + (digit >> np.uint64(31))
            offset = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
            rows = pa.array(row + a)
            yield {"w1": w1.view(np.int64), "w2": w2.view(np.int64), "digit": batch.column(0).take(rows), "content": batch.column(1).take(rows), "rel": (at - offset[row]).astype(np.int32)}

    each = map_arrow(parts.dropDuplicates(["digit", "content"]).select("digit", "content", "data"), work, "w1 long, w2 long, digit long, content long, rel int")
    # (a table of its own, so that a hot window's rows can be split in the join)
    several = written(each.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "windows")
    hits = each.join(several, ["w1", "w2"]).groupBy("digit", "content").agg(F.array_sort(F.collect_set("rel")).alias("rel"))
    first = F.expr(f"filter(rel, (x, i) -> i = 0 OR x > rel[i - 1] + {length})")
    last = F.expr(f"transform(filter(rel, (x, i) -> i = size(rel) - 1 OR rel[i + 1] > x + {length}), x -> cast(x + {length} AS int))")
    return hits.select("digit", "content", first.alias("a"), last.alias("b"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """k1, k2 (a text's key), copied (the text has a copy), spans: array of (a, b) byte ranges, unmerged. docs: text, rid."""
    runs = written(all_runs(docs, length).withColumn("place", F.xxhash64("k1", "k2", "start")), "runs")
    # what is alone leaves: digits are counted by partial sums, so a digit that many runs have is no task
    digits = runs.groupBy("digit").agg(F.count("*").alias("c"), F.max("again").alias("again")).filter("c > 1 OR again").select("digit")
    left = written(runs.join(written(digits, "digits"), "digit"), "left")
    contents = left.groupBy("digit", "content").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max("again").alias("again"))
    contents = written(contents.select("digit", "content", "first", (F.col("first") != F.col("last")).alias("whole"), "again"), "contents")
    several = contents.groupBy("digit").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("digit", F.lit(True).alias("several"))
    facts = contents.join(written(several, "several"), "digit", "left").withColumn("open", F.coalesce("several", F.lit(False)) | (F.col("again") & ~F.col("whole")))
    facts = written(facts.filter("whole OR open").select("digit", "content", "first", "whole", "open"), "facts")
    seen = left.join(facts, ["digit", "content"]).withColumn("shown", F.col("place") == F.col("first"))
    seen = written(seen.select("k1", "k2", "rid", "start", "n", "digit", "content", "whole", "shown", "open"), "seen")
    discard(runs, left)
    # contents that go on, with the bytes of their digit
    going = seen.filter("open AND shown").select("digit", "content", "k1", "k2", "rid", "start", "n")
    # (a table of its own, so that the join below deals both sides and a hot digit can be split)
    crowd = going.groupBy("digit").agg(F.sum(F.col("n") + length - 1).alias("bytes")).filter(F.col("bytes") > most)
    crowd = written(crowd.select("digit", F.lit(True).alias("many")), "crowd")
    wanted = going.groupBy("rid", "k1", "k2").agg(F.collect_set(F.struct("start", "n", "digit", "content")).alias("wanted"))
    texts = docs.select("rid", *text_keys(), F.col("text").cast("binary").alias("data")).join(wanted, ["rid", "k1", "k2"])
    cut = texts.select("data", F.explode("wanted").alias("w")).select("w.digit", "w.content", F.expr(f"substring(data, w.start + 1, w.n + {length - 1})").alias("data"))
    parts = written(cut.join(crowd, "digit", "left").select("digit", "content", "data", F.coalesce("many", F.lit(False)).alias("many")), "parts")
    partial = sorted_batches(parts.filter("NOT many").drop("many"), length).union(counted_windows(parts.filter("many").drop("many"), length))
    # back to all places of the runs
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    full = seen.filter("whole").select("k1", "k2", span(F.col("start"), F.col("start") + F.col("n") + length - 1).alias("span"))
    some = seen.filter("open AND NOT whole").join(partial, ["digit", "content"]).select("k1", "k2", "start", F.explode(F.arrays_zip("a", "b")).alias("s"))
    some = some.select("k1", "k2", span(F.col("start") + F.col("s.a"), F.col("start") + F.col("s.b")).alias("span"))
    found = full.union(some).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    copies = docs.filter(F.octet_length("text") >= length).select(*text_keys()).groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2", F.lit(True).alias("copied"))
    return found.join(copies, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """row (the input's columns but text), n_bytes, spans (merged byte ranges), rest (the remaining bytes) and text (rest without the characters that a range has cut)."""
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*others).alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("row.doc_id"))
    marks = repeated_spans(base.select("text", "rid"), length, most)
    joined = base.select("row", F.col("text").cast("binary").alias("data"), *text_keys()).join(marks, ["k1", "k2"], "left").select("row", "data", "copied", "spans")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        spans_of, rest, n_bytes = [], [], []
        for data, copied, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            found = [(0, len(data))] if copied else merged([(s["a"], s["b"]) for s in spans]) if spans else []
            kept, at = [], 0
            for a, b in found:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            spans_of.append([{"a": a, "b": b} for a, b in found])
            rest.append(b"".join(kept))
            n_bytes.append(len(data))
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield {"row": batch.column(0), "n_bytes": n_bytes, "spans": pa.array(spans_of, kind), "rest": pa.array(rest, pa.binary()), "text": [x.decode("utf-8", "ignore") for x in rest]}

    return map_arrow(joined, work, f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<a:int,b:int>>, rest binary, text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, hash(b[i:i + 199]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
m AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM m),
s AS (SELECT rid, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY rid, g),
e AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS before FROM s),
k AS (SELECT rid, before AS a, a AS z FROM e UNION ALL SELECT rid, max(z), NULL FROM s GROUP BY rid UNION ALL SELECT rid, 1, NULL FROM d WHERE rid NOT IN (SELECT rid FROM s)),
kept AS (SELECT rid, unhex(string_agg(hex(b[k.a:coalesce(k.z - 1, octet_length(b))]), '' ORDER BY k.a)) AS rest FROM k JOIN d USING (rid) WHERE k.a < coalesce(k.z, octet_length(b) + 1) GROUP BY rid),
t AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(rest, ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN kept USING (rid)
"""

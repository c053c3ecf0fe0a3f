"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its lower-cased words (ASCII other than letters and digits parts them; a text
of nothing else is cut at white space), in 5-word shingles (one shorter shingle if it has
fewer words); a shingle is labelled with its occurrence
number. An Order MinHash entry takes the three labelled shingles that a hash function
ranks lowest and hashes them in text order, so that it is sensitive to order as edit
similarity is. Sixteen entries are sixteen buckets; at similarity 0.8 two texts share
one with probability above 0.9999.

That holds for similarity of labelled shingles. Links are judged on distinct ones, so texts
that differ in how often they repeat can be linked by the rule and yet share no bucket: with
J the labelled similarity, the probability of one is 1 - (1 - J^3)^16, 0.88 for a long text
and the same text twice over, 0.45 for three times. Such links can be missed;
so can those of texts whose repeats stand in front and shift the rest beyond the band.

Two texts are linked if the distinct shingles that a banded alignment puts side by side
are at least 0.8 of the distinct shingles of both. The alignment is exact: labelled
shingles are unique within a text, so the longest common subsequence within the band is
a longest increasing subsequence; the band is wider than any shift that similarity 0.8
allows.

Copies are one node. Buckets never pair all their members: shingles that only one
candidate text holds bound from above what it can share, which removes every text that
cannot reach 0.8 with any other (exactly, not by a cap). The rest are first compared with
their bucket's hub, the member with the fewest such shingles; pairs that this leaves in
one class are not compared again. Two members of different classes can only be linked if
they share a shingle that the hub lacks, or if both share enough with the hub itself, which
needs a partner shorter than the hub. The former are brought together by the rarest such
shingles alone, a prefix filter: with the shingles that the hub lacks first and rarest
first, the first one that two linked texts share is among the fifth of a text that it can do
without. Both are exact, so no candidate link between different texts is lost.
Classes are connected components by label propagation on tables in the shared folder.

Every row is judged by its own text, whatever its doc_id, which may be null or repeated:
rows get a key of their own before anything else. Null and blank texts are a class each.
A class is named by the smallest doc_id in it, so class_id is null only where no row of
the class has an id. Extra columns are kept by classed_rows() and ignored otherwise.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, map_arrow, table, worker_cache, written

WORDS = 5
SIMILARITY = 0.8
ENTRIES = 16
SAMPLED = 3
CACHE = "shingles"
#: ASCII that is no digit or letter parts words.
FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, kept for a bounded number of them."""

    def __init__(self, most: int = 250_000):
        self.kept: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.kept) > self.most:
            self.kept.clear()
        kept, digest = self.kept, xxhash.xxh3_64_intdigest
        for w in words:
            if w not in kept:
                kept[w] = digest(w)
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, hasher: Hasher, size: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles in order."""
    h = hasher(text.decode("utf-8", "replace").lower().encode().translate(FOLD).split() or text.split())
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * M1 + h[i : len(out) + i]
    return mixed(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number mixed in: unique within the text."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(nth > 0, mixed(s + nth.astype(np.uint64) * M2), s)
    return out


SEEDS = mixed(np.arange(1, ENTRIES + 1, dtype=np.uint64) * M1)


def sketch(h: np.ndarray, sampled: int = SAMPLED) -> np.ndarray:
    """Order MinHash entries of labelled shingles."""
    ranks = mixed(h[None, :] ^ SEEDS[:, None])
    if len(h) > sampled:
        least = np.argpartition(ranks, sampled - 1, axis=1)[:, :sampled]
    else:
        least = np.broadcast_to(np.arange(len(h)), ranks.shape)
    out = SEEDS.copy()
    for column in np.sort(least, axis=1).T:  # the order of the text
        out = mixed(out * M1 + h[column])
    return out


def aligned(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of distinct shingles that the banded alignment of a and b puts side by side; la, lb: their labelled forms."""
    band = (1 / similarity - 1) * max(len(a), len(b)) + WORDS
    _, i, j = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails, back, last = [], np.full(len(j), -1), []
        for k, x in enumerate(j.tolist()):
            p = bisect_left(tails, x)
            back[k] = last[p - 1] if p else -1
            if p == len(tails):
                tails.append(x)
                last.append(k)
            else:
                tails[p], last[p] = x, k
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(k)
            k = back[k]
        i = i[chain]
    da, db = np.unique(a), np.unique(b)
    both = len(np.intersect1d(da, db, assume_unique=True))
    return len(np.unique(a[i])) / max(1, len(da) + len(db) - both)


def sketches(rows: DataFrame) -> DataFrame:
    """row, k1, k2 (the text's key), n (shingles; 0 if blank), keys (buckets). rows: row, text."""
    keyed = rows.select("row", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        hasher = work_state()
        n, keys = [], []
        for t in as_bytes(batch.column(1)):
            h = shingles(t, hasher)
            n.append(len(np.unique(h)))
            keys.append(sketch(labelled(h)).view(np.int64) if len(h) else [])
        yield {"row": batch.column(0), "k1": batch.column(2), "k2": batch.column(3), "n": n, "keys": pa.array(keys, pa.list_(pa.int64()))}

    return map_arrow(keyed, work, "row long, k1 long, k2 long, n long, keys array<long>", CACHE)


def work_state() -> Hasher:
    return worker_cache(CACHE, Hasher)


def buckets(nodes: DataFrame) -> DataFrame:
    """node and its columns by bucket key, buckets of one left out."""
    rows = nodes.select("*", F.explode("keys").alias("bucket")).drop("keys")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").drop("size")
    # a table of its own, so that the join deals both sides and a hot bucket can be split
    return rows.join(written(shared, "shared"), "bucket")


def unique_shingles(texts: DataFrame) -> DataFrame:
    """node, n_own: distinct shingles that no other candidate holds."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        hasher = work_state()
        for a in range(0, batch.num_rows, 128):
            sets = [np.unique(shingles(t, hasher)) for t in as_bytes(batch.column(1)[a : a + 128])]
            rows = np.repeat(np.arange(a, a + len(sets)), [len(s) for s in sets])
            if len(rows):
                yield {"node": batch.column(0).take(pa.array(rows)), "shingle": np.concatenate(sets).view(np.int64)}

    kind = texts.schema["node"].dataType.simpleString()
    each = map_arrow(texts.select("node", "text"), work, f"node {kind}, shingle long", CACHE)
    single = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    return single.groupBy("node").agg(F.count("*").alias("n_own"))


def reaches(similarity: float) -> Column:
    """Whether two texts can share enough, given the shingles that either holds alone."""
    most = F.least(F.col("n") - F.col("n_own"), F.col("n2") - F.col("n_own2"))
    return most >= F.lit(similarity) * (F.col("n") + F.col("n2") - most) - 1e-9


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    named = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")


def compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b, linked (by the alignment), o (distinct shingles in both) and outside (those of a that b lacks)."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        hasher = work_state()

        @lru_cache(64)
        def parsed(t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = shingles(t, hasher)
            return h, labelled(h), np.unique(h)

        linked, both, outside = [], [], []
        for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
            (p, lp, dp), (q, lq, dq) = parsed(x), parsed(y)
            linked.append(aligned(p, q, lp, lq, similarity) >= similarity - 1e-9)
            rest = np.setdiff1d(dp, dq, assume_unique=True)
            both.append(len(dp) - len(rest))
            outside.append(rest.view(np.int64))
        yield {"a": batch.column(0), "b": batch.column(1), "linked": linked, "o": both, "outside": pa.array(outside, pa.list_(pa.int64()))}

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(with_texts(pairs, texts), work, f"a {kind}, b {kind}, linked boolean, o long, outside array<long>", CACHE)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, class (its component's smallest node) of all nodes that have an edge; edges: a, b."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("class")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("class").alias("was"), F.least("class", "heard").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("root"))
        new = written(nearer.join(jump, "class").select("node", "was", F.least("class", "root").alias("class")), "labels")
        discard(labels)
        if new.filter(F.col("was") != F.col("class")).limit(1).count() == 0:
            discard(both)
            return new.select("node", "class")
        labels = new
    raise RuntimeError("the components did not settle")


def link(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b). nodes: node, n, keys; texts: node, text of every node that shares a bucket."""
    own = unique_shingles(texts)
    able = nodes.join(texts.select("node"), "node", "left_semi").join(own, "node", "left").withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    able = written(able.filter(F.col("n") - F.col("n_own") >= F.lit(similarity) * F.col("n") - 1e-9), "able")
    # each member with its bucket's hub, the text that shares most: one row a bucket, from partial aggregates
    rows = able.select("node", "n", "n_own", F.explode("keys").alias("bucket"))
    hub = rows.groupBy("bucket").agg(F.min(F.struct("n_own", "node")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hub = written(hub.select("bucket", F.col("hub.node").alias("hub")), "hubs")
    stars = written(rows.join(hub, "bucket").select("hub", "node", "n", "n_own").distinct(), "stars")
    star = written(compared(stars.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), texts, similarity), "star")
    links = star.filter("linked").select("a", "b")
    # members of one hub in different classes: what they share beside the hub's shingles is rare, and brings them together
    classed = stars.join(components(links), "node", "left").withColumn("class", F.coalesce("class", "node"))
    split = classed.groupBy("hub").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least_n")).filter("low <> high").select("hub", "least_n")
    known = classed.join(split, "hub").join(star.select(F.col("a").alias("node"), F.col("b").alias("hub"), "o", "outside"), ["hub", "node"], "left")
    known = written(known.withColumn("o", F.coalesce("o", "n")), "known")
    facts = ["node", "n", "n_own", "o", "class"]
    second = [F.col(c).alias(f"{c}2") for c in facts]
    beside = known.select("hub", *facts, F.explode("outside").alias("shingle"))
    mixed_up = beside.groupBy("hub", "shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("holders")).filter("low <> high").select("hub", "shingle", "holders")
    # of those, rarest first, only a prefix can hold the first that two linked texts share: all but one of the shingles that a text can do without
    one_text = Window.partitionBy("hub", "node")
    rank, spare = F.row_number().over(one_text.orderBy("holders", "shingle")), F.col("o") + F.count("*").over(one_text) - F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    beside = written(beside.join(mixed_up, ["hub", "shingle"]).withColumns({"rank": rank, "spare": spare}).filter("rank <= spare + 1").drop("holders", "rank", "spare"), "beside")
    cross = (F.col("class") != F.col("class2")) & reaches(similarity)
    pair = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    rare = beside.join(beside.select("hub", "shingle", *second), ["hub", "shingle"]).filter((F.col("node") < F.col("node2")) & cross).select(*pair)
    # without a shingle beside the hub's, both must share enough with the hub: the partner is then shorter than the hub
    share = F.lit(similarity / (1 + similarity))
    short = known.filter(F.floor(F.col("o") / share + 1e-9) - F.col("n") >= F.col("least_n"))
    inside = short.join(known.select("hub", *second), "hub").filter((F.col("node") != F.col("node2")) & cross & (F.least("o", "o2") >= share * (F.col("n") + F.col("n2")) - 1e-9)).select(*pair)
    rest = rare.union(inside).distinct().join(star.select(*[F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]), ["a", "b"], "left_anti")
    return links.union(compared(rest, texts, similarity).filter("linked").select("a", "b"))


def row_classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, class (the smallest row of its class) of every row that shares its class with another; the others are classes of their own. rows: row (unique), text, in a written table."""
    found = written(sketches(rows), "sketches")
    spoken = found.filter("n > 0")
    # copies are one node; a table of its own, so that the joins deal both sides and a hot text can be split
    by_text = written(spoken.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "by_text")
    nodes = written(spoken.withColumnRenamed("row", "node").join(by_text.select("node"), "node"), "nodes")
    shared = buckets(nodes).select("node").distinct()
    texts = written(rows.withColumnRenamed("row", "node").join(shared, "node").select("node", "text"), "texts")
    classes = components(link(nodes.select("node", "n", "keys"), texts, similarity))
    # only texts that have a copy or a link name a class for other rows
    named = by_text.join(classes, "node", "left").filter("copies > 1 OR class IS NOT NULL").select("k1", "k2", F.coalesce("class", "node").alias("class"))
    return spoken.select("row", "k1", "k2").join(written(named, "named"), ["k1", "k2"]).select("row", "class")


def classed_rows(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(row, doc: the columns of docs; a written table; and row_classes of it)."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    return rows, written(row_classes(rows.select("row", "doc.text"), similarity), "classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), a row for each input row."""
    rows, classes = classed_rows(docs.select("doc_id", "text"), similarity)
    ids = rows.select("row", "doc.doc_id").join(classes, "row", "left")
    least = written(ids.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id")), "class_ids")
    return ids.join(least, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs by plain similarity; the alignment asks for the same order besides.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, text AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM documents),
v AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN len(f) > 0 THEN f ELSE regexp_extract_all(coalesce(t, ''), '[^\x20\x09-\x0D]+') END AS ws FROM w),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM v WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rid, rid AS root FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.rid),
m AS (SELECT rid, min(root) AS root FROM c GROUP BY rid)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id FROM v JOIN m USING (rid)
"""

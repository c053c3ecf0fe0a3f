"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item's windows are its runs of 10 words (one shorter window if it has fewer), and a
window is the set of its shingles of 3 words (one shorter shingle if it has fewer). A
document holds a window only if it holds the window's rarest shingle, counted over all
documents; that shingle is the window's prefix, the join key, so a frequent word is no
key. The positional filter keeps keys with room for the window around them; a window is
then verified word by word.

One plan for all sizes. Shingles are 64-bit hashes. Before positions become rows, a bitmap
of the wanted hashes (64 bits a hash, at most 2**22 bits) leaves out nearly all others
inside the document's row; what it lets through is joined exactly. Windows and hits are
tables in the shared folder, so Catalyst knows their size and broadcasts them up to its
threshold; beyond, the joins are shuffled and AQE splits a hot key.

DataFrame functions only. Texts are matched by the two 64-bit hashes of their content, so
rows with null or repeated doc_ids and repeated rows each get their text's result. Null
and empty texts have no words and are clean; items without words have no window; items
with a null id are left out, repeated items count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import DUCK_WORDS, text_keys, words_of

WINDOW = 10
SHINGLE = 3
BITMAP_BITS = (12, 22)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item (as text), window (array of words); distinct."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter("item IS NOT NULL AND size(words) > 0")
    runs = F.expr(f"transform(sequence(0, greatest(size(words) - {size}, 0)), i -> slice(words, i + 1, {size}))")
    return items.select("item", F.explode(runs).alias("window")).distinct()


def shingle(words: str, i: str, width: int) -> str:
    """SQL of the hash of the width words from place i."""
    return f"xxhash64({width}, {', '.join(f'get({words}, {i} + {k})' for k in range(width))})"


def shingles(windows: DataFrame) -> DataFrame:
    """window, off (place), key of each shingle of distinct windows."""
    each = "transform(sequence(0, greatest(size(window) - {w}, 0)), i -> struct(i AS off, {h} AS key))"
    by_width = " ".join(f"WHEN {w} THEN {each.format(w=w, h=shingle('window', 'i', w))}" for w in range(1, SHINGLE + 1))
    return windows.select("window", F.expr(f"explode(CASE least(size(window), {SHINGLE}) {by_width} END)").alias("s")).select("window", "s.off", "s.key")


class Bitmap:
    """Hashes that are wanted, two bits each: bounded, exact only in what it leaves out. With 64 bits a hash one in a thousand others passes."""

    def __init__(self, keys: DataFrame):
        n = keys.agg(F.count("*")).first()[0]
        low, high = BITMAP_BITS
        self.bits = min(high, max(low, (64 * n).bit_length()))
        probes = F.explode(F.array(*[F.struct(F.expr(w).alias("place"), F.expr(f"shiftleft(1L, {b})").alias("bit")) for w, b in self.probes("key")]))
        found = keys.select(probes.alias("p")).groupBy("p.place").agg(F.bit_or("p.bit").alias("word")).collect()  # at most 2**16 numbers
        self.words = [0] * (1 << (self.bits - 6))
        for r in found:
            self.words[r.place] = r.word

    def probes(self, key: str) -> list[tuple[str, str]]:
        """SQL of (place of the word, bit in it), from different bits of the hash."""
        size = self.bits - 6
        return [(f"CAST(shiftrightunsigned({key}, {64 - size}) AS int)", f"CAST({key} & 63 AS int)"), (f"CAST(shiftrightunsigned({key}, 6) & {(1 << size) - 1} AS int)", f"CAST(shiftrightunsigned({key}, 32) & 63 AS int)")]

    def test(self, key: str) -> str:
        """SQL of whether a hash may be wanted."""
        held = f"CAST(split('{','.join(map(str, self.words))}', ',') AS array<bigint>)"
        return " AND ".join(f"getbit(get({held}, {w}), {b}) = 1" for w, b in self.probes(key))


def hits(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """k1, k2, words, and hits: (at, key) of each place whose shingle may be wanted. Neither filter nor explode hits: the optimiser would push a test of their size below the projections and split the text anew for every word; explode_outer them."""
    bitmap = Bitmap(wanted)
    hashed = [F.expr(f"transform(words, (w, i) -> {shingle('words', 'i', w)})").alias(f"h{w}") for w in widths]
    found = [f"filter(transform(h{w}, (h, i) -> IF({bitmap.test('h')}, struct(i AS at, h AS key), NULL)), x -> x IS NOT NULL)" for w in widths]
    rows = docs.select(*text_keys(), words_of(F.col("text")).alias("words")).select("k1", "k2", "words", *hashed)
    return rows.select("k1", "k2", "words", F.expr(f"concat({', '.join(found)})").alias("hits"))


def rarest(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """window, key (the shingle that fewest documents hold) and off (its first place); windows: distinct."""
    spelled = written(shingles(windows), "shingles")
    wanted = written(spelled.select("key").distinct(), "wanted")
    held = hits(docs, wanted, widths).select(F.explode_outer(F.expr("array_distinct(transform(hits, h -> h.key))")).alias("key")).filter("key IS NOT NULL")
    frequency = written(held.groupBy("key").agg(F.count("*").alias("df")), "frequency")
    best = spelled.join(frequency, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "key")).alias("best"))
    return best.select("window", F.size("window").alias("length"), F.col("best.key").alias("key"), F.col("best.off").alias("off"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """k1, k2 (a text's key), `spans`: its set of (start, end) of all occurrences of windows, `items`: sorted ids as text; only texts with any. A written table."""
    docs = docs.select("text")
    windows = written(item_windows(benchmark, size), "windows")
    distinct = windows.select("window").distinct()
    widths = sorted(r[0] for r in distinct.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    keyed = written(rarest(docs, distinct, widths), "keyed")
    reach = size - 1
    # around each key, the words that a window with that key can reach
    near = F.expr(f"transform(hits, h -> struct(h.key AS key, h.at AS at, greatest(h.at - {reach}, 0) AS low, size(words) AS n_words, slice(words, greatest(h.at - {reach}, 0) + 1, {2 * reach + 1}) AS near))")
    places = hits(docs, keyed.select("key").distinct(), widths).select("k1", "k2", F.explode_outer(near).alias("p")).filter("p IS NOT NULL").select("k1", "k2", "p.*")
    start = F.col("at") - F.col("off")
    room = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.expr("slice(near, greatest(at - off - low, 0) + 1, length) = window")
    found = places.join(keyed, "key").filter(room & same).select("k1", "k2", "window", F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span"))
    found = written(found.distinct(), "found")
    items = found.select("k1", "k2", "window").distinct().join(windows, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return written(spans.join(items, ["k1", "k2"]), "leaks")


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["last"], x["start"]))).cast("long").alias("n"), F.greatest(a["last"], x["end"].cast("long")).alias("last")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, `spans`: sorted (start, end) of all occurrences of windows, `items`: sorted ids as text; a row a row of docs."""
    found = leaks(docs, benchmark, size)
    rows = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), *text_keys())
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "n_words", none("spans"), none("items"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, {DUCK_WORDS.replace("(t,", "(text,")} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {DUCK_WORDS.replace("(t,", "(text,")} AS ws FROM benchmark),
i AS (SELECT DISTINCT item, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS win, least(len(ws), {WINDOW}) AS k
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) AS s FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS win
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (SELECT DISTINCT k FROM i))),
h AS (SELECT doc_id, item, s, d.k FROM d JOIN i ON d.k = i.k AND d.win = i.win),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

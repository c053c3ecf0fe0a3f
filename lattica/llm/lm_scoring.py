"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token is a mixture of three maximum-likelihood estimates: its
bigram's share of the context, its own share of all training tokens, and one over the
vocabulary. The mixture weights depend on the bucket (power of two) of the context's
training count. They are learned by expectation-maximisation on deleted data: a tenth of
the training texts is counted apart, and its tokens are explained by the counts of the
others. Scores then use the counts of all training texts.

Counts are exact, up to 64-bit hashes of n-grams, and cover the whole corpus. Documents
are dealt by hash into chunks of bounded size; a chunk sends its distinct n-grams and
their counts, packed and cut by ranges of the hash; a node of the exchange sums what it
hears of a range and answers each sender in the order of its question; a chunk reads the
answers beside its own texts. Up to 256 chunks send to nodes that hear all of them; with
more the exchange has levels (two up to 65,536 chunks, 780 GB; three up to 200 TB), each
node hearing and sending to 256 others, so that messages grow with the chunks and not with
their square. No table of n-grams is broadcast, and a frequent n-gram is one number a chunk. The statistics for the weights are counts of the rounded logarithms
of the three estimates, so their table is bounded whatever the corpus.

A null or empty text is one end token. A row in, a row out; rows with equal doc_id are
scored each; extra columns are ignored. Without training texts all estimates but the
uniform one are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_remainder, small_batches, table, written

CHUNK_BYTES = 12 << 20
CHUNK_ROWS = 200_000
#: Nodes that a node of the exchange hears and sends to.
MOST_FAN = 256
CONTEXT_BUCKETS = 40
STEPS = 8  # cells of a logarithm a factor of e
NONE = -1
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
M1 = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """The tokens of a chunk: distinct n-grams in order of their hash, and each token's place among them."""

    owner: np.ndarray  # the text of each token
    keys: tuple[np.ndarray, np.ndarray]  # hashes of distinct tokens (with BEGIN), of distinct bigrams
    token: np.ndarray
    context: np.ndarray
    bigram: np.ndarray


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenise(texts: list[str | None]) -> Tokens:
    words, sizes = [], []
    for t in texts:
        w = t.encode("utf-8", "replace").lower().split() if t else ()
        words.extend(w)
        sizes.append(len(w))
    known = {w: i for i, w in enumerate(dict.fromkeys(words), 2)}
    hashes = np.concatenate([np.array([BEGIN, END]), np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))])
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    token = np.ones(len(words) + len(texts), np.int64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = ids
    context = np.zeros(len(token), np.int64)
    context[1:] = token[:-1]
    context[ends - sizes] = 0
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, bigram = np.unique(context * len(hashes) + token, return_inverse=True)
    two = scrambled(hashes[pairs // len(hashes)] * M1 + hashes[pairs % len(hashes)])
    order2 = np.argsort(two)
    place2 = np.empty(len(order2), np.int64)
    place2[order2] = np.arange(len(order2))
    return Tokens(np.repeat(np.arange(len(texts)), sizes + 1), (hashes[order], two[order2]), place[token], place[context], place2[bigram])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, named by the first byte."""
    top = int(x.max()) if len(x) else 0
    kind = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    return kind.encode() + x.astype(np.dtype(kind).newbyteorder("<")).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.dtype(x[:1].decode()).newbyteorder("<"), offset=1).astype(np.int64)


QUESTION = "node long, src long, n int, keys binary, total binary, kept binary"
ANSWER = "dst long, node long, n int, total binary, kept binary, sums array<long>"


def slices(keys: np.ndarray, low: int, parts: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys that fall into the ranges low to low + parts - 1 of `ranges` equal ones; those without keys are left out."""
    edge = np.array([(i << 64) // ranges for i in range(low + 1, low + parts)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])
    for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        yield low + i, int(cut[i]), int(cut[i + 1])


def rows_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def asked(chunks: DataFrame, fan: int, first_deleted: int) -> DataFrame:
    """The questions of all chunks: a row a chunk, order (n) and range of the hash, with the counts of the chunk's training tokens, and of those that are not deleted."""

    def work(part: pa.Table) -> pa.Table:
        t = tokenise(part.column("text").to_pylist())
        chunk = part.column("chunk")[0].as_py()
        train = part.column("train").to_numpy()[t.owner]
        starts = np.concatenate([[True], t.owner[1:] != t.owner[:-1]]) if len(t.owner) else np.zeros(0, bool)
        counts = np.bincount(t.token[train], minlength=len(t.keys[0]))
        counts += np.bincount(t.context[train & starts], minlength=len(counts))  # BEGIN, once a text
        rows = []
        for n, keys, c in ((1, t.keys[0], counts), (2, t.keys[1], np.bincount(t.bigram[train], minlength=len(t.keys[1])))):
            for r, a, b in slices(keys, 0, fan, fan):
                rows.append((chunk // fan * fan + r, chunk, n, keys[a:b].astype("<u8").tobytes(), packed(c[a:b]), packed(c[a:b]) if chunk < first_deleted else None))
        return rows_of(rows, QUESTION)

    return chunks.groupBy("chunk").applyInArrow(work, QUESTION)


@dataclass
class Merged:
    """What a node was asked in one order: distinct keys with their sums, and each sender's places among them."""

    n: int
    keys: np.ndarray
    total: np.ndarray
    kept: np.ndarray
    senders: list[tuple[int, np.ndarray]]


def merged(part: pa.Table) -> list[Merged]:
    src, ns = part.column("src").to_pylist(), part.column("n").to_pylist()
    keys, total, kept = (part.column(c).to_pylist() for c in ("keys", "total", "kept"))
    out = []
    for n in (1, 2):
        at = sorted((i for i, x in enumerate(ns) if x == n), key=lambda i: src[i])
        if not at:
            continue
        each = [np.frombuffer(keys[i], "<u8") for i in at]
        distinct, back = np.unique(np.concatenate(each), return_inverse=True)
        summed = lambda xs: np.bincount(back, np.concatenate(xs), len(distinct)).astype(np.int64)  # noqa: E731, B023
        ends = np.cumsum([len(x) for x in each])
        places = np.split(back, ends[:-1])
        out.append(Merged(n, distinct, summed([unpacked(total[i]) for i in at]), summed([unpacked(kept[i]) if kept[i] else np.zeros(len(x)) for i, x in zip(at, each, strict=True)]), [(src[i], p) for i, p in zip(at, places, strict=True)]))
    return out


def passed_on(questions: DataFrame, level: int, fan: int) -> DataFrame:
    """The questions of the next level: a node's sums by finer ranges of the hash, to the nodes that hear `fan` of its like."""
    ranges = fan**level

    def work(part: pa.Table) -> pa.Table:
        node = part.column("node")[0].as_py()
        group, r = divmod(node, ranges)
        rows = []
        for m in merged(part):
            for sub, a, b in slices(m.keys, r * fan, fan, ranges * fan):
                rows.append((group // fan * ranges * fan + sub, node, m.n, m.keys[a:b].tobytes(), packed(m.total[a:b]), packed(m.kept[a:b])))
        return rows_of(rows, QUESTION)

    return questions.groupBy("node").applyInArrow(work, QUESTION)


def replies(node: int, m: Merged, total: np.ndarray, kept: np.ndarray, all_kept: bool, first_deleted: int) -> list[tuple]:
    """An answer to each sender, in the order of its question; who is no deleted chunk needs no counts without deleted texts."""
    return [(src, node, m.n, packed(total[p]), packed(kept[p]) if all_kept or src >= first_deleted else None, None) for src, p in m.senders]


def answered(questions: DataFrame, level: int, first_deleted: int) -> DataFrame:
    """The last level's answers: nodes there hear of all chunks. A row without dst holds sums over a node's tokens: total, kept, kinds in both."""

    def work(part: pa.Table) -> pa.Table:
        node, rows = part.column("node")[0].as_py(), []
        for m in merged(part):
            rows += replies(node, m, m.total, m.kept, level > 1, first_deleted)
            if m.n == 1:
                word = m.keys != BEGIN
                rows.append((None, node, 1, None, None, [int(m.total[word].sum()), int(m.kept[word].sum()), int((m.total[word] > 0).sum()), int((m.kept[word] > 0).sum())]))
        return rows_of(rows, ANSWER)

    return questions.groupBy("node").applyInArrow(work, ANSWER)


def handed_back(questions: DataFrame, answers: DataFrame, level: int, first_deleted: int) -> DataFrame:
    """A level's answers from those of the next one."""

    def work(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return rows_of([], ANSWER)
        node, rows = part.column("node")[0].as_py(), []
        for m in merged(part):
            rows += replies(node, m, in_order(found, "total")[m.n], in_order(found, "kept")[m.n], level > 1, first_deleted)
        return rows_of(rows, ANSWER)

    return questions.groupBy("node").cogroup(answers.filter("dst IS NOT NULL").groupBy("dst")).applyInArrow(work, ANSWER)


def in_order(answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Counts by order, one range after the other: the nodes that answer one asker are numbered by range."""
    found = {1: [], 2: []}
    for _, n, c in sorted(zip(answers.column("node").to_pylist(), answers.column("n").to_pylist(), answers.column(column).to_pylist(), strict=True), key=lambda x: x[:2]):
        found[n].append(unpacked(c))
    return {n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in found.items()}


def corpus_counts(chunks: DataFrame, n_chunks: int, first_deleted: int, most_fan: int) -> tuple[DataFrame, list[int]]:
    """(answers to every chunk, the sums of total, kept, kinds and kinds_kept). With up to most_fan chunks there is one level; otherwise a node of level l hears most_fan nodes of the level before and sends to as many, so that rows grow with the chunks and not with their square."""
    fan, levels = max(2, min(most_fan, n_chunks)), 1
    while fan**levels < n_chunks:
        levels += 1
    question = asked(chunks, fan, first_deleted)
    held = []
    for level in range(1, levels):
        held.append(written(question, "questions"))
        question = passed_on(held[-1], level, fan)
    answers = written(answered(question, levels, first_deleted), "answers")
    sums = answers.filter("dst IS NULL").agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    for level in range(levels - 1, 0, -1):
        lower = written(handed_back(held[level - 1], answers, level, first_deleted), "answers")
        discard(answers, held[level - 1])
        answers = lower
    return answers.filter("dst IS NOT NULL"), list(sums)


def estimates(t: Tokens, answers: pa.Table, column: str, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token counts, context counts, bigram's estimate, token's estimate) of each token."""
    found = in_order(answers, column)
    c, context, pair = found[1][t.token], found[1][t.context], found[2][t.bigram]
    return c, context, pair / np.maximum(context, 1), c / max(1, total)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then a bucket a power of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, CONTEXT_BUCKETS - 1), 0)


def mixture(cells: list[tuple[int, int, int, int]], rounds: int = 40) -> np.ndarray:
    """Weights (bigram, token, uniform) by bucket, by expectation-maximisation; cells: bucket, rounded logs of both estimates over the uniform one, count."""
    start = np.array([0.4, 0.4, 0.2])
    out = np.tile(start, (CONTEXT_BUCKETS, 1))
    if not cells:
        return out
    a = np.array(cells, np.int64)
    ratio = lambda x: np.where(x == NONE * 10**6, 0.0, np.exp(np.clip(x, -400, 400) / STEPS))
    p = np.stack([ratio(a[:, 1]), ratio(a[:, 2]), np.ones(len(a))], 1)

    def learned(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            share = p[rows] * w
            share /= share.sum(1, keepdims=True)
            w = (share * a[rows, 3:4]).sum(0) + np.array([0, 0, 1e-3])
            w /= w.sum()
        return np.maximum(w, 1e-7) / np.maximum(w, 1e-7).sum()

    shared = learned(np.arange(len(a)), start)
    for b in range(CONTEXT_BUCKETS):
        rows = np.flatnonzero(a[:, 0] == b)
        out[b] = learned(rows, shared) if len(rows) else shared
    return out


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, most_fan: int = MOST_FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose held_out is false. docs: doc_id, text, held_out, deleted."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-(size or 0) // chunk_bytes), -(-count // CHUNK_ROWS))
    n_deleted = max(1, -(-n // 10))
    draw = F.xxhash64("doc_id", "text")  # every pass must deal a row alike, so rows that repeat id and text share a chunk
    chunk = F.when(F.col("deleted"), n + F.pmod(draw, F.lit(n_deleted))).otherwise(F.pmod(draw, F.lit(n)))
    chunks = docs.select("doc_id", "text", "held_out", (~F.col("held_out")).alias("train"), chunk.cast("long").alias("chunk"))
    answers, (total, total_kept, kinds, kinds_kept) = corpus_counts(chunks, n + n_deleted, n, most_fan)

    def cells(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
        t = tokenise(part.column("text").to_pylist())
        _, context, p2, p1 = estimates(t, found, "kept", total_kept)
        logs = [np.where(p > 0, np.rint(STEPS * np.log(np.maximum(p, 1e-300) * (kinds_kept + 1))), NONE * 10**6).astype(np.int64) for p in (p2, p1)]
        rows, count = np.unique(np.stack([bucket(context), *logs], 1), axis=0, return_counts=True)
        return pa.table({"bucket": rows[:, 0], "p2": rows[:, 1], "p1": rows[:, 2], "n": count})

    both = chunks.filter(F.col("chunk") >= n).groupBy("chunk").cogroup(answers.filter(F.col("dst") >= n).groupBy("dst"))
    seen = both.applyInArrow(cells, "bucket long, p2 long, p1 long, n long").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    weights = mixture(sorted(tuple(r) for r in seen))

    def score(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
        t = tokenise(part.column("text").to_pylist())
        c, context, p2, p1 = estimates(t, found, "total", total)
        w = weights[bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (kinds + 1)
        add = lambda x: np.bincount(t.owner, x, part.num_rows)
        base = add(np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))))
        return pa.table({
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": np.bincount(t.owner, minlength=part.num_rows),
            "n_known": add(c > 0).astype(np.int64), "train_tokens": np.full(part.num_rows, total), "base_score": base, "score": add(np.log10(p)),
        })

    pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("dst"))
    return pairs.applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = id_remainder(F.col("doc_id"), 10)
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", (rest == 0).alias("held_out"), (rest == 1).alias("deleted")))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express too."""
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: The inner lists are a checksum of the id's digits, bit by bit.
LM_BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 10 = 0 AS held_out FROM documents),
t AS (SELECT rid, doc_id, held_out, unnest(list_append(list_transform(ws, lambda x: 'w' || x), 'end')) AS token FROM (SELECT row_number() OVER () AS rid, * FROM d)),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (token), s GROUP BY rid, doc_id, held_out, n
"""

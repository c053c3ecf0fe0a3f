"""Quality rules as a short-circuit cascade.

Each rule rejects a document from measures of its whole text, which are taken when a rule
first asks for them. Cost (seconds a byte) and rejection rate of every rule are estimated
on a sample of a bounded number of texts, on executors; the cascade asks the rules in
falling order of rejections per cost, and a document leaves it at the first rule that
rejects it, so that it pays for no later measure (`asked` counts the rules). The verdict
is the conjunction of all rules, so it does not depend on the order. The base measures of
op1 are its contract's and are taken of every text; the others (distinct words, pairs of
words) only of those that the cascade still asks about.

Null and empty texts have no words and fail the rule on length. A row in, a row out;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SPACES = b" \t\n\x0b\x0c\r"
PAIR_PLACES = 4


class Text:
    """Measures of one text, each computed when it is first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, SPACES).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def pair_chars(self) -> int:
        """Most code points that the places of one word pair take together, of pairs that stand PAIR_PLACES times or more."""
        pairs = Counter(zip(self.words, self.words[1:], strict=False))
        return max((n * len((a + b).decode("utf-8", "replace")) for (a, b), n in pairs.items() if n >= PAIR_PLACES), default=0)

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 5-word window that the text holds twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in self.words], np.int64)
        if len(known) == self.n_words:
            return 0
        rank, span = ids, len(known)
        for i in range(1, WINDOW):  # exact: each round ranks the windows of one more word
            keys = rank[:n] * np.int64(span) + ids[i : i + n]
            if i == WINDOW - 1:
                break
            _, rank = np.unique(keys, return_inverse=True)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[back] > 1)
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE_RULES = (
    Rule("short", lambda t: t.n_words < 10),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 30 * t.n_symbols > t.word_chars),
    Rule("dup_lines", lambda t: t.n_dup_lines >= 3 and 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words),
    Rule("few_words", lambda t: t.n_words >= 100 and 100 * t.n_distinct < 5 * t.n_words),
    Rule("top_pair", lambda t: 100 * t.pair_chars > 20 * t.word_chars),
)


def estimate(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(name, seconds a character, share rejected) of each rule, asked of every sampled text by itself."""
    out = []
    size = sum(map(len, texts)) or 1
    for rule in rules:
        began, rejected = time.perf_counter(), 0
        for data in texts:
            rejected += rule.rejects(Text(data))
        out.append((rule.name, (time.perf_counter() - began) / size, rejected / max(1, len(texts))))
    return out


def ordered(rules: tuple[Rule, ...], figures: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """By rejections per cost, most first; rules that reject nothing in the sample come last, cheapest first."""
    by = {name: (cost, share) for name, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: (-by[r.name][1] / max(by[r.name][0], 1e-15), by[r.name][0])))


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 256) -> tuple[Rule, ...]:
    """The rules in the order that a sample of at most sample_rows texts suggests. Executors take the sample's measures; the driver gets a few numbers a batch."""
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0).limit(sample_rows)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(0))
        names, cost, share = zip(*estimate(texts, rules), strict=True)
        size = sum(map(len, texts))
        yield {"name": list(names), "seconds": [c * size for c in cost], "rejected": [x * len(texts) for x in share], "bytes": [size] * len(names), "texts": [len(texts)] * len(names)}

    measured = map_arrow(sample, work, "name string, seconds double, rejected double, bytes long, texts long")
    rows = measured.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "bytes", "texts")]).collect()
    by = {r.name: (r.name, r.seconds / (r["bytes"] or 1), r.rejected / max(1, r.texts)) for r in rows}
    return ordered(rules, [by.get(r.name, (r.name, 0.0, 0.0)) for r in rules])


def judged(data: Text, order: tuple[Rule, ...]) -> tuple[str | None, int]:
    """(the first rule that rejects, or None; how many were asked)."""
    for i, rule in enumerate(order, 1):
        if rule.rejects(data):
            return rule.name, i
    return None, len(order)


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 256) -> DataFrame:
    """doc_id, rejected_by (first rejecting rule in the chosen order, or null), asked (rules), kept."""
    order = plan(docs, rules, sample_rows)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [judged(Text(t), order) for t in as_bytes(batch.column(1))]
        yield {"doc_id": batch.column(0), "rejected_by": pa.array([x for x, _ in found], pa.string()), "asked": pa.array([n for _, n in found], pa.int32()), "kept": [x is None for x, _ in found]}

    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rejected_by string, asked int, kept boolean")


def measured_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 256) -> DataFrame:
    """quality_cascade with the base measures of every text; a measure that the cascade took is not taken again."""
    order = plan(docs, rules, sample_rows)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [Text(x) for x in as_bytes(batch.column(1))]
        kept = [judged(t, order)[0] is None for t in texts]
        failed = [any(r.rejects(t) for r in BASE_RULES) for t in texts]
        yield {"doc_id": batch.column(0)} | {m: [getattr(t, m) for t in texts] for m in measures} | {"base_failed": failed, "kept": [k and not f for k, f in zip(kept, failed, strict=True)]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, {', '.join(f'{m} long' for m in measures)}, base_failed boolean, kept boolean")


def rejection_report(docs: DataFrame) -> DataFrame:
    """Documents by the rule that rejected them."""
    return quality_cascade(docs).groupBy("rejected_by").count()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_cascade(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT *, len(ws) AS n,
             list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' ')) AS win FROM w),
o AS (SELECT doc_id, count(*) AS reps FROM (
        SELECT DISTINCT doc_id, s.i + k.k AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c
          FROM (SELECT doc_id, unnest(win) AS x, generate_subscripts(win, 1) AS i FROM g)) s, range(5) k(k)
        WHERE s.c > 1) GROUP BY doc_id),
pr AS (SELECT doc_id, pair, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM w) GROUP BY ALL HAVING count(*) >= 4),
q AS (SELECT doc_id, max(c * (length(pair) - 1)) AS pair_chars FROM pr GROUP BY doc_id),
m AS (SELECT g.doc_id, len(list_distinct(ws)) AS n_distinct, coalesce(pair_chars, 0) AS pair_chars, n AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(reps, 0) AS n_repeat_words, len(ls) AS n_lines
      FROM g LEFT JOIN o USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 30 * n_symbols > word_chars
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (n_words >= 100 AND 100 * n_distinct < 5 * n_words) OR 100 * pair_chars > 20 * word_chars) AS kept
FROM m
"""

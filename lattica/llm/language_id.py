"""Language identification by hierarchical discrimination.

fit(): of each language at most per_language distinct texts (a documented bound, taken by
hash of the text, so that rows without an id or with one id count like any others) train
the model. Whole texts become L2-normed damped counts of hashed byte
n-grams of their lower-cased letters. Linear support vector machines (squared hinge,
L2) first tell language families apart, one against the rest; then, within a family,
one machine for each pair of languages votes.

predict(): the family with the largest margin, then the language with most pairwise
votes, ties to the larger summed margin, then to the earlier code. The score is the
logistic of the family margin times that of the weakest won pair.

`und` with score 0 if a text is null, empty or has no letter, or if nothing could be
learned. A row in, a row out; rows without lang are predicted but teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, gram_counts, id_remainder, map_arrow, table

DIMS = 4096
#: Families of common codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn mr ne pa gu ur si",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: ASCII that is no letter becomes a space, capitals fold; other characters stay.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(texts: list[str]) -> np.ndarray:
    letters = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(FOLD).split()) + b" " for t in texts]
    x = np.hstack([np.sqrt(gram_counts(letters, 256, 1)), np.sqrt(gram_counts(letters, DIMS, 2)), np.sqrt(gram_counts(letters, DIMS, 3))])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 80) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge by accelerated gradient steps; y is -1 or 1, classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    step = 1.0 / (1.0 / len(y) + 4 * c)  # rows have squared length 2, balance has mean 1
    w = v = np.zeros(x.shape[1], np.float32)
    y = y.astype(np.float32)
    balance = balance.astype(np.float32)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / len(y) - (2 * c / len(y)) * (x.T @ (balance * y * slack))
        new = v - step * grad
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: dict[str, np.ndarray] = field(default_factory=dict)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = features(texts)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        logistic = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        names = sorted(self.members)
        margins = np.stack([x @ self.families[f] if f in self.families else np.full(len(x), 3.0) for f in names], 1)
        best, out, score = margins.argmax(1), [""] * len(x), logistic(margins.max(1))
        for j, name in enumerate(names):
            rows, langs = np.flatnonzero(best == j), self.members[name]
            if not len(rows):
                continue
            votes, sums, weakest = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), 20.0)
            for (a, b), w in self.pairs.items():
                if a in langs and b in langs:
                    m = x[rows] @ w
                    for lang, side in ((a, m), (b, -m)):
                        k = langs.index(lang)
                        votes[:, k] += side > 0
                        sums[:, k] += side
                        weakest[:, k] = np.minimum(weakest[:, k], side)
            won = np.lexsort((np.broadcast_to(-np.arange(len(langs)), votes.shape), sums, votes), axis=1)[:, -1]
            for i, r in enumerate(rows):
                out[r] = langs[won[i]]
            score[rows] *= logistic(weakest[np.arange(len(rows)), won])
        return out, score


def train(x: np.ndarray, langs: np.ndarray) -> Model:
    model = Model()
    for lang in sorted(set(langs)):
        model.members.setdefault(family(lang), []).append(lang)
    groups = np.array([family(x) for x in langs])
    if len(model.members) > 1:
        for name in model.members:
            model.families[name] = svm(x, np.where(groups == name, 1.0, -1.0))
    for members in model.members.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = np.flatnonzero((langs == a) | (langs == b))
                model.pairs[a, b] = svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
    return model


def fit(docs: DataFrame, per_language: int = 600) -> Model | None:
    """docs: text, lang; the driver gets a row a language, and at most per_language feature vectors of each."""
    draw = F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 40))
    known = docs.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("draw", draw)
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return None
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2.0 * per_language / n) * (1 << 40)))).otherwise(limit)
    # copies once, and then no more of a language than asked for, before anything is collected
    drawn = known.filter(F.col("draw") <= limit).dropDuplicates(["lang", "draw"])
    place = Window.partitionBy("lang").orderBy("draw")
    rows = drawn.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_language)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(0).to_pylist()
        for a, b in blocks([len(t) for t in texts]):
            has = [i for i in range(a, b) if LETTER.search(texts[i])]
            if has:
                x = features([texts[i] for i in has]).astype(np.float16)
                yield {"lang": batch.column(1).take(has), "draw": batch.column(2).take(has), "x": [r.tobytes() for r in x]}

    kept: dict[str, list] = {}
    for r in map_arrow(rows.select("text", "lang", "draw"), work, "lang string, draw long, x binary").collect():
        kept.setdefault(r.lang, []).append((r["draw"], r.x))
    pairs = [(lang, x) for lang in sorted(kept) for _, x in sorted(kept[lang])[:per_language]]
    if not pairs:
        return None
    return train(np.stack([np.frombuffer(x, np.float16) for _, x in pairs]).astype(np.float32), np.array([lang for lang, _ in pairs]))


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in blocks([len(t) for t in texts]):
            has = [i for i in range(a, b) if held.value and LETTER.search(texts[i])]
            lang, score = ["und"] * (b - a), [0.0] * (b - a)
            if has:
                for i, name, s in zip(has, *held.value.predict([texts[i] for i in has]), strict=True):
                    lang[i - a], score[i - a] = name, float(s)
            yield {"doc_id": batch.column(0)[a:b], "lang_pred": lang, "score": score}

    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    found = predict_language(docs, fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

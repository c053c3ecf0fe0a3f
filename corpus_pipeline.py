"""From documents to training sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and reread. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, near_dedup, packing, quality_classifier, substring_dedup
from lattica.llm.common import table, written
from lattica.llm.words import text_keys

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours call good; all where no label can be learned from."""
    model = quality_classifier.fit(docs, quality_classifier.train_rows(table(spark, sf_dir, "labels")))
    return quality_classifier.good_documents(docs, model, quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class, one without id only where none has one; ids may be null or repeated."""
    rows, found = near_dedup.classed_rows(docs)
    place = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.xxhash64("doc.text"), "row")
    first = rows.join(found, "row").groupBy("class").agg(F.min(place).alias("place")).select("place.row")
    gone = written(found.select("row").join(first, "row", "left_anti"), "gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte ranges that other places repeat; a character that a range cuts goes whole, a text of which nothing is left goes."""
    found = substring_dedup.without_repeats(docs)

    cut = found.select("row", "text", (F.size("spans") > 0).alias("cut"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.filter(~F.col("cut") | F.col("text").rlike(r"\S")).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    leaked = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    k1, k2 = text_keys()  # a text's windows do not depend on its id
    return docs.join(leaked.select(F.col("k1").alias("leaked1"), F.col("k2").alias("leaked2")), (k1 == F.col("leaked1")) & (k2 == F.col("leaked2")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece, with its place in the sequences."""
    return packing.pack(packing.pieces(docs, packing.vocabulary_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

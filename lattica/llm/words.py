"""Word expressions shared by the native scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower

#: Everything below U+0080 but digits and lower-case letters parts words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a whole text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def text_keys() -> list[Column]:
    """k1, k2: two 64-bit hashes of a whole text, by which texts are told apart."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def known_set(words: list[str]) -> str:
    """A SQL list of words; they hold no quote or backslash, which part words."""
    return ", ".join(f"'{w}'" for w in words) or "NULL"


#: The same words in DuckDB, of the column t.
DUCK_WORDS = r"regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

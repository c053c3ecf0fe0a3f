"""Scalar expressions: stable keys, parsing, URLs, vectors and distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lattica.functions import urls


def stable_hex(*parts: Column, separator: str = "|") -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts; orders as the unsigned number does. Nulls are joined as empty."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(separator, *text), 256), 1, 16)


def stable_key(*parts: Column, separator: str = "|") -> Column:
    """The same as an unsigned 64-bit number, decimal(20,0)."""
    return F.conv(stable_hex(*parts, separator=separator), 16, 10).cast("decimal(20,0)")


def stable_jitter(*parts: Column, separator: str = "\x1f") -> Column:
    """The same scaled to [0, 1)."""
    return stable_key(*parts, separator=separator).cast("double") / F.lit(float(1 << 64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(x: Column) -> Column:
    """A 64-bit perceptual hash of 16 hex digits as a signed number; null if malformed."""
    return F.when(x.rlike("^[0-9a-fA-F]{16}$"), F.conv(x, 16, -10).cast("long"))


def whole_number(x: Column) -> Column:
    """Text of an exact whole number ('123.0' is one) as long; null otherwise."""
    d = x.try_cast("decimal(38,9)") if hasattr(x, "try_cast") else F.expr("null")
    return F.when(d == F.floor(d), d.cast("long"))


def identity_number(x: Column) -> Column:
    """whole_number of non-blank text; blank is null."""
    return whole_number(F.when(F.trim(x) != "", x))


def clean_text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def instant(x: Column) -> Column:
    """ISO-8601 text as a timestamp; a time without zone is null."""
    return F.when(x.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(x))


def vector_of_json(x: Column) -> Column:
    """JSON list as doubles; null if malformed or if any member is null."""
    v = F.from_json(x, "array<double>")
    return F.when(F.forall(v, lambda a: a.isNotNull()), v)


def ids_of_text(x: Column) -> Column:
    """'3;1;2' as a sorted list of numbers."""
    return F.array_sort(F.transform(F.split(x, ";"), lambda a: a.cast("long")))


def text_of_ids(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda a: a.cast("string")), ";")


def resolved_path(base: Column, path: Column) -> Column:
    """An absolute path or URI as it stands, another one under base."""
    return F.when(path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))


def single_precision(x: Column) -> Column:
    """x rounded to a float, so that it survives a text round trip; raises where it is not finite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("float")).otherwise(x.cast("float"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as DuckDB has it: x * 10^digits in doubles to the nearest whole number, halves away from zero, and back. F.round judges halves by the shortest decimal text, which differs where the product falls on the other side."""
    y = x * F.lit(10.0**digits)
    up = lambda z: F.floor((F.floor(z * 2) + 1) / 2)
    whole = F.when(y < 0, -up(-y)).otherwise(up(y)).cast("double")
    back = F.when(F.abs(y) < float(1 << 51), whole).otherwise(y) / F.lit(10.0**digits)
    return F.when(F.abs(y) == float("inf"), x).otherwise(back)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x computed once a row and not once for each place at which a lambda names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def softmax(v: Column) -> Column:
    shifted = lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(let(v, shifted), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def zscore(x: Column, *partition: str) -> Column:
    """Population z-score in its partition; 0 for one row or no spread."""
    w = Window.partitionBy(*partition)
    sd = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) <= 1) | (sd < 1e-12), F.lit(0.0)).otherwise((x - F.avg(x).over(w)) / sd)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


large_url = urls.large_url
api_url = urls.api_url

"""Landed API pages: nested records, their classification and census.

Fetching is not the engine's: pages land as JSON files (plain or gzip), and a file stream
or a scan reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import instant, stable_hex
from lattica.functions.urls import large_url
from lattica.operators.gates import first_reason

RECORD = "id long, user struct<id: long>, taxon struct<id: long, name: string, rank: string, is_active: boolean, ancestor_ids: array<long>>, quality_grade string, created_at string, observed_on string, photos array<struct<id: long, license_code: string, attribution: string, url: string>>"
PAGE = f"page int, results array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ['id long', 'user struct<id: long>', 'taxon struct<id: long, name: string, rank: string, is_active: boolean, ancestor_ids: array<long>>', 'quality_grade string', 'created_at string', 'observed_on string', 'photos array<struct<id: long, license_code: string, attribution: string, url: string>>'])}>>"
#: Licences under which photos may be used, and hosts that hold them.
LICENSES = ("cc0", "cc-by", "cc-by-sa")
HOSTS = ("inaturalist-open-data.s3.amazonaws.com", "static.inaturalist.org")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A row a record with its page and place; a malformed file raises."""
    p = spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return p.select("page", F.posexplode("results").alias("place", "o")).select("page", "place", "o.*")


def page_stream(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """The same as a file stream that takes some files a trigger."""
    p = spark.readStream.schema(PAGE).option("multiLine", True).option("maxFilesPerTrigger", files).json(path)
    return p.select("page", F.posexplode("results").alias("place", "o")).select("page", "place", "o.*")


def usable(photos: Column, licenses: tuple[str, ...] = LICENSES, hosts: tuple[str, ...] = HOSTS, old: Column | None = None) -> Column:
    """Photos with an id that is not among `old` ones, an allowed licence, an attribution and an address of a known size on an allowed host; of several with one id the first."""
    known = F.coalesce(old, F.expr("CAST(array() AS array<bigint>)")) if old is not None else F.expr("CAST(array() AS array<bigint>)")
    good = F.filter(photos, lambda p: p["id"].isNotNull() & ~F.array_contains(known, p["id"]) & p["license_code"].isin(*licenses) & (F.coalesce(p["attribution"], F.lit("")) != "") & large_url(p["url"], hosts).isNotNull())
    ids = F.transform(good, lambda p: p["id"])
    return F.transform(F.filter(F.transform(good, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: F.array_position(ids, s["p"]["id"]) == s["i"] + 1), lambda s: s["p"])


def classified(records: DataFrame, taxon: int | None, cutoff: str, historical_groups: DataFrame, historical_observers: DataFrame, historical_photos: DataFrame | None = None, least: int = 2, most: int = 5, licenses: tuple[str, ...] = LICENSES, hosts: tuple[str, ...] = HOSTS, descendants: bool = False) -> DataFrame:
    """Each record with its first reason to fall out, or null and its first `most` usable photos by id. A record's taxon must be the one asked for (its own column `wanted` if taxon is null), or with `descendants` one below it; a creation time needs its zone. History: frames with id; records keep their ids once each."""
    h = records.join(historical_groups.select("id").distinct().withColumn("old_group", F.lit(True)), "id", "left")
    h = h.join(historical_observers.select(F.col("id").alias("observer")).distinct().withColumn("old_observer", F.lit(True)), F.col("user.id") == F.col("observer"), "left")
    old = None
    if historical_photos is not None:
        shown = records.select("id", F.explode("photos.id").alias("photo")).join(historical_photos.select(F.col("id").alias("photo")), "photo", "left_semi")
        h = h.join(shown.groupBy("id").agg(F.collect_set("photo").alias("old_photos")), "id", "left")
        old = F.col("old_photos")
    want = F.lit(taxon) if taxon is not None else F.col("wanted")
    same = F.col("taxon.id") == want
    at = F.when(F.col("created_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), instant(F.col("created_at")))
    kept = F.slice(F.array_sort(usable(F.coalesce("photos", F.expr("array()")), licenses, hosts, old)), 1, most)
    reason = first_reason([
        ("invalid_source_identity", F.col("id").isNull() | F.col("user.id").isNull()), ("historical_observation", F.col("old_group")), ("historical_observer", F.col("old_observer")),
        ("not_exact_species_id", ~F.coalesce(same | F.array_contains("taxon.ancestor_ids", want) if descendants else same, F.lit(False))), ("not_research_grade", ~F.col("quality_grade").eqNullSafe(F.lit("research"))),
        ("invalid_created_at", at.isNull()), ("after_creation_cutoff", at > F.lit(cutoff).cast("timestamp")), ("fewer_than_two_usable_photos", F.size(kept) < least),
    ])
    out = h.withColumn("reason", reason).withColumn("kept", F.when(F.col("reason").isNull(), kept))
    return out.drop("old_group", "old_observer", "observer", "old_photos")


def hashed_photos(photos: Column, seed: int, most: int) -> Column:
    """The photos with the smallest stable keys."""
    return F.transform(F.slice(F.array_sort(F.transform(photos, lambda p: F.struct(stable_hex(F.lit(seed), p["id"]).alias("h"), p.alias("p")))), 1, most), lambda s: s["p"])


def census(records: DataFrame, taxon: str, observer: str, target: int = 10) -> DataFrame:
    """Records (each id once), observers and what is missing to the target, by taxon."""
    return records.dropDuplicates(["id"]).groupBy(taxon).agg(F.count("*").alias("records"), F.count_distinct(observer).alias("observers"), F.greatest(F.lit(0), F.lit(target) - F.count_distinct(observer)).alias("shortfall"))


def exact_names(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """name, id of wanted names that exactly one active record has, by case-folded name; others have a null id."""
    f = found.filter("is_active").select(F.lower("name").alias("k"), "id").groupBy("k").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return wanted.select("name", F.lower("name").alias("k")).join(f, "k", "left").select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def first_seen(rows: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """The first row of each key in the order, and of those the first `limit`."""
    from lattica.operators.select import top_per_group

    one = top_per_group(rows, [key], [order], 1)
    return one.orderBy(order).limit(limit) if limit is not None else one

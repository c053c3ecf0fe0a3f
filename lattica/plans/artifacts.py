"""Queries that write with the library's sinks and read with its scans, and on records, files, images and set models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import scalars as V
from lattica.functions import urls
from lattica.operators import aggregators, dedup, gates, infer, joins, lineage, manifest, review, select, strata, subsets
from lattica.plans.binding import CLASSES, LINES_SQL, POOLED_SQL, groups, photos, table
from lattica.plans.lattice import r, scored
from lattica.plans.relational import FLIPS, HASH_SQL, hashes
from lattica.sources import landing, readers, scratch, writers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sinks and scans: what is written is read again


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def csv_round_trip(spark, sf_dir):
    """A table as CSV and under a stated schema again."""
    path = scratch.folder(spark, "csv") + "/t"
    writers.csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return readers.csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("""SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def csv_as_text(spark, sf_dir):
    """Every column as text, with empty fields as empty text."""
    path = scratch.folder(spark, "csv") + "/t"
    writers.csv(table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("segment")), path)
    return readers.csv_text(spark, path)


@query("""SELECT l_orderkey, l_partkey, l_linenumber::VARCHAR AS l_linenumber FROM lineitem""")
def manifest_round_trip(spark, sf_dir):
    """Whole numbers written as '12' or '12.0' read as exact ones."""
    path = scratch.folder(spark, "manifest") + "/t"
    whole = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))).otherwise(F.col("l_partkey").cast("string"))
    writers.csv(table(spark, sf_dir, "lineitem").select("l_orderkey", whole.alias("l_partkey"), "l_linenumber"), path)
    return readers.manifest(spark, path, ["l_orderkey", "l_partkey"])


@query("""SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events""")
def json_lines_round_trip(spark, sf_dir):
    """JSON lines with nulls kept."""
    path = scratch.folder(spark, "json") + "/t"
    writers.json(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")), path)
    return readers.json_lines(spark, path, "event_id long, user_id long, event_type string, value double")


@query("""SELECT p_brand, p_partkey, p_size FROM part""")
def parquet_round_trip(spark, sf_dir):
    """A table in folders by a column's value."""
    path = scratch.folder(spark, "parquet") + "/t"
    writers.parquet(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), path, partition=["p_brand"])
    return spark.read.schema("p_partkey long, p_size int, p_brand string").parquet(path).select("p_brand", F.col("p_partkey"), F.col("p_size"))


@query("""SELECT r_name AS region, n_name AS nation, s_suppkey AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def nested_objects(spark, sf_dir):
    """A JSON object a region, of nations that hold their suppliers, as a row a supplier."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("supplier"))).alias("members"))
    g = n.join(s, "n_nationkey").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "members")).alias("groups"))
    path = scratch.folder(spark, "objects") + "/t"
    scratch.one_file_a_row(g.select(F.col("n_regionkey").cast("int").alias("n"), F.to_json(F.struct("groups")).alias("body")), "n", "body", path, 5)
    objects = readers.json_objects(spark, path, "groups array<struct<region: string, nation: string, members: array<struct<supplier: long>>>>")
    return readers.nested_members(objects, "groups", "members", ["region", "nation"], ["supplier"])


@query("""SELECT c_custkey % 1000 AS image_id, c_nationkey AS category_id, 'file-' || c_custkey % 1000 || '.jpg' AS file_name, n_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def annotated_images(spark, sf_dir):
    """Categories, images and annotations of one JSON file, joined."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("image_id"), F.col("c_nationkey").cast("long").alias("category_id"))
    notes = c.agg(F.collect_list(F.struct("image_id", "category_id")).alias("annotations"))
    images = c.select("image_id").distinct().agg(F.collect_list(F.struct(F.col("image_id").alias("id"), F.concat(F.lit("file-"), "image_id", F.lit(".jpg")).alias("file_name"))).alias("images"))
    categories = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))).alias("categories"))
    path = scratch.folder(spark, "coco") + "/t"
    one = notes.crossJoin(images).crossJoin(categories)  # one row each
    scratch.one_file_a_row(one.select(F.lit(0).alias("n"), F.to_json(F.struct("categories", "images", "annotations")).alias("body")), "n", "body", path, 1)
    schema = "categories array<struct<id: long, name: string>>, images array<struct<id: long, file_name: string>>, annotations array<struct<image_id: long, category_id: long>>"
    return readers.annotated_images(readers.json_objects(spark, path, schema))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last, len(embedding) AS width FROM embeddings""")
def feature_table(spark, sf_dir):
    """Vectors as matrices on files, read by the index, aligned by key."""
    e = table(spark, sf_dir, "embeddings")
    path = scratch.folder(spark, "features")
    writers.matrices(e.repartition(4), path, "vec_id", "embedding", 300).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    gates.require(gates.unique(index, ["vec_id"]))
    x = aggregators.aligned(readers.feature_matrix(spark, f"{path}/*.npy", index, "vec_id"), e.select("vec_id"), "vec_id")
    at = lambda i: r(F.element_at("feature", i).cast("double"), 6)
    return x.select("vec_id", at(1).alias("first"), at(-1).alias("last"), F.size("feature").alias("width"))


def nation_files(spark, sf_dir) -> str:
    """A folder of 25 small files, a nation's name each."""
    path = scratch.folder(spark, "nation-files") + "/t"
    scratch.one_file_a_row(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n"), F.col("n_name").alias("body")), "n", "body", path, 25)
    return path


@query("""SELECT sha256(n_name || chr(10)) AS sha256, octet_length(encode(n_name)) + 1 AS bytes FROM nation""")
def file_digests(spark, sf_dir):
    """Digest and size of files, read by executors."""
    return lineage.file_digests(spark, nation_files(spark, sf_dir)).filter("bytes > 0").select("sha256", "bytes")


@query("""SELECT sha256(n_name || chr(10)) AS sha256, octet_length(encode(n_name)) + 1 AS bytes FROM nation""")
def binary_files(spark, sf_dir):
    """The same from the scan of binary files."""
    return readers.binary(spark, nation_files(spark, sf_dir) + "/part-*").filter("bytes > 0").select("sha256", "bytes")


@query("""SELECT n_name AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 4 = 1 THEN 'changed' ELSE 'unexpected' END AS state FROM nation WHERE n_nationkey % 4 < 3""")
def artifact_drift(spark, sf_dir):
    """Artifacts that are gone, changed or new against their ledger."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), (F.col("n_nationkey") % 4).alias("kind"))
    actual = n.filter("kind <> 0").withColumn("sha256", F.when(F.col("kind") == 1, F.sha2(F.concat("path", F.lit("x")), 256)).otherwise(F.col("sha256")))
    return lineage.drift(n.filter("kind <> 2"), actual)


@query("""SELECT r_name AS artifact, 'ok' AS state FROM region UNION ALL SELECT n_name, CASE WHEN n_nationkey % 6 = 0 THEN 'changed' WHEN n_nationkey % 6 = 1 THEN 'missing' ELSE 'ok' END FROM nation""")
def lineage_tree(spark, sf_dir):
    """Everything that a root marker rests on: regions' markers, and below them nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    digest = lambda c: F.sha2(c, 256)
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), digest("r_name").alias("sha256"))
    markers = lineage.finish(None, "root", "v1", regions)
    markers = markers.unionAll(n.select(F.col("r_name").alias("stage"), F.lit("v1").alias("contract"), F.col("n_name").alias("artifact"), digest("n_name").alias("sha256")))
    now = n.filter("n_nationkey % 6 <> 1").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 6 == 0, digest(F.lit("other"))).otherwise(digest("n_name")).alias("sha256"))
    return lineage.verify_tree(markers, regions.unionAll(now), "root")


@query("""SELECT false AS before, true AS after, 25::BIGINT AS artifacts""")
def stage_markers(spark, sf_dir):
    """A stage without a marker is not done; with one, and its artifacts as they were, it is."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    first = lineage.finish(None, "ingest", "v1", n)
    both = lineage.finish(first, "train", "v2", n.limit(0))
    states = [lineage.resumable(first, "train", "v2", n), lineage.resumable(both, "ingest", "v1", n)]
    return both.filter("stage = 'ingest'").agg(F.count("*").alias("artifacts")).select(F.lit(states[0]).alias("before"), F.lit(states[1]).alias("after"), "artifacts")


@query("""SELECT 'frozen' AS status, count(*) AS pinned FROM nation""")
def frozen_protocol(spark, sf_dir):
    """A protocol that is frozen and whose pinned files have the digests it records."""
    found = {x.sha256: x.bytes for x in lineage.file_digests(spark, nation_files(spark, sf_dir)).filter("bytes > 0").collect()}  # 25 small files
    settings = {"status": " Frozen ", "freeze": {x: x for x in found}}
    path = scratch.folder(spark, "protocol") + "/t"
    scratch.one_file_a_row(spark.createDataFrame([(0, json.dumps(settings))], "n int, body string"), "n", "body", path, 1)
    body = json.loads(spark.read.text(path, wholetext=True).first()[0])
    readers.require_frozen(body, {x: x for x in found})
    return spark.createDataFrame([(body["status"].strip().lower(), len(body["freeze"]))], "status string, pinned long")


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def canonical_hashes(spark, sf_dir):
    """A row's hash over its columns in sorted order."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", lineage.canonical_hash(o, ["o_orderstatus", "o_orderkey", "o_custkey"]).alias("hash"))


# Tables, joins and gates


@query("""SELECT n_nationkey AS taxon_id, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation""")
def replaced_class(spark, sf_dir):
    """One row of a class table replaced in its slot."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("taxon_id"), "n_name", "n_regionkey")
    return manifest.replaced(n, F.lit(3), {"n_name": F.lit("NEW"), "n_regionkey": F.lit(0)})


@query("""SELECT l_orderkey, l_linenumber, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey""")
def expanded_features(spark, sf_dir):
    """One feature row to each relation that names it."""
    f = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return joins.expand(f, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber"), "p_partkey").drop("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def relation_measures(spark, sf_dir):
    """Measurements of unique items under every relation's own ids; items without one keep their rows."""
    f = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_size")
    rel = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return joins.relation_rows(f, rel, "p_partkey", ["p_size"]).drop("p_partkey")


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM orders""")
def applied_split(spark, sf_dir):
    """Every group gets its observer's split; a missing or repeated one would raise."""
    split = F.get(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("c_custkey") % 3).cast("int"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), split.alias("split"))
    out, bad = joins.many_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), s, ["o_custkey"])
    gates.require(bad)
    return out.select("o_orderkey", "split")


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) WHERE n <= 2""")
def first_without_history(spark, sf_dir):
    """Of what no history holds the first two a class."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return select.top_per_group(joins.without_history(table(spark, sf_dir, "customer"), [o], "c_custkey"), ["c_nationkey"], ["c_acctbal", "c_custkey"], 2).select("c_nationkey", "c_custkey")


@query("""SELECT 'disjoint_k' AS gate, k::VARCHAR AS key, 'in history' AS detail FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k % 2 = 0 AND k IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def seed_overlap(spark, sf_dir):
    """Seed ids that the history holds."""
    seed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).filter("k % 2 = 0")
    return gates.disjoint(seed, table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")), "k")


# Scalars


@query("""SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS price FROM orders""")
def single_precision(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.single_precision(F.col("o_totalprice")).cast("double").alias("price"))


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1""")
def identity_lists(spark, sf_dir):
    """Ids as text and back, sorted as numbers."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("all"))
    ids = V.ids_of_text(V.text_of_ids(F.col("all")))
    return o.select("o_custkey", V.text_of_ids(ids).alias("ids"), F.size(ids).cast("long").alias("n"))


@query("""SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS second, vec_id % 9 <> 0 AS valid FROM embeddings""")
def json_vectors(spark, sf_dir):
    """Vectors as JSON and back; a malformed one is null."""
    e = table(spark, sf_dir, "embeddings")
    text = F.when(F.col("vec_id") % 9 == 0, F.lit("[1.0, null]")).otherwise(F.to_json(F.transform("embedding", lambda x: x.cast("double"))))
    v = V.vector_of_json(text)
    return e.select("vec_id", r(F.get("embedding", F.lit(1)).cast("double"), 6).alias("second"), v.isNotNull().alias("valid"))


@query("""SELECT p_partkey, bit_count(xor(('0x' || substr(sha256(p_name), 1, 15))::BIGINT, ('0x' || substr(sha256(p_type), 1, 15))::BIGINT))::INT AS distance FROM part""")
def hash_distances(spark, sf_dir):
    """Bits in which two hashes in hex differ."""
    h = lambda c: V.hash_from_hex(F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 15)))
    return table(spark, sf_dir, "part").select("p_partkey", V.hamming(h("p_name"), h("p_type")).alias("distance"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '/abs/' || n_name ELSE '/base/' || n_name END AS path FROM nation""")
def resolved_paths(spark, sf_dir):
    given = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/abs/"), "n_name")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", V.resolved_path(F.lit("/base/"), given).alias("path"))


#: Size words and ends of file names that the query below puts together.
STEMS = ("square", "small", "medium", "large", "original", "huge")
ENDS = (".jpg", ".JPEG", ".png?v=1", ".webp", ".", "", ".tiff", ".gif#x")


@query(f"""WITH u AS (SELECT p_partkey, {list(STEMS)}[(p_partkey % 6 + 1)::INT] AS stem, {list(ENDS)}[(p_partkey // 6 % 8 + 1)::INT] AS ending, CASE WHEN p_partkey % 11 = 0 THEN 'http' ELSE 'https' END AS scheme FROM part)
SELECT p_partkey,
 CASE WHEN scheme = 'https' AND stem <> 'huge' AND ending NOT IN ('', '.tiff') THEN 'https://static.inaturalist.org/p/' || p_partkey || '/large' || regexp_replace(ending, '[?#].*', '') END AS strict,
 CASE WHEN stem IN ('square', 'small', 'medium', 'large') AND ending NOT IN ('', '.') THEN scheme || '://static.inaturalist.org/p/' || p_partkey || '/large' || ending END AS plain,
 CASE WHEN stem IN ('square', 'small', 'medium', 'large') AND ending <> '' THEN scheme || '://static.inaturalist.org/p/' || p_partkey || '/large' || ending END AS bare FROM u""")
def image_urls(spark, sf_dir):
    """Photo addresses brought to one size: strict, plain, and with an empty extension allowed."""
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    k = F.col("p_partkey")
    scheme = F.when(k % 11 == 0, "http").otherwise("https")
    url = F.concat(scheme, F.lit("://static.inaturalist.org/p/"), k.cast("string"), F.lit("/"), pick(STEMS, k % 6), pick(ENDS, F.floor(k / 6) % 8))
    u = table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))
    return u.select("p_partkey", urls.large_url(F.col("url"), landing.HOSTS).alias("strict"), urls.resized(F.col("url")).alias("plain"), urls.resized(F.col("url"), need_extension=False).alias("bare"))


@query("""SELECT n_nationkey, 'https://api.example.org/v1/taxa?q=' || replace(n_name, ' ', '+') || '&page=' || n_regionkey AS url FROM nation""")
def api_urls(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", urls.api_url("https://api.example.org/v1/taxa", q=F.col("n_name"), page=F.col("n_regionkey")).alias("url"))


# Landed records


LANDED_SQL = """ln AS (SELECT l_orderkey, l_partkey, l_linenumber % 4 <> 3 AND l_suppkey % 5 <> 0 AND l_partkey % 13 <> 0 AS ok FROM lineitem),
ids AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey) FILTER (ok))) AS ids FROM ln GROUP BY 1),
rec AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 0 THEN 'invalid_source_identity' WHEN o_orderkey % 19 = 0 THEN 'historical_observation' WHEN o_custkey % 23 = 0 THEN 'historical_observer'
  WHEN o_orderpriority LIKE '5%' THEN 'not_exact_species_id' WHEN o_orderstatus = 'F' THEN 'not_research_grade' WHEN o_orderkey % 29 = 0 THEN 'invalid_created_at' WHEN o_orderkey % 31 = 0 THEN 'after_creation_cutoff'
  WHEN coalesce(len(ids), 0) < 2 THEN 'fewer_than_two_usable_photos' END AS reason, ids FROM orders LEFT JOIN ids ON l_orderkey = o_orderkey)"""


@query(f"""WITH {LANDED_SQL} SELECT id, reason, CASE WHEN reason IS NULL THEN array_to_string(ids[1:5], ';') END AS kept FROM rec""")
def landed_records(spark, sf_dir):
    """Landed records with their first reason to fall out, or the photos they keep: licence, address, history, identity, taxon, grade, time."""
    return classified(spark, sf_dir).select("id", "reason", V.text_of_ids(F.transform("kept", lambda p: p["id"])).alias("kept"))


@query(f"""WITH {LANDED_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS records FROM rec GROUP BY 1""")
def landed_attrition(spark, sf_dir):
    """Records by their first reason."""
    return classified(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("records"))


def classified(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    code = F.get(F.array(F.lit("cc0"), F.lit("cc-by"), F.lit("cc-by-sa"), F.lit("cc-by-nc")), (F.col("l_linenumber") % 4).cast("int"))
    url = F.concat(F.when(F.col("l_suppkey") % 5 == 0, "http").otherwise("https"), F.lit("://static.inaturalist.org/p/"), F.col("l_partkey").cast("string"), F.lit("/medium.jpg"))
    photo = F.struct(F.col("l_partkey").cast("long").alias("id"), code.alias("license_code"), F.lit("someone").alias("attribution"), url.alias("url"))
    p = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(photo).alias("photos"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.when(k % 29 == 0, "2024-01-01T00:00:00").when(k % 31 == 0, "2030-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00+00:00")
    rec = o.join(p, "o_orderkey", "left").select(
        k.cast("long").alias("id"), F.struct(F.when(c % 17 != 0, c).cast("long").alias("id")).alias("user"),
        F.struct(F.when(F.col("o_orderpriority").startswith("5"), 6).otherwise(5).cast("long").alias("id"), F.array(F.lit(5).cast("long")).alias("ancestor_ids")).alias("taxon"),
        F.when(F.col("o_orderstatus") == "F", "casual").otherwise("research").alias("quality_grade"), at.alias("created_at"), "photos",
    )
    old = lambda column, rest, name: name.select(F.col(column).cast("long").alias("id")).filter(f"id % {rest} = 0").distinct()
    return landing.classified(rec, 5, "2025-01-01T00:00:00Z", old("o_orderkey", 19, o), old("o_custkey", 23, o), old("l_partkey", 13, li))


@query("""WITH ln AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY substr(sha256('9|' || l_partkey), 1, 16), l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ';' ORDER BY n) AS ids FROM ln WHERE n <= 2 GROUP BY 1""")
def hashed_photos(spark, sf_dir):
    """The photos of a record with the smallest stable keys."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_partkey").alias("id"))).alias("photos"))
    return p.select("l_orderkey", V.text_of_ids(F.transform(landing.hashed_photos(F.col("photos"), 9, 2), lambda x: x["id"])).alias("ids"))


# Images and near duplicates


PIXELS_SQL = "px AS (SELECT p_partkey, i, ((i + 1) * (p_partkey % 97 + 1)) % 251 AS v FROM part, range(72) t(i))"


def images(spark, sf_dir):
    """A grey image of 8 rows of 9 pixels a part."""
    k = F.col("p_partkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((i + 1) * (k % 97 + 1) % 251).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", pixels.alias("pixels"), F.lit(9).alias("width"), F.lit(8).alias("height"))


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT a.p_partkey, 63 - (a.i // 9 * 8 + a.i % 9) AS bit, CASE WHEN b.v > a.v THEN 1 ELSE 0 END AS on_ FROM px a JOIN px b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1 WHERE a.i % 9 < 8)
SELECT p_partkey, (sum(CASE WHEN bit < 63 THEN on_ * (1::HUGEINT << bit::INT) ELSE 0 END) - max(CASE WHEN bit = 63 THEN on_ ELSE 0 END) * 9223372036854775808::HUGEINT)::BIGINT AS hash FROM b GROUP BY 1""")
def image_hashes(spark, sf_dir):
    """Difference hashes of decoded images."""
    return dedup.hash_images(images(spark, sf_dir), "p_partkey")


@query(f"""WITH {PIXELS_SQL}, f AS (SELECT p_partkey, avg(CASE WHEN v / 255.0::DOUBLE <= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dark, avg(CASE WHEN v / 255.0::DOUBLE >= 0.95 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bright FROM px GROUP BY 1),
l AS (SELECT c.p_partkey, (n.v + s.v + w.v + e.v - 4 * c.v) / 255.0::DOUBLE AS v FROM px c JOIN px n ON n.p_partkey = c.p_partkey AND n.i = c.i - 9 JOIN px s ON s.p_partkey = c.p_partkey AND s.i = c.i + 9
  JOIN px w ON w.p_partkey = c.p_partkey AND w.i = c.i - 1 JOIN px e ON e.p_partkey = c.p_partkey AND e.i = c.i + 1 WHERE c.i % 9 BETWEEN 1 AND 7),
v AS (SELECT p_partkey, var_pop(v) AS focus FROM l GROUP BY 1)
SELECT p_partkey, round(focus, 8) AS focus, round(dark, 8) AS dark, round(bright, 8) AS bright FROM f JOIN v USING (p_partkey)""")
def image_proxies(spark, sf_dir):
    """Sharpness and the shares of dark and bright pixels."""
    m = dedup.image_proxies(images(spark, sf_dir), "p_partkey")
    return m.select("p_partkey", r("focus").alias("focus"), r("dark").alias("dark"), r("bright").alias("bright"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN 1 ELSE 2 END AS detections, CASE WHEN p_partkey % 4 > 0 THEN 0.9::DOUBLE END AS score,
 CASE WHEN p_partkey % 4 > 0 THEN round((p_size % 10 + 1) / 100.0::DOUBLE, 8) END AS area, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 > 0 THEN 1.0::DOUBLE END AS background FROM part""")
def detector_proxies(spark, sf_dir):
    """What a detector's boxes say of an image, null where it found nothing."""
    k, wide = F.col("p_partkey") % 4, (F.col("p_size") % 10 + 1).cast("double")
    box = lambda *xs: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])
    other = F.when(k == 3, box(0, 0, 100, 100)).otherwise(box(0, 0, 1, 1))
    gray = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.floor(i / 10).cast("double"))
    b = table(spark, sf_dir, "part").select(
        "p_partkey", F.array(box(0, 0, wide, 100), other).alias("boxes"), F.array(F.when(k == 0, 0.4).otherwise(0.9), F.lit(0.6)).alias("scores"),
        F.array(F.lit(16), F.when(k >= 2, 16).otherwise(3)).alias("labels"), F.lit(100).alias("width"), F.lit(100).alias("height"), gray.alias("gray"), F.lit(10).alias("rows"),
    )
    return dedup.detector_proxies(b, "p_partkey").select("p_partkey", "detections", "score", r("area").alias("area"), "background")


@query(f"""WITH {HASH_SQL}, w AS (SELECT p_partkey AS id, p_partkey % 4 AS place, p_partkey // 4 AS grp, p_size + p_partkey * 1e-6::DOUBLE AS weight FROM part),
c AS (SELECT grp, max(CASE WHEN place = 0 THEN weight END) AS centre, coalesce(sum(CASE WHEN place IN (1, 2) THEN weight END), 0) AS leaves, count(*) FILTER (place IN (1, 2)) AS n FROM w GROUP BY grp HAVING centre IS NOT NULL AND n > 0)
SELECT id, CASE WHEN place = 0 THEN centre <= leaves ELSE centre > leaves END AS chosen FROM w JOIN c USING (grp) WHERE place < 3""")
def vertex_cover(spark, sf_dir):
    """Parts to take out so that no near pair is left, of least weight."""
    h = hashes(spark, sf_dir)
    pairs = dedup.near_pairs(h, h, 4)
    weights = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.col("p_partkey") * F.lit(1e-6)).alias("weight"))
    return dedup.vertex_cover(pairs, dedup.components(h, pairs), weights).select("id", "chosen")


@query("""SELECT p_size AS budget, p_brand AS key, count(*) AS rows, CASE WHEN count(*) = 2 THEN round(abs(max(p_retailprice) - min(p_retailprice)), 6) END AS difference FROM part GROUP BY ALL HAVING count(*) > 1""")
def shared_predictions(spark, sf_dir):
    """How far two predictions for one key differ; other numbers of them are flagged."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("budget"), F.col("p_brand").alias("key"), F.array("p_retailprice").alias("v"))
    return review.shared_differences(p, "key", "v").select("budget", "key", F.col("rows").cast("long").alias("rows"), r("difference", 6).alias("difference"))


# Set models, stored predictions and draws


#: Weights of the models below: twice the identity, and a bias that rises by class.
WEIGHTS = {"weight": 2 * np.eye(CLASSES), "bias": np.arange(CLASSES) / 10}
DEEP = {"phi_weight": np.eye(CLASSES), "phi_bias": np.zeros(CLASSES), "rho_weight": np.eye(CLASSES), "rho_bias": np.zeros(CLASSES)} | WEIGHTS
_pool = lambda f: f"[{', '.join(f'2 * {f}(p[{i + 1}]) + {i / 10}' for i in range(CLASSES))}]"


@query(f"""WITH {LINES_SQL}, z AS (SELECT g, {_pool('avg')} AS a, {_pool('max')} AS m FROM ph GROUP BY g),
one AS (SELECT g, list_transform([2 * p[1], 2 * p[2] + 0.1, 2 * p[3] + 0.2, 2 * p[4] + 0.3, 2 * p[5] + 0.4], lambda x: exp(x)) AS e FROM ph),
pm AS (SELECT g, avg(e[1] / list_sum(e)) AS first, avg(e[5] / list_sum(e)) AS last FROM one GROUP BY g),
s AS (SELECT g, 'mean_feature' AS model, a AS z FROM z UNION ALL SELECT g, 'mean_logit', a FROM z UNION ALL SELECT g, 'deep_sets', a FROM z UNION ALL SELECT g, 'max_feature', m FROM z UNION ALL SELECT g, 'max_logit', m FROM z)
SELECT g, model, round(exp(z[1]) / list_sum(list_transform(z, lambda x: exp(x))), 6) AS first, round(exp(z[5]) / list_sum(list_transform(z, lambda x: exp(x))), 6) AS last FROM s
UNION ALL SELECT g, 'probability_mean', round(first, 6), round(last, 6) FROM pm""")
def set_models(spark, sf_dir):
    """Forward passes of six set models over each group's vectors."""
    g = groups(spark, sf_dir).select("g", F.transform("photos", lambda m: m["p"]).alias("f"))
    out = None
    for name in ("mean_feature", "max_feature", "mean_logit", "max_logit", "probability_mean", "deep_sets"):
        p = aggregators.classify(g, "g", "f", name, DEEP if name == "deep_sets" else WEIGHTS)
        one = p.select("g", F.lit(name).alias("model"), r(F.get("probabilities", F.lit(0)), 6).alias("first"), r(F.element_at("probabilities", -1), 6).alias("last"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""WITH {POOLED_SQL} SELECT g, k AS budget, label, prediction, (SELECT string_agg((g * 100 + b)::VARCHAR, ';' ORDER BY b) FROM range(5) t(b) WHERE (mask >> b) & 1 = 1) AS photo_ids, round(p[1], 6) AS first FROM sc""")
def prediction_exchange(spark, sf_dir):
    """Subset predictions in their exchange form, with the vector read back from it."""
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("g") * 100 + i)
    p = subsets.prediction_frame(scored(spark, sf_dir), "g", ids, F.col("prediction"))
    return p.select("g", "budget", "label", "prediction", "photo_ids", r(F.get(V.vector_of_json(F.col("probabilities_json")), F.lit(0)), 6).alias("first"))


@query("""SELECT c_mktsegment, true AS encloses FROM customer GROUP BY 1""")
def bootstrap_of_a_metric(spark, sf_dir):
    """Any metric under resampling within labels: whether the interval encloses the estimate; seeded."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal")
    i = infer.group_bootstrap(c, "c_nationkey", ["c_mktsegment"], lambda f: float(f["c_acctbal"].mean()), 200, 4)
    m = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    return i.join(m, "c_mktsegment").select("c_mktsegment", F.expr("low < m AND m < high").alias("encloses"))


@query("""WITH l AS (SELECT c_nationkey, avg(c_acctbal) AS x FROM customer GROUP BY 1) SELECT t.size, t.repeat::INT AS repeat, CASE WHEN t.size <= (SELECT count(*) FROM l) THEN (SELECT round(avg(x), 6) FROM l) END AS mean
FROM (SELECT size, repeat FROM (VALUES (25), (1000)) AS s(size), range(3) r(repeat)) t""")
def random_subset_means(spark, sf_dir):
    """Means of labels drawn without replacement: all of them, and more than there are."""
    l = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    return infer.random_subsets(l, "x", [25, 1000], 3, 8).withColumn("mean", r("mean", 6))


# Quality of members against outcomes


@query(f"""WITH {POOLED_SQL}, f AS (SELECT g, avg(price) AS price, avg(qty) AS qty, CASE WHEN g % 5 = 0 THEN NULL ELSE avg(p[1]) END AS share FROM ph GROUP BY g), e AS (SELECT g, label, avg(correct) AS a FROM sc WHERE k = 2 GROUP BY ALL),
u AS (SELECT g, label, a, 'price' AS covariate, price AS x FROM e JOIN f USING (g) UNION ALL SELECT g, label, a, 'qty', qty FROM e JOIN f USING (g) UNION ALL SELECT g, label, a, 'share', share FROM e JOIN f USING (g)),
c AS (SELECT covariate, x - avg(x) OVER w AS u, a - avg(a) OVER w AS v FROM u WHERE x IS NOT NULL WINDOW w AS (PARTITION BY covariate, label)), k AS (SELECT covariate, corr(u, v) AS r FROM c GROUP BY 1)
SELECT covariate, count(*) FILTER (x IS NOT NULL) AS available, count(*) FILTER (x IS NULL) AS missing, round(any_value(k.r), 6) AS r FROM u JOIN k USING (covariate) GROUP BY covariate""")
def quality_correlations(spark, sf_dir):
    """Each covariate of a group against its outcome, label means taken off, with what is missing."""
    q = strata.covariate_report(covariates(spark, sf_dir), ["price", "qty", "share"], "correct", "label")
    return q.select("covariate", "available", "missing", r("r", 6).alias("r"))


@query(f"""WITH {POOLED_SQL}, f AS (SELECT g, avg(price) AS price, avg(qty) AS qty FROM ph GROUP BY g), e AS (SELECT g, label, avg(correct) AS a FROM sc WHERE k = 2 GROUP BY ALL),
u AS (SELECT label, a, 'price' AS covariate, price AS x FROM e JOIN f USING (g) UNION ALL SELECT label, a, 'qty', qty FROM e JOIN f USING (g)),
q AS (SELECT covariate, list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 1.0)]) AS edges FROM u GROUP BY 1),
b AS (SELECT covariate, greatest(1, len(list_filter(edges, lambda z: z < x)))::INT AS bin, label, avg(a) AS m, count(*) AS n FROM u JOIN q USING (covariate) GROUP BY ALL)
SELECT covariate, bin, sum(n)::BIGINT AS rows, count(*) AS labels, round(avg(m), 6) AS macro FROM b GROUP BY ALL""")
def quality_strata(spark, sf_dir):
    """The outcome by quantile bins of each covariate."""
    q = strata.covariate_strata(covariates(spark, sf_dir), ["price", "qty"], "correct", "label")
    return q.select("covariate", "bin", "rows", "labels", r("macro", 6).alias("macro"))


def covariates(spark, sf_dir):
    p = photos(spark, sf_dir).groupBy("g").agg(F.avg("price").alias("price"), F.avg("qty").alias("qty"), F.avg(F.get("p", F.lit(0))).alias("share"))
    e = scored(spark, sf_dir).filter("k = 2").groupBy("g", "label").agg(F.avg("correct").alias("correct"))
    return e.join(p, "g").withColumn("share", F.when(F.col("g") % 5 != 0, F.col("share")))

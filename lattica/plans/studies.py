"""Queries on manifests, class tables, stored predictions, reviews and landed records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions.scalars import stable_hex
from lattica.operators import infer, manifest, review, select, subsets
from lattica.operators.gates import violations
from lattica.operators.numbering import numbered
from lattica.plans.binding import LINES_SQL, POOLED_SQL, groups, table
from lattica.plans.lattice import r, scored
from lattica.sources import landing

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT p_brand AS taxon_id, 0 AS origin, min(p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1), n AS (SELECT p_brand, 1, min(p_partkey) FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT taxon_id FROM c) GROUP BY 1),
u AS (SELECT * FROM c UNION ALL SELECT * FROM n) SELECT taxon_id, origin, row_number() OVER (ORDER BY origin, k, taxon_id) - 1 AS class_index FROM u""")
def class_table(spark, sf_dir):
    """Current classes before new ones, numbered."""
    p = table(spark, sf_dir, "part")
    by = lambda rows: rows.groupBy(F.col("p_brand").alias("taxon_id")).agg(F.min("p_partkey").alias("k"))
    old = by(p.filter("p_size <= 25"))
    new = by(p.filter("p_size > 25")).join(old, "taxon_id", "left_anti")
    return manifest.class_table(old, new, "k").select("taxon_id", "origin", "class_index")


@query("""SELECT p_name, p_type, count(*) AS parts FROM part JOIN (SELECT p_type, count(DISTINCT p_brand) >= 20 AS strict FROM part GROUP BY 1) USING (p_type) WHERE strict GROUP BY ALL""")
def strict_support(spark, sf_dir):
    p = manifest.strict_support(table(spark, sf_dir, "part"), "p_type", "p_brand", 20)
    return p.filter("strict").groupBy("p_name", "p_type").agg(F.count("*").alias("parts"))


@query("""WITH t AS (SELECT p_name AS taxon, count(DISTINCT p_type) AS classes FROM part GROUP BY 1) SELECT taxon, classes FROM t WHERE classes <> 1""")
def canonical_taxon_faults(spark, sf_dir):
    """Taxa that have several classes."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("taxon"), F.col("p_name").alias("name"), F.col("p_type").alias("class"))
    bad = manifest.canonical_taxa(p, "taxon", "name", "class")[1].filter("gate = 'canonical_taxon'").select(F.col("key").alias("taxon"))
    return bad.join(p.groupBy("taxon").agg(F.count_distinct("class").alias("classes")), "taxon")


@query(f"""WITH {LINES_SQL}, f AS (SELECT g, observer, count(*) AS size, avg(price) AS area FROM ph GROUP BY ALL), o AS (SELECT observer, count(*) AS observer_groups FROM f GROUP BY 1)
SELECT g, size, round(area, 4) AS area, observer_groups, CASE WHEN area < 20000 THEN 1 WHEN area < 60000 THEN 2 ELSE 3 END AS area_bin FROM f JOIN o USING (observer)""")
def group_facts(spark, sf_dir):
    from lattica.plans.binding import photos

    f = manifest.group_facts(photos(spark, sf_dir), "g", "observer", F.col("price"), [0, 20_000, 60_000])
    return f.select("g", "size", r("area", 4).alias("area"), "observer_groups", "area_bin")


@query("""SELECT o_custkey AS observer, list_sort(list(o_orderkey)) AS members FROM orders GROUP BY 1""")
def member_map(spark, sf_dir):
    return manifest.member_map(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "observer")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey AS k FROM part), b AS (SELECT place, k + CASE WHEN k % 9 = 4 THEN 1 ELSE 0 END AS k FROM a)
SELECT place, b.k AS done, a.k AS plan FROM b LEFT JOIN a USING (place) WHERE b.k IS DISTINCT FROM a.k""")
def prefix_faults(spark, sf_dir):
    """Places at which a resumed list leaves its plan."""
    p = numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "place").select("place", F.col("p_partkey").alias("k"))
    done = p.withColumn("k", F.when(F.col("k") % 9 == 4, F.col("k") + 1).otherwise(F.col("k")))
    return manifest.prefix_faults(done, p, "place", "k")


@query(f"""WITH {POOLED_SQL}, s AS (SELECT g, mask, (SELECT string_agg((g * 100 + b)::VARCHAR, ';' ORDER BY b) FROM range(5) t(b) WHERE (mask >> b) & 1 = 1) AS photo_ids FROM sc WHERE k = 2)
SELECT g, min_by(photo_ids, substr(sha256('0|' || g || '|2|' || replace(photo_ids, ';', '|')), 1, 16)) IS NOT NULL AS drawn, min(photo_ids) AS first FROM s GROUP BY g""")
def subset_samples(spark, sf_dir):
    """One subset of two a group: the first, and one drawn by key."""
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("g") * 100 + i)
    g = groups(spark, sf_dir).select("g", ids.alias("ids"))
    first, drawn = subsets.samples(g, "g", 2, "first"), subsets.samples(g, "g", 2, "random", epoch=3)
    return first.withColumnRenamed("photo_ids", "first").join(drawn.select("g", F.col("photo_ids").isNotNull().alias("drawn")), "g")


@query(f"""WITH {POOLED_SQL}, s AS (SELECT * FROM sc WHERE k = 1)
SELECT 'foreign_member' AS fault, count(*) FILTER (g % 11 = 0) AS records FROM s UNION ALL SELECT 'wrong_label', count(*) FILTER (g % 11 = 1) FROM s UNION ALL
SELECT 'wrong_size', count(*) FILTER (g % 11 = 2) FROM s UNION ALL SELECT 'unknown_group', count(*) FILTER (g % 11 = 3) FROM s""")
def stored_record_faults(spark, sf_dir):
    """Stored predictions of which some name a foreign member, a wrong label, size or group."""
    rows = scored(spark, sf_dir).filter("k = 1")
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("g") * 100 + i)
    records = subsets.prediction_frame(rows, "g", ids, F.col("prediction")).withColumn("kind", F.col("g") % 11)
    broken = records.withColumns({
        "photo_ids": F.when(F.col("kind") == 0, F.lit("-5")).otherwise(F.col("photo_ids")), "label": F.when(F.col("kind") == 1, F.col("label") + 1).otherwise(F.col("label")),
        "budget": F.when(F.col("kind") == 2, 2).otherwise(F.col("budget")), "g": F.when(F.col("kind") == 3, -F.col("g") - 1).otherwise(F.col("g")),
    })
    known = groups(spark, sf_dir).select("g", ids.alias("ids"), "label")
    bad = subsets.record_faults(broken, known, "g", 5).filter("NOT (fault = 'foreign_member' AND g < 0)")
    return bad.groupBy("fault").agg(F.count("*").alias("records"))


@query("""WITH p AS (SELECT conv_id, least(turn, 1) AS a, greatest(turn, 1) AS b FROM conversations WHERE role = 'user' AND turn > 1)
SELECT count(*) FILTER (conv_id % 3 = 0) AS missing, count(*) FILTER (conv_id % 3 = 1) AS stale, count(*) FILTER (conv_id % 3 = 2 AND conv_id % 5 = 0) AS quarantined,
       count(*) FILTER (conv_id % 3 <= 1 OR conv_id % 5 = 0) = 0 AS passes FROM (SELECT DISTINCT conv_id FROM p)""")
def review_status(spark, sf_dir):
    """Reviewed against current pairs."""
    ids = table(spark, sf_dir, "conversations").filter("role = 'user' AND turn > 1").select("conv_id").distinct()
    pairs = ids.select((F.col("conv_id") + 10**6).alias("a"), F.col("conv_id").alias("b"))
    done = pairs.filter("b % 3 <> 0").withColumn("decision", F.when((F.col("b") % 3 == 2) & (F.col("b") % 5 == 0), "quarantine").otherwise("distinct"))
    return review.status(done.select(F.col("b").alias("a"), F.col("a").alias("b"), "decision"), pairs.filter("b % 3 <> 1"))


@query("""SELECT event_type AS taxon, count(*) AS records, count(DISTINCT user_id) AS observers, greatest(0, 2000 - count(DISTINCT user_id)) AS shortfall FROM events GROUP BY 1""")
def census_shortfall(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("taxon"), "user_id")
    return landing.census(e, "taxon", "user_id", 2000)


@query("""WITH n AS (SELECT lower(p_name) AS k, count(DISTINCT p_partkey) AS c, min(p_partkey) AS id FROM part WHERE p_size > 45 GROUP BY 1) SELECT DISTINCT p_name AS name, CASE WHEN c = 1 THEN id END AS id FROM part LEFT JOIN n ON k = lower(p_name)""")
def exact_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") > 45).alias("is_active"))
    return landing.exact_names(p.select(F.col("p_name").alias("name")).distinct(), found)


@query("""SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1 ORDER BY 2 LIMIT 50""")
def first_seen(spark, sf_dir):
    """The first order of a customer, and of those the first fifty: a report of a stated size."""
    return landing.first_seen(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("first")), "o_custkey", "first", 50)


@query("""SELECT 'unmapped' AS gate, c_custkey::VARCHAR AS key, c_mktsegment AS detail FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def unmapped_classes(spark, sf_dir):
    """Rows whose class is not in the table."""
    c = table(spark, sf_dir, "customer")
    known = c.filter("c_mktsegment <> 'MACHINERY'").select("c_mktsegment").distinct()
    return violations(c.join(known, "c_mktsegment", "left_anti"), "unmapped", F.col("c_custkey"), F.col("c_mktsegment"))


@query("""SELECT substr(sha256('42|' || vec_id), 1, 16) AS h, vec_id FROM embeddings ORDER BY 1, 2 LIMIT 25""")
def hash_ordered_sample(spark, sf_dir):
    """Twenty-five vectors in an order that a seed gives: a sampling operator."""
    return table(spark, sf_dir, "embeddings").select(stable_hex(F.lit(42), F.col("vec_id")).alias("h"), "vec_id").orderBy("h", "vec_id").limit(25)


MEANS = ("correct", "top3", "nll", "brier")


@query(f"""WITH {POOLED_SQL}, c AS (SELECT g, label, k, {", ".join(f"avg({m}) AS {m}" for m in MEANS)}, {", ".join(f"avg(CASE WHEN bin = {i} THEN correct - confidence ELSE 0.0::DOUBLE END) AS b{i}" for i in range(15))} FROM sc GROUP BY ALL),
l AS (SELECT k, avg(a) AS a FROM (SELECT k, label, avg(correct) AS a FROM c GROUP BY ALL) GROUP BY k),
m AS (SELECT k, {", ".join(f"avg({m}) AS {m}" for m in MEANS)}, {" + ".join(f"abs(avg(b{i}))" for i in range(15))} AS ece FROM c GROUP BY k)
SELECT k, 'macro_correct' AS metric, round(a, 8) AS estimate, 'OK' AS status FROM l {" ".join(f"UNION ALL SELECT k, '{x}', round({x}, 8), 'OK' FROM m" for x in (*MEANS, "ece"))}""")
def metric_points(spark, sf_dir):
    """What of the intervals below does not depend on the draws: estimates and status."""
    return metric_intervals(spark, sf_dir).select("k", "metric", r("estimate").alias("estimate"), "status")


@query()
def metric_intervals(spark, sf_dir):
    """Intervals of accuracy, top-3, likelihood, Brier score and calibration error by size; seeded."""
    means = list(MEANS)
    bins = [f"b{i}" for i in range(15)]
    parts = [F.avg(m).alias(m) for m in means] + [F.avg(F.when(F.col("bin") == i, F.col("correct") - F.col("confidence")).otherwise(F.lit(0.0))).alias(f"b{i}") for i in range(15)]
    c = scored(spark, sf_dir).groupBy("g", "label", "observer", "k").agg(*parts)
    return infer.metric_intervals(c, ["k"], "observer", "label", means, bins, 500, 3)


@query("""SELECT s.taxon, true AS within, 14 AS total, true AS one_a_nation FROM (SELECT dense_rank() OVER (ORDER BY c_mktsegment) AS taxon FROM customer) s GROUP BY s.taxon""")
def selection_bounds(spark, sf_dir):
    """Whether the selection below keeps its bounds a segment, its total and its capacity a nation."""
    chosen = flow_selection(spark, sf_dir)
    total = chosen.agg(F.count("*").cast("int").alias("total"), (F.count_distinct("observer") == F.count("*")).alias("one_a_nation"))
    return chosen.groupBy("taxon").agg(F.count("*").between(2, 4).alias("within")).crossJoin(total)  # one row


@query()
def flow_selection(spark, sf_dir):
    """Groups of customers chosen under bounds a segment and one a nation, at least cost."""
    c = table(spark, sf_dir, "customer").select(F.dense_rank().over(Window.orderBy("c_mktsegment")).cast("long").alias("taxon"), F.col("c_nationkey").cast("long").alias("observer"), F.col("c_custkey").alias("observation"))
    n = {t: 4 for t in range(1, 6)}
    return select.bounded_selection(c, {t: 2 for t in n}, n, 14, 1, 3)


@query("""WITH o AS (SELECT o_custkey AS observer, substr(o_orderpriority, 1, 1)::BIGINT AS taxon FROM orders) SELECT taxon, count(*) AS groups, count(DISTINCT observer) AS observers, 3::BIGINT AS splits, true AS near FROM o GROUP BY taxon""")
def split_coverage(spark, sf_dir):
    """Whether the split below places every customer once, puts every priority into each split and comes near the wanted shares (within three in a hundred)."""
    o = orders_by_priority(spark, sf_dir)
    both = o.join(disjoint_split(spark, sf_dir), "observer")
    share = lambda s: F.count_if(F.col("split") == s) / F.count("*")
    near = (F.abs(share("train") - 0.6) < 0.03) & (F.abs(share("validation") - 0.2) < 0.03) & (F.abs(share("test") - 0.2) < 0.03)
    return both.groupBy("taxon").agg(F.count("*").alias("groups"), F.count_distinct("observer").alias("observers"), F.count_distinct("split").alias("splits"), near.alias("near"))


def orders_by_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("observer"), F.substring("o_orderpriority", 1, 1).cast("long").alias("taxon"))


@query()
def disjoint_split(spark, sf_dir):
    """Customers dealt whole to three splits of orders by priority."""
    return select.observer_split(orders_by_priority(spark, sf_dir), {"train": 0.6, "validation": 0.2, "test": 0.2}, 5)

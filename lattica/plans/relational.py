"""Queries on the star schema itself: gates, joins, windows, ranks, sets, scalars, regrouping, near duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import scalars as V
from lattica.functions import urls
from lattica.operators import dedup, gates, infer, joins, regroup, select, strata
from lattica.operators.numbering import numbered
from lattica.plans.binding import LINES_SQL, POOLED_SQL, photos, table
from lattica.plans.lattice import paired, r
from lattica.streaming import fold

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Gates


@query("""WITH b AS (SELECT 'constant_in_group' AS gate, l_orderkey::VARCHAR AS key, 'l_linestatus' AS detail FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1),
u AS (SELECT 'unique_l_orderkey_l_linenumber' AS gate, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
s AS (SELECT 'size_between' AS gate, l_orderkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) NOT BETWEEN 2 AND 5)
SELECT * FROM b UNION ALL SELECT * FROM u UNION ALL SELECT * FROM s""")
def schema_violations(spark, sf_dir):
    """Everything that is wrong with lines as a member manifest."""
    li = table(spark, sf_dir, "lineitem")
    return gates.report([gates.constant_in_group(li, "l_orderkey", ["l_linestatus"]), gates.unique(li, ["l_orderkey", "l_linenumber"]), gates.size_between(li, "l_orderkey", 2, 5)])


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_quantity IS NULL OR NOT l_quantity > 0) = 0 AS quantity,
(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0 AS unique_orders,
(SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')) = 0 AS priority,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS known_order,
CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity IS NULL OR NOT l_quantity > 0) > 0 THEN 'STOP_QUANTITY' ELSE 'PASS' END AS verdict""")
def audit_gates(spark, sf_dir):
    """Named gates and a verdict in one row."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return gates.decision({
        "quantity": gates.failing(li, "quantity", "l_orderkey", ~(F.col("l_quantity") > 0)), "unique_orders": gates.unique(o, ["o_orderkey"]),
        "priority": gates.matches(o, "o_orderkey", "o_orderpriority", "^[1-5]-"), "known_order": gates.violations(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "known_order", F.col("l_orderkey"), F.lit("no order")),
    })


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'no_size' WHEN p_brand = 'Brand#7' THEN 'excluded_brand' WHEN p_size > 45 THEN 'too_large' WHEN p_name LIKE 'red%' THEN 'wrong_colour' END AS reason
FROM part WHERE CASE WHEN p_size IS NULL THEN 'no_size' WHEN p_brand = 'Brand#7' THEN 'excluded_brand' WHEN p_size > 45 THEN 'too_large' WHEN p_name LIKE 'red%' THEN 'wrong_colour' END IS NOT NULL""")
def first_failure_reason(spark, sf_dir):
    """The first of several ordered reasons."""
    reason = gates.first_reason([("no_size", F.col("p_size").isNull()), ("excluded_brand", F.col("p_brand") == "Brand#7"), ("too_large", F.col("p_size") > 45), ("wrong_colour", F.col("p_name").startswith("red"))])
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason")).filter("reason IS NOT NULL")


@query("""SELECT event_type, CASE WHEN ts > TIMESTAMP '2024-01-28' THEN 'after_cutoff' WHEN value < 5 THEN 'too_small' WHEN user_id % 10 = 3 THEN 'historical' ELSE 'accepted' END AS reason, count(*) AS events FROM events GROUP BY ALL""")
def attrition(spark, sf_dir):
    """Counts by reason."""
    reason = gates.first_reason([("after_cutoff", F.col("ts") > F.lit("2024-01-28").cast("timestamp")), ("too_small", F.col("value") < 5), ("historical", F.col("user_id") % 10 == 3)])
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("events"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 2 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 10 <> 3)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def frame_difference(spark, sf_dir):
    """Rows in which two frames differ, with the side."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    b = o.filter("o_orderkey % 10 <> 3").withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 2, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return gates.same_rows(o.filter("o_orderkey % 10 <> 1"), b)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'same_set' AS gate, k::VARCHAR AS key, 'left only' AS detail FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'same_set', k::VARCHAR, 'right only' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_difference_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return gates.same_set(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "k")


@query("""WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT 'within_v' AS gate, f AS key, (v::VARCHAR IS NOT NULL)::VARCHAR AS detail FROM m WHERE f = 'R'""")
def metric_tolerance_gate(spark, sf_dir):
    """A stored metric that is off by more than the tolerance."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.avg("l_quantity").alias("v"))
    stored = m.withColumn("v", F.when(F.col("f") == "R", F.col("v") + 1e-6).otherwise(F.col("v") + 1e-12))
    return gates.within(m, stored, ["f"], "v").withColumn("detail", F.col("detail").isNotNull().cast("string"))


@query("""SELECT count(*) AS members, count(DISTINCT l_orderkey) AS groups, count(DISTINCT o_custkey) AS observers, count(DISTINCT o_orderpriority) AS labels FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def cohort_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(o, "l_orderkey").agg(F.count("*").alias("members"), F.count_distinct("l_orderkey").alias("groups"), F.count_distinct("o_custkey").alias("observers"), F.count_distinct("o_orderpriority").alias("labels"))


# Joins and sets


@query("""SELECT gate, count(*) AS violations FROM (SELECT 'unmatched' AS gate FROM lineitem WHERE l_orderkey % 50 = 0 UNION ALL
SELECT 'disagree_o_orderstatus' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 50 <> 0 AND l_linestatus <> o_orderstatus) GROUP BY gate""")
def split_join_violations(spark, sf_dir):
    """A many-to-one join that checks coverage and agreement."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 0").select("o_orderkey", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    return joins.many_to_one(li, o, ["o_orderkey"], ["o_orderstatus"])[1].groupBy("gate").agg(F.count("*").alias("violations"))


@query("""SELECT n_name, round(avg(c_acctbal), 6) AS balance, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name""")
def dimension_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(r(F.avg("c_acctbal"), 6).alias("balance"), F.count("*").alias("customers"))


@query("""SELECT c_custkey, CASE WHEN (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey + 1 FROM nation)) > 0 THEN 'r' || c_nationkey % 5 ELSE 'x' END AS name FROM customer""")
def fallback_join(spark, sf_dir):
    """A second key pair for all rows once the first, whose numbers start at one, leaves one unmatched."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("key"), (F.col("n_nationkey") % 5).alias("k5"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_nationkey") % 5).alias("c5"))
    return joins.with_fallback(c, n, ("c_nationkey", "key"), ("c5", "k5"), "name").select("c_custkey", "name")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def history_anti_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.without_history(table(spark, sf_dir, "orders"), [c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_acctbal < 0")], "o_custkey").select("o_orderkey")


@query("""WITH d AS (SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT h, n AS copies, first_id FROM d WHERE n > 1""")
def exact_overlap(spark, sf_dir):
    """Digests that several documents share."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("""SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)""")
def common_cohort(spark, sf_dir):
    """Ids that every budget has."""
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.count_distinct("c_mktsegment").alias("n"))
    return c.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("k")).crossJoin(F.broadcast(n)).filter("k = n").select("c_nationkey")


@query("""SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey""")
def pair_canonical(spark, sf_dir):
    a, b = V.canonical_pair(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").select(a.alias("a"), b.alias("b")).distinct()


@query("""SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS agreement,
round((avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 8) AS kappa FROM labels""")
def kappa(spark, sf_dir):
    """Agreement of two raters beyond chance."""
    return joins.agreement(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic")).select("n", r("agreement").alias("agreement"), r("kappa").alias("kappa"))


@query("""WITH a AS (SELECT l_linenumber::DOUBLE AS x, least(5, 1 + floor(l_quantity / 10))::DOUBLE AS y FROM lineitem WHERE l_linenumber <= 5)
SELECT count(*) AS n, round(1 - avg((x - y) ^ 2) / (avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y)), 8) AS kappa FROM a""")
def quadratic_kappa(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").select(F.col("l_linenumber").alias("x"), F.least(F.lit(5), 1 + F.floor(F.col("l_quantity") / 10)).alias("y"))
    return joins.weighted_kappa(a, "x", "y", 1, 5).select("n", r("kappa").alias("kappa"))


# Projections, aggregates, pivots


@query("""SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS class_index, o_orderkey, o_orderpriority FROM orders""")
def canonical_manifest(spark, sf_dir):
    """A dense class index and a global row number. The class index comes from a join with the few classes; the row number from counts of ranges, not from one task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    classes = o.select("o_orderpriority").distinct().withColumn("class_index", F.dense_rank().over(Window.orderBy("o_orderpriority")) - 1)
    return numbered(o.join(F.broadcast(classes), "o_orderpriority"), ["o_orderpriority", "o_orderkey"]).select("row_id", "class_index", "o_orderkey", "o_orderpriority")


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_orderpriority, sum(n) AS t FROM a GROUP BY 1)
SELECT o_orderpriority, round(max(n / t), 10) AS largest_share, round(sum((n / t) ^ 2), 10) AS concentration FROM a JOIN t USING (o_orderpriority) GROUP BY 1""")
def observer_concentration(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    t = a.groupBy("o_orderpriority").agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return a.join(F.broadcast(t), "o_orderpriority").groupBy("o_orderpriority").agg(r(F.max(share), 10).alias("largest_share"), r(F.sum(share * share), 10).alias("concentration"))


@query("""WITH c AS (SELECT n_nationkey, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1)
SELECT n_nationkey, customers, customers >= 60 AS enough FROM c""")
def support_counts(spark, sf_dir):
    """Counts over the full list of classes, zero where there is none."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("n"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("customers"), (F.coalesce("n", F.lit(0)) >= 60).alias("enough"))


@query("""SELECT o_orderpriority, count(DISTINCT CASE WHEN o_custkey % 10 < 6 THEN o_custkey END) AS train, count(DISTINCT CASE WHEN o_custkey % 10 IN (6, 7) THEN o_custkey END) AS validation, count(DISTINCT CASE WHEN o_custkey % 10 > 7 THEN o_custkey END) AS test FROM orders GROUP BY 1""")
def split_pivot(spark, sf_dir):
    split = F.when(F.col("o_custkey") % 10 < 6, "train").when(F.col("o_custkey") % 10 < 8, "validation").otherwise("test")
    o = table(spark, sf_dir, "orders").withColumn("split", split)
    return o.groupBy("o_orderpriority").pivot("split", ["train", "validation", "test"]).agg(F.count_distinct("o_custkey")).na.fill(0)


@query("""SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1""")
def split_leakage(spark, sf_dir):
    """Observers whose groups lie in several splits."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(F.col("o_orderkey") % 3).alias("splits")).filter("splits > 1")


@query("""SELECT n AS size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n""")
def histogram_of_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query("""SELECT 'c_acctbal' AS metric, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer UNION ALL
SELECT 'c_nationkey', round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6), min(c_nationkey), max(c_nationkey) FROM customer""")
def unpivoted_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    u = c.unpivot([], ["c_acctbal", "c_nationkey"], "metric", "v")
    return u.groupBy("metric").agg(r(F.avg("v"), 6).alias("mean"), r(F.stddev_samp("v"), 6).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("""SELECT taxon, least(58, g)::INT AS lower, least(64, g)::INT AS upper, greatest(58 - g, 0) AS shortfall FROM (SELECT c_nationkey AS taxon, count(*) AS g FROM customer GROUP BY 1)""")
def selection_targets(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("taxon")).agg(F.count("*").alias("groups"))
    return select.targets(g, None, 58, 64).join(g, "taxon").select("taxon", "lower", "upper", F.greatest(58 - F.col("groups"), F.lit(0)).alias("shortfall"))


@query("""SELECT o_orderpriority, o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL""")
def contingency(spark, sf_dir):
    """Labels by observers, sparse: a dense matrix would grow with both."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count_distinct("o_orderkey").alias("n"))


@query("""WITH a AS (SELECT p_brand, p_type, avg(p_size) AS p FROM part GROUP BY ALL), b AS (SELECT p_brand, p_type, avg(p_size) AS q FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL)
SELECT p_brand, p_type, round(p - q, 8) AS difference, (p < 25) <> (q < 25) AS flips FROM a JOIN b USING (p_brand, p_type)""")
def exclusion_flips(spark, sf_dir):
    """Cells whose verdict an exclusion turns; one scan for both branches."""
    kept = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    a = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("p"), F.avg(kept).alias("q")).filter("q IS NOT NULL")
    return a.select("p_brand", "p_type", r(F.col("p") - F.col("q")).alias("difference"), ((F.col("p") < 25) != (F.col("q") < 25)).alias("flips"))


@query("""SELECT o_custkey, o_orderkey FROM orders JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 10 AND 12) USING (o_custkey)""")
def group_predicate(spark, sf_dir):
    """Rows of groups that meet a predicate on the whole group."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return o.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).filter("n BETWEEN 10 AND 12").drop("n")


@query("""SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) = 5)""")
def exact_group_sizes(spark, sf_dir):
    """Members of classes that have exactly five."""
    n = table(spark, sf_dir, "nation").withColumn("size", F.count("*").over(Window.partitionBy("n_regionkey"))).filter("size = 5")
    return n.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("""SELECT h, count(*) AS documents, min(doc_id) AS kept FROM (SELECT sha256(lower(text)) AS h, doc_id FROM documents) GROUP BY h HAVING count(*) > 1 AND min(doc_id) IN (SELECT doc_id FROM labels)""")
def labelled_copies(spark, sf_dir):
    """Groups of copies, case aside, whose first document is labelled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    g = d.groupBy("h").agg(F.count("*").alias("documents"), F.min("doc_id").alias("kept")).filter("documents > 1")
    return g.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("kept")), "kept", "left_semi").select("h", "documents", "kept")


# Strata, bins, correction


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, n, label, observer, k, avg(correct) AS a, avg(nll) AS l FROM sc GROUP BY ALL),
u AS (SELECT 'label' AS stratum, label::VARCHAR AS value, k, a, l FROM e UNION ALL SELECT 'n', n::VARCHAR, k, a, l FROM e UNION ALL SELECT 'busy', (observer % 2)::VARCHAR, k, a, l FROM e)
SELECT stratum, value, k, round(avg(a) + 1e-11::DOUBLE, 8) AS accuracy, round(avg(l), 8) AS nll, count(*) AS groups FROM u GROUP BY ALL""")
def strata_summary(spark, sf_dir):
    """Several strata in one pass. (Shares of powers of two lie between two eighth digits; the small term decides for the upper.)"""
    from lattica.operators.macro import expected
    from lattica.plans.lattice import scored

    e = expected(scored(spark, sf_dir), ["g", "n", "label", "observer"], ["correct", "nll"]).withColumn("busy", F.col("observer") % 2)
    return strata.stratified(e, ["label", "n", "busy"], ["k"], [r(F.avg("correct") + F.lit(1e-11)).alias("accuracy"), r(F.avg("nll")).alias("nll"), F.count("*").alias("groups")])


@query("""SELECT CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END + 1 AS bin, count(*) AS orders FROM orders GROUP BY 1""")
def fixed_bins(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(strata.edge_bin(F.col("o_totalprice"), [0, 100_000, 300_000]).alias("bin")).agg(F.count("*").alias("orders"))


@query("""WITH e AS (SELECT list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), quantile_cont(l_quantity, 1.0)]) AS edges FROM lineitem)
SELECT greatest(1, len(list_filter(edges, lambda x: x < l_quantity)))::INT AS bin, count(*) AS lines, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem, e GROUP BY 1""")
def quartile_strata(spark, sf_dir):
    li = strata.quantile_bin(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", 4)
    return li.groupBy("bin").agg(F.count("*").alias("lines"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query(f"""WITH {LINES_SQL}, e AS (SELECT quantile_cont(price, 1/3.0::DOUBLE) AS a, quantile_cont(price, 2/3.0::DOUBLE) AS b FROM ph WHERE g % 2 = 0),
b AS (SELECT g, n, label, (CASE WHEN price >= a THEN 1 ELSE 0 END + CASE WHEN price >= b THEN 1 ELSE 0 END) AS bin FROM ph, e),
s AS (SELECT g, any_value(n) AS n, any_value(label) AS label, string_agg(bin::VARCHAR, ';' ORDER BY bin) AS signature FROM b GROUP BY g)
SELECT signature, label, count(*) AS groups, CASE WHEN count(*) < 3 THEN 'fewer than 3' ELSE 'kept' END AS reason FROM s GROUP BY signature, label""")
def tercile_signature(spark, sf_dir):
    """Bins fitted on one half, groups by their sorted bins, and which strata have enough groups."""
    b = strata.fitted_bin(photos(spark, sf_dir), "price", F.col("g") % 2 == 0, [1 / 3, 2 / 3])
    s = regroup.signature(b, "g", "bin").join(b.select("g", "label").distinct(), "g")
    kept, lost = strata.support(s, ["signature", "label"], 3)
    return kept.groupBy("signature", "label").agg(F.count("*").alias("groups")).withColumn("reason", F.lit("kept")).unionByName(lost.withColumnRenamed("size", "groups"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, value, avg(correct) AS a FROM sc JOIN obs USING (g, label) WHERE k = 1 GROUP BY ALL),
d AS (SELECT value - avg(value) OVER (PARTITION BY label) AS u, a - avg(a) OVER (PARTITION BY label) AS v FROM e)
SELECT round(corr(u, v), 8) AS r, count(*) AS n FROM d""")
def within_label_corr(spark, sf_dir):
    from lattica.plans.binding import groups
    from lattica.plans.lattice import scored

    e = scored(spark, sf_dir).filter("k = 1").groupBy("g", "label").agg(F.avg("correct").alias("a"))
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.col("o_totalprice").alias("value"))
    return strata.within_correlation(e.join(v, "g"), "value", "a", "label").select(r("r").alias("r"), "n")


@query("""WITH p AS (SELECT p_brand AS family, p_partkey, least(1.0::DOUBLE, p_retailprice / 100000) AS p FROM part),
s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, p_partkey) + 1) * p AS step FROM p)
SELECT family, p_partkey, round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY family ORDER BY p, p_partkey)), 10) AS adjusted FROM s""")
def holm_families(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), "p_partkey", F.least(F.lit(1.0), F.col("p_retailprice") / 100000).alias("p"))
    return strata.holm(p, "p", ["family"], ["p_partkey"]).select("family", "p_partkey", r("adjusted", 10).alias("adjusted"))


# Ranks and selection


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(sha256('5|observer|' || o_custkey || '|' || o_orderkey), 1, 16), o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM a WHERE n = 1 ORDER BY substr(sha256('5|order|' || o_orderkey), 1, 16), o_orderkey LIMIT 100""")
def top1_per_observer_cap(spark, sf_dir):
    return select.compact_candidates(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5, 100)


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3""")
def per_group_topk(spark, sf_dir):
    return select.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey")


@query("""WITH cur AS (SELECT * FROM part WHERE p_partkey < 5), x AS (SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM cur) THEN 0 WHEN p_type IN (SELECT p_type FROM cur) THEN 1 ELSE 2 END AS priority FROM part WHERE p_name NOT IN (SELECT p_name FROM cur))
SELECT p_partkey, priority, row_number() OVER (ORDER BY priority, p_partkey) - 1 AS place FROM x""")
def priority_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return select.priority_rank(p, p.filter("p_partkey < 5"), "p_name", "p_brand", "p_type", "p_partkey").select("p_partkey", "priority", "place")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations""")
def ordered_replicates(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("place"))


# Scalars


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages""")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.without_query(F.col("url")).alias("bare"), urls.host(F.col("url")).alias("host"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, (CAST(json_extract(props, '$.k') AS INT) || '.0') AS text_k, CAST(json_extract(props, '$.k') AS BIGINT) AS whole FROM events""")
def json_and_identity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    text = F.concat(F.col("k").cast("string"), F.lit(".0"))
    return e.select("event_id", "k", text.alias("text_k"), V.whole_number(text).alias("whole"))


@query("""SELECT c_custkey, substr(sha256('7|' || c_custkey || '|' || c_mktsegment), 1, 16) AS hex FROM customer""")
def stable_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", V.stable_hex(F.lit(7), F.col("c_custkey"), F.col("c_mktsegment")).alias("hex"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, list_transform(e, lambda a: exp(a - list_max(e))) AS x FROM v)
SELECT vec_id, round(x[1] / list_sum(x), 8) AS first, round(x[-1] / list_sum(x), 8) AS last FROM x""")
def softmax_vectors(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.softmax(e).alias("p")).select("vec_id", r(F.get("p", F.lit(0))).alias("first"), r(F.element_at("p", -1)).alias("last"))


# Near duplicates and components

#: Bits in which the members of a group of four parts differ from its hash: 0, 1, 4 and 7 of 64.
FLIPS = (0, 1, 30, 4064)
HASH_SQL = f"h AS (SELECT p_partkey AS id, xor(('0x' || substr(sha256((p_partkey // 4)::VARCHAR), 1, 15))::BIGINT, [{', '.join(map(str, FLIPS))}][p_partkey % 4 + 1]::BIGINT) AS hash FROM part)"
PAIRS_SQL = f"{HASH_SQL}, pr AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 4)"


def hashes(spark, sf_dir):
    """id and a 64-bit hash of each part; parts of a group of four are near each other."""
    base = F.conv(F.substring(F.sha2(F.floor(F.col("p_partkey") / 4).cast("string"), 256), 1, 15), 16, 10).cast("long")
    flips = F.get(F.array(*[F.lit(x).cast("long") for x in FLIPS]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), base.bitwiseXOR(flips).alias("hash"))


@query(f"WITH {PAIRS_SQL} SELECT * FROM pr")
def near_dup_band_join(spark, sf_dir):
    h = hashes(spark, sf_dir)
    return dedup.near_pairs(h, h, 4)


@query(f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), c AS (SELECT id, id AS root FROM h UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT id, min(root) AS root FROM c GROUP BY id""")
def component_roots(spark, sf_dir):
    h = hashes(spark, sf_dir)
    return dedup.components(h, dedup.near_pairs(h, h, 4))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), c AS (SELECT id, id AS root FROM h UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id), d AS (SELECT id, id // 6 AS grp, root <> id AS dup FROM m), s AS (SELECT grp, count(*) FILTER (NOT dup) AS n, max(dup::INT) AS hit FROM d GROUP BY grp)
SELECT 'collapse' AS scenario, count(*) AS members, count(DISTINCT grp) AS groups FROM d JOIN s USING (grp) WHERE NOT dup AND n >= 3 UNION ALL
SELECT 'exclude', count(*), count(DISTINCT grp) FROM d JOIN s USING (grp) WHERE hit = 0""")
def cohort_collapse(spark, sf_dir):
    h = hashes(spark, sf_dir)
    members = h.select("id", F.floor(F.col("id") / 6).alias("grp"))
    return dedup.scenarios(members, dedup.components(h, dedup.near_pairs(h, h, 4)), "grp", "id", 3)


@query(f"""WITH {HASH_SQL} SELECT distance, count(*) AS pairs FROM (SELECT bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id % 10 = 0 AND b.id % 10 <> 0) WHERE distance <= 4 GROUP BY 1""")
def history_distance_histogram(spark, sf_dir):
    """New items (a tenth) against history (the rest)."""
    h = hashes(spark, sf_dir)
    return dedup.near_pairs(h.filter("id % 10 = 0"), h.filter("id % 10 <> 0"), 4, ordered=False).groupBy("distance").agg(F.count("*").alias("pairs"))


@query("""WITH e AS (SELECT vec_id // 5 AS grp, vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.grp, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS similarity, count(*) AS pairs FROM e a JOIN e b ON a.grp = b.grp AND a.vec_id < b.vec_id GROUP BY a.grp""")
def group_cosine(spark, sf_dir):
    """Mean cosine over the pairs of a group, inside the group's row."""
    from lattica.operators.subsets import pairs_within

    e = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    p = e.select("grp", F.explode(pairs_within(F.col("all"))).alias("p"))
    return p.groupBy("grp").agg(r(F.avg(V.cosine(F.col("p.a.embedding"), F.col("p.b.embedding"))), 6).alias("similarity"), F.count("*").alias("pairs"))


# Regrouping


STRICT_SQL = f"""{LINES_SQL}, gg AS (SELECT DISTINCT g, label, n FROM ph), o AS (SELECT *, row_number() OVER (PARTITION BY label, n ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY label, n) AS m FROM gg),
mp AS (SELECT s.g AS slot, p.r, q.photo, d.g AS donor FROM o s JOIN ph p ON p.g = s.g JOIN o d ON d.label = s.label AND d.n = s.n AND d.i = (s.i + 1 + p.r % (s.m - 1)) % s.m JOIN ph q ON q.photo = d.g * 100 + p.r WHERE s.m >= 3)"""


@query(f"WITH {STRICT_SQL} SELECT * FROM mp")
def strict_cross_shuffle(spark, sf_dir):
    """Every member from another group of its stratum."""
    return regroup.cross_groups(photos(spark, sf_dir), "g", "photo", "r", ["label", "n"])


@query(f"""WITH {LINES_SQL}, gg AS (SELECT DISTINCT g, label, n FROM ph)
SELECT slot, donor FROM (SELECT g AS slot, coalesce(lead(g) OVER (PARTITION BY label, n ORDER BY g), min(g) OVER (PARTITION BY label, n)) AS donor FROM gg) WHERE slot <> donor""")
def circular_shift(spark, sf_dir):
    return regroup.circular_groups(photos(spark, sf_dir), "g", ["label", "n"])


@query(f"""WITH {LINES_SQL} SELECT g AS slot, r, coalesce(lag(photo) OVER (PARTITION BY label, n ORDER BY g, r), last_value(photo) OVER (PARTITION BY label, n ORDER BY g, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS photo FROM ph""")
def photo_shift(spark, sf_dir):
    return regroup.circular_members(photos(spark, sf_dir), "g", "r", "photo", ["label", "n"])


@query(f"""WITH {LINES_SQL}, mem0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY substr(sha256('3|' || g || '|' || photo), 1, 16), photo) - 1 AS rr FROM ph), mem AS (SELECT *, g * 100 + rr AS place FROM mem0),
gg AS (SELECT DISTINCT g, label, n FROM ph), o AS (SELECT *, row_number() OVER (PARTITION BY label, n ORDER BY substr(sha256('3|' || g), 1, 16), g) - 1 AS i, count(*) OVER (PARTITION BY label, n) AS m FROM gg)
SELECT s.g AS slot, p.rr AS r, q.photo, d.g AS donor FROM o s JOIN mem p ON p.g = s.g JOIN o d ON d.label = s.label AND d.n = s.n AND d.i = (s.i + 1 + p.rr % (s.m - 1)) % s.m JOIN mem q ON q.place = d.g * 100 + p.rr WHERE s.m >= 3""")
def hash_regroup(spark, sf_dir):
    """The same in an order that a seed gives."""
    return regroup.cross_groups(photos(spark, sf_dir), "g", "photo", "r", ["label", "n"], seed=3)


@query(f"""WITH {STRICT_SQL} SELECT 'same_set' AS gate, count(*) AS violations FROM ph WHERE photo NOT IN (SELECT photo FROM mp) HAVING count(*) > 0""")
def mapping_gate(spark, sf_dir):
    """A regrouping's violations by gate: only members of strata that fell out are missing."""
    p = photos(spark, sf_dir)
    m = regroup.cross_groups(p, "g", "photo", "r", ["label", "n"])
    kept = p.join(m.select(F.col("slot").alias("g")).distinct(), "g", "left_semi")
    bad = regroup.mapping_faults(m, kept, "g", "photo", "label").unionAll(gates.same_set(m, p, "photo"))
    return bad.groupBy("gate").agg(F.count("*").alias("violations"))


@query(f"""WITH {STRICT_SQL}, new AS (SELECT mp.slot, ph.price AS v, ph.photo, (ph.observer = o2.observer)::INT AS same, row_number() OVER (PARTITION BY mp.slot ORDER BY ph.price, ph.photo) AS k, (ph.price > 50000)::INT AS b FROM mp JOIN ph USING (photo) JOIN obs o2 ON o2.g = mp.slot),
old AS (SELECT g AS slot, price AS w, row_number() OVER (PARTITION BY g ORDER BY price, photo) AS k, (price > 50000)::INT AS c FROM ph)
SELECT slot, round(avg(abs(v - w)), 4) AS difference, round(avg((b = c)::INT), 8) AS bin_match, round(avg(same), 8) AS same_observer FROM new JOIN old USING (slot, k) GROUP BY slot""")
def mapping_balance(spark, sf_dir):
    p = photos(spark, sf_dir).withColumn("bin", (F.col("price") > 50000).cast("int"))
    m = regroup.cross_groups(p, "g", "photo", "r", ["label", "n"])
    b = regroup.balance(m, p, "g", "photo", "price", "bin", "observer")
    return b.select("slot", r("difference", 4).alias("difference"), r("bin_match").alias("bin_match"), r("same_observer").alias("same_observer"))


# Inference


@query("""WITH x AS (SELECT sum(n_nationkey) / 7.0::DOUBLE - 8 AS x, n_regionkey AS i FROM nation GROUP BY n_regionkey),
m AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN x ELSE -x END) AS s FROM x, range(32) t(m) GROUP BY m)
SELECT 5 AS n, avg(CASE WHEN abs(s) >= (SELECT abs(sum(x)) FROM x) - 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM m""")
def signflip_exact(spark, sf_dir):
    """All sign patterns of the regions' sums."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg((F.sum("n_nationkey") / F.lit(7.0) - 8).alias("x"))
    return infer.signflip_exact(n, "x")


@query("""WITH c AS (SELECT c_mktsegment AS segment, c_nationkey % 12 AS unit, sum(c_acctbal - 4500) / 1000 AS x FROM customer GROUP BY ALL),
u AS (SELECT segment, list(x ORDER BY x) AS xs, sum(x ORDER BY x) AS seen FROM c GROUP BY 1),
m AS (SELECT segment, seen, len(xs) AS n, list_sum(list_transform(xs, lambda x, i: CASE WHEN (m >> (i - 1)::INT) & 1 = 1 THEN -x ELSE x END)) AS s FROM u JOIN range(4096) t(m) ON m < (1 << len(xs)::INT))
SELECT segment, any_value(n)::BIGINT AS n, avg(CASE WHEN abs(s) >= abs(seen) - 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, 0.0::DOUBLE AS error FROM m GROUP BY segment""")
def signflip_by_segment(spark, sf_dir):
    """A sign-flip test a market segment over its units (at most twelve), all patterns of each."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 12).alias("unit")).agg((F.sum(F.col("c_acctbal") - 4500) / 1000).alias("x"))
    return infer.signflip(c, "x", ["segment"])


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, observer, k, avg(correct) AS a FROM sc GROUP BY ALL), d AS (SELECT x.label, x.observer, y.a - x.a AS delta FROM e x JOIN e y ON x.g = y.g AND x.k = 1 AND y.k = 2),
i AS (SELECT observer, (delta - avg(delta) OVER (PARTITION BY label)) / count(*) OVER (PARTITION BY label) AS part FROM d)
SELECT observer, round(sum(part) / (SELECT count(DISTINCT label) FROM d), 10) AS influence FROM i GROUP BY observer""")
def cluster_influence(spark, sf_dir):
    return infer.influence(paired(spark, sf_dir), "delta", "label", "observer").select("observer", r("influence", 10).alias("influence"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, observer, k, avg(correct) AS a FROM sc GROUP BY ALL), d AS (SELECT x.label, x.observer, x.observer % 2 AS half, y.a - x.a AS delta FROM e x JOIN e y ON x.g = y.g AND x.k = 1 AND y.k = 2),
l AS (SELECT half, label, avg(delta) AS m FROM d GROUP BY ALL)
SELECT half, round(avg(m), 8) AS estimate, (SELECT count(DISTINCT observer) FROM d WHERE d.half = l.half) AS clusters, 'OK' AS status, true AS ordered FROM l GROUP BY half""")
def cluster_estimates(spark, sf_dir):
    """What of an interval does not depend on the draws: estimate, clusters, status, and that the ends enclose the estimate."""
    i = cluster_bootstrap(spark, sf_dir)
    return i.select("half", r("estimate").alias("estimate"), "clusters", "status", F.expr("low < estimate AND estimate < high").alias("ordered"))


@query()
def cluster_bootstrap(spark, sf_dir):
    """Interval of the change from one member to two, by cohorts of customers; seeded."""
    p = paired(spark, sf_dir).withColumn("half", F.col("observer") % 2)
    return infer.cluster_interval(p, "delta", "label", "observer", ["half"], 2000, 11)


@query("""WITH m AS (SELECT c_mktsegment AS segment, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT segment, round(avg(m), 6) AS estimate, count(*) AS labels, true AS ordered FROM m GROUP BY segment""")
def label_interval(spark, sf_dir):
    """The mean of nations' means by segment, with an interval from drawing nations; seeded."""
    i = infer.label_interval(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"], 1000, 7)
    return i.select(F.col("c_mktsegment").alias("segment"), r("estimate", 6).alias("estimate"), "labels", F.expr("low < estimate AND estimate < high").alias("ordered"))


TRANSITIONS = [(1, 2), (2, 3), (2, 4), (2, 6)]


@query()
def paired_inference(spark, sf_dir):
    """Transitions of size with interval and sign-flip test, estimable or not; seeded."""
    return infer.paired_inference(transitions(spark, sf_dir), "label", "observer", TRANSITIONS, 1000, 5)


def transitions(spark, sf_dir):
    from lattica.operators.macro import expected
    from lattica.plans.lattice import scored

    e = expected(scored(spark, sf_dir), ["g", "label", "observer"], ["correct"])
    return infer.paired_records(e, TRANSITIONS, "g", "label", "observer", "k", "correct")


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, observer, k, avg(correct) AS a FROM sc GROUP BY ALL), t AS (SELECT * FROM (VALUES {', '.join(map(str, TRANSITIONS))}) AS t(a, b)),
d AS (SELECT t.a, t.b, x.g, x.label, x.observer, y.a - x.a AS delta FROM t JOIN e x ON x.k = t.a JOIN e y ON y.k = t.b AND y.g = x.g), l AS (SELECT a, b, label, avg(delta) AS m, count(*) AS n FROM d GROUP BY ALL)
SELECT t.a AS "from", t.b AS "to", round(avg(m), 8) AS estimate, coalesce(sum(n), 0)::BIGINT AS groups FROM t LEFT JOIN l USING (a, b) GROUP BY ALL""")
def paired_estimates(spark, sf_dir):
    """Estimate and groups of each transition, estimable or not."""
    p = transitions(spark, sf_dir)
    skeleton = spark.createDataFrame(TRANSITIONS, "`from` int, `to` int")
    n = p.groupBy("from", "to").agg(F.count("*").alias("groups"))
    both = skeleton.join(infer.macro_mean(p, "delta", "label", ["from", "to"]), ["from", "to"], "left").join(n, ["from", "to"], "left")
    return both.select("from", "to", r("estimate").alias("estimate"), F.coalesce("groups", F.lit(0)).alias("groups"))


# Intake


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS n FROM events), t AS (SELECT * FROM c WHERE n <= 2),
f AS (SELECT event_type, user_id, max(event_id) AS first FROM t GROUP BY ALL), z AS (SELECT event_type, first, row_number() OVER (PARTITION BY event_type ORDER BY first DESC) AS place FROM f),
cut AS (SELECT event_type, min(first) AS cut, count(*) AS came FROM z WHERE place <= 20 GROUP BY 1)
SELECT event_type, event_id, user_id FROM t JOIN cut USING (event_type) WHERE came < 20 OR event_id >= cut""")
def event_fold_caps(spark, sf_dir):
    return fold.accepted(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id").select("event_type", "event_id", "user_id")


@query("""WITH e AS (SELECT event_type, user_id, event_id // 3 AS id FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, id) AS copy FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY id DESC) AS place FROM d WHERE copy = 1),
f AS (SELECT event_type, first, row_number() OVER (PARTITION BY event_type ORDER BY first DESC) AS n FROM (SELECT event_type, user_id, max(id) AS first FROM e GROUP BY ALL)),
c AS (SELECT event_type, min(first) AS cut, count(*) AS came FROM f WHERE n <= 40 GROUP BY 1),
s AS (SELECT d.event_type, CASE WHEN came >= 40 AND d.id < cut THEN 'stopped' WHEN d.copy > 1 THEN 'duplicate' WHEN k.place > 2 THEN 'capped' ELSE 'accepted' END AS state FROM d JOIN c USING (event_type) JOIN k ON k.event_type = d.event_type AND k.user_id = d.user_id AND k.id = d.id)
SELECT event_type, state, count(*) AS events FROM s GROUP BY ALL""")
def intake_attrition(spark, sf_dir):
    """Events by what intake does with them; ids are made to repeat."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.floor(F.col("event_id") / 3).alias("id"))
    return fold.attrition(e, "event_type", "user_id", "id", 2, 40)


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    return fold.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).select("start", "event_type", "events", r("total", 4).alias("total"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS rows, CASE WHEN count(DISTINCT user_id) >= 20 THEN 'TARGET_REACHED' WHEN count(*) >= 500 THEN 'SEARCH_BUDGET_TRUNCATED' ELSE 'SOURCE_EXHAUSTED' END AS reason FROM events GROUP BY 1""")
def stop_reasons(spark, sf_dir):
    return fold.stop_reason(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id", 20, 500)

"""The star schema read as grouped sets: an order is a group, its lines are members.

label: the order's priority (0 to 4); observer: its customer; a member's vector: five
shares made from the line's own numbers. The SQL twins of these frames are the CTEs below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import rounded

CLASSES = 5
DIGITS = 9
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(*xs: Column) -> Column:
    s = sum(xs, F.lit(0.0))
    return F.array(*[rounded(x / s, DIGITS) for x in xs])


def line_vector() -> Column:
    c = F.col
    return shares(c("l_quantity"), F.lit(400.0) * c("l_discount"), F.lit(500.0) * c("l_tax"), F.lit(5.0) * c("l_linenumber"), (c("l_partkey") % 50).cast("double"))


def groups(spark: SparkSession, sf_dir: str, low: int = 2, high: int | None = 5) -> DataFrame:
    """g, label, observer, n, photos (sorted structs of one line each, with p); high None: however many lines. One exchange of lines, one join by the same key."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    member = F.struct(*LINE_ORDER, line_vector().alias("p"))
    packed = lines.groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_list(member)).alias("photos"))
    packed = packed.filter(F.size("photos") >= low if high is None else F.size("photos").between(low, high))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.col("o_custkey").alias("observer"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"), F.col("o_orderstatus").alias("cohort"), F.col("o_totalprice").alias("value"))
    return packed.join(orders, "g").withColumn("n", F.size("photos"))


def photos(spark: SparkSession, sf_dir: str, low: int = 2, high: int = 5) -> DataFrame:
    """A row a member: g, r (rank from 0), photo (g * 100 + r), n, label, observer, cohort, price, qty, p."""
    each = groups(spark, sf_dir, low, high).select("g", "n", "label", "observer", "cohort", F.posexplode("photos").alias("r", "m"))
    return each.select("g", "r", (F.col("g") * 100 + F.col("r")).alias("photo"), "n", "label", "observer", "cohort", F.col("m.l_extendedprice").alias("price"), F.col("m.l_quantity").alias("qty"), F.col("m.p").alias("p"))


LINES_SQL = f"""
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS r,
              [l_quantity, 400.0::DOUBLE * l_discount, 500.0::DOUBLE * l_tax, 5.0::DOUBLE * l_linenumber, (l_partkey % 50)::DOUBLE] AS v FROM lineitem),
grp AS (SELECT l_orderkey AS g, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
obs AS (SELECT g, n, o_custkey AS observer, substr(o_orderpriority, 1, 1)::INT - 1 AS label, o_orderstatus AS cohort, o_totalprice AS value
        FROM grp JOIN orders ON o_orderkey = g),
ph AS (SELECT g, r, g * 100 + r AS photo, n, label, observer, cohort, l_extendedprice AS price, l_quantity AS qty,
              list_transform(v, lambda x: round(x / (v[1] + v[2] + v[3] + v[4] + v[5]), {DIGITS})) AS p
       FROM obs JOIN li ON l_orderkey = g)"""

POOLED_SQL = f"""{LINES_SQL},
masks AS (SELECT g, n, label, observer, cohort, unnest(range(1, (1 << n)::BIGINT)) AS mask FROM obs),
pool AS (SELECT k.g, k.n, k.label, k.observer, k.cohort, k.mask, bit_count(k.mask)::INT AS k,
                [{", ".join(f"round(sum(p[{i}] ORDER BY r) / count(*), {DIGITS})" for i in range(1, CLASSES + 1))}] AS p
         FROM masks k JOIN ph ON ph.g = k.g AND (k.mask >> ph.r) & 1 = 1 GROUP BY ALL),
sc AS (SELECT *, (list_position(p, list_max(p)) - 1)::INT AS prediction,
              CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct,
              list_max(p) AS confidence, -ln(greatest(1e-12::DOUBLE, least(1.0::DOUBLE, p[label + 1]))) AS nll,
              p[1]*p[1] + p[2]*p[2] + p[3]*p[3] + p[4]*p[4] + p[5]*p[5] - 2.0::DOUBLE * p[label + 1] + 1.0::DOUBLE AS brier,
              CASE WHEN 1 + len(list_filter(p, lambda x, i: x > p[label + 1] OR (x = p[label + 1] AND i - 1 < label))) <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS top3,
              least(floor(list_max(p) * 15.0::DOUBLE)::INT, 14) AS bin FROM pool)"""

#: The same over groups of every size.
EVERY_POOLED_SQL = POOLED_SQL.replace(" HAVING count(*) BETWEEN 2 AND 5", "")

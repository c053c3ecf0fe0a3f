"""Queries on subsets of a group: budgets, scores, transitions, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scoring as S
from lattica.functions.scalars import let, rounded, text_of_ids
from lattica.operators import macro as M
from lattica.operators import subsets as B
from lattica.plans.binding import CLASSES, DIGITS, EVERY_POOLED_SQL, LINES_SQL, POOLED_SQL, groups, photos

METRICS = ["correct", "top3", "nll", "brier", "confidence"]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(column, digits: int = 8):
    return rounded(F.col(column) if isinstance(column, str) else column, digits)


def scored(spark: SparkSession, sf_dir: str, low: int = 2, high: int | None = 5) -> DataFrame:
    """A row a subset with its pooled vector and scores; nothing is exchanged after the groups are built. high None: groups of any size."""
    rows = B.pooled_subsets(groups(spark, sf_dir, low, high), CLASSES, DIGITS, low=low, high=high)
    y, p = F.col("label"), F.col("p")
    return rows.select("g", "n", "label", "observer", "cohort", "mask", "k", "p", S.argmax(p).alias("prediction"), S.correct(p, y).alias("correct"), S.confidence(p).alias("confidence"), S.nll(p, y).alias("nll"), S.brier(p, y).alias("brier"), S.in_top(p, y, 3).alias("top3"), S.floor_bin(S.confidence(p), 15).alias("bin"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, avg(correct) AS a FROM sc GROUP BY ALL),
l AS (SELECT k, label, avg(a) AS a, count(*) AS n FROM e GROUP BY ALL)
SELECT k, round(avg(a), 8) AS macro_accuracy, sum(n)::BIGINT AS groups FROM l GROUP BY k""")
def flagship_gain(spark, sf_dir):
    """Macro accuracy that a random subset of each size would reach."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], ["correct"])
    return M.macro(e, ["k"], ["correct"]).select("k", r("macro_correct").alias("macro_accuracy"), "groups")


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM sc GROUP BY ALL),
l AS (SELECT k, label, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM e GROUP BY ALL),
ma AS (SELECT k, {", ".join(f"round(avg({m}), 8) AS macro_{m}" for m in METRICS)} FROM l GROUP BY k),
mi AS (SELECT k, {", ".join(f"round(avg({m}), 8) AS micro_{m}" for m in METRICS)} FROM e GROUP BY k)
SELECT * FROM ma JOIN mi USING (k)""")
def score_summary(spark, sf_dir):
    """Macro and micro accuracy, top-3, negative log-likelihood, Brier score and confidence by size."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], METRICS)
    both = M.macro(e, ["k"], METRICS).join(M.micro(e, ["k"], METRICS), "k")
    return both.select("k", *[r(f"{x}_{m}").alias(f"{x}_{m}") for x in ("macro", "micro") for m in METRICS])


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, avg(correct) AS a FROM sc WHERE n = 5 GROUP BY ALL),
l AS (SELECT k, label, avg(a) AS a, count(*) AS n FROM e GROUP BY ALL)
SELECT k, round(avg(a), 8) AS macro_accuracy, sum(n)::BIGINT AS groups FROM l GROUP BY k""")
def fixed_cohort_summary(spark, sf_dir):
    """The same over groups of exactly five members."""
    e = M.expected(scored(spark, sf_dir).filter("n = 5"), ["g", "label"], ["correct"])
    return M.macro(e, ["k"], ["correct"]).select("k", r("macro_correct").alias("macro_accuracy"), "groups")


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, avg(correct) AS a FROM sc GROUP BY ALL)
SELECT label, k, round(avg(a), 8) AS accuracy, count(*) AS groups FROM e GROUP BY ALL""")
def per_label_points(spark, sf_dir):
    """Accuracy of each label and size."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], ["correct"])
    return e.groupBy("label", "k").agg(r(F.avg("correct")).alias("accuracy"), F.count("*").alias("groups"))


@query(f"""WITH {POOLED_SQL}, s AS (SELECT a.g, a.label, a.k, a.correct AS low, b.correct AS high FROM sc a JOIN sc b ON a.g = b.g AND b.k = a.k + 1 AND (a.mask & b.mask) = a.mask)
SELECT k, count(*) AS edges, round(avg(CASE WHEN low < high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS correction,
       round(avg(CASE WHEN low > high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS regression, round(avg(high - low), 8) AS net,
       round(sum(CASE WHEN low = 1 AND high = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / nullif(sum(low), 0), 8) AS regress_given_correct,
       round(sum(CASE WHEN low = 0 AND high = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / nullif(sum(1.0::DOUBLE - low), 0), 8) AS correct_given_wrong
FROM s GROUP BY k""")
def nested_edges(spark, sf_dir):
    """Corrections and regressions when a member joins a subset, plain and conditional."""
    e = B.edges(scored(spark, sf_dir), "g", ["correct"])
    up = F.when(F.col("low_correct") < F.col("high_correct"), 1.0).otherwise(0.0)
    down = F.when(F.col("low_correct") > F.col("high_correct"), 1.0).otherwise(0.0)
    return e.groupBy("k").agg(
        F.count("*").alias("edges"), r(F.avg(up)).alias("correction"), r(F.avg(down)).alias("regression"), r(F.avg(F.col("high_correct") - F.col("low_correct"))).alias("net"),
        r(F.sum(down) / F.nullif(F.sum("low_correct"), F.lit(0.0))).alias("regress_given_correct"), r(F.sum(up) / F.nullif(F.sum(F.lit(1.0) - F.col("low_correct")), F.lit(0.0))).alias("correct_given_wrong"),
    )


@query(f"""WITH {EVERY_POOLED_SQL}, s AS (SELECT a.g, a.k, max(CASE WHEN a.correct > b.correct THEN 1 ELSE 0 END) AS harmful, max(CASE WHEN a.correct < b.correct THEN 1 ELSE 0 END) AS helpful
  FROM sc a JOIN sc b ON a.g = b.g AND b.k = a.k + 1 AND (a.mask & b.mask) = a.mask GROUP BY ALL)
SELECT k, count(*) AS groups, sum(harmful)::BIGINT AS any_harmful, sum(helpful)::BIGINT AS any_helpful FROM s GROUP BY k""")
def harm_and_help(spark, sf_dir):
    """Groups of any size with any harmful and any helpful step."""
    per = B.any_steps(scored(spark, sf_dir, 1, None), "g", "correct")
    return per.groupBy("k").agg(F.count("*").alias("groups"), F.sum("down").alias("any_harmful"), F.sum("up").alias("any_helpful"))


@query(f"""WITH {POOLED_SQL}, b AS (SELECT bin, count(*) AS c, avg(correct) AS a, avg(confidence) AS f FROM sc WHERE k = 1 GROUP BY bin)
SELECT round(sum(c * abs(a - f)) / sum(c), 8) AS ece, count(*) AS bins FROM b""")
def ece_singletons(spark, sf_dir):
    """Calibration error of single members over equal-width bins."""
    rows = scored(spark, sf_dir).filter("k = 1").withColumn("bin", S.edge_bin(F.col("confidence"), 15))
    b = rows.groupBy("bin").agg(F.count("*").alias("c"), F.avg("correct").alias("a"), F.avg("confidence").alias("f"))
    return b.agg(r(F.sum(F.col("c") * F.abs(F.col("a") - F.col("f"))) / F.sum("c")).alias("ece"), F.count("*").alias("bins"))


@query(f"""WITH {POOLED_SQL}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY g, k) AS w FROM sc),
b AS (SELECT k, bin, sum(w * (correct - confidence)) AS gap, sum(w) AS w FROM w GROUP BY ALL)
SELECT k, round(sum(abs(gap)) / sum(w), 8) AS ece FROM b GROUP BY k""")
def ece_group_equal(spark, sf_dir):
    """Calibration error of subset predictions with groups weighing alike."""
    return M.grouped_ece(scored(spark, sf_dir), ["g"], ["k"]).select("k", r("ece").alias("ece"))


@query(f"""WITH {POOLED_SQL}, c AS (SELECT g, k, {", ".join(f"avg({m}) AS {m}" for m in ("correct", "top3", "nll", "brier"))}, {", ".join(f"avg(CASE WHEN bin = {i} THEN correct - confidence ELSE 0.0::DOUBLE END) AS b{i}" for i in range(15))} FROM sc GROUP BY ALL)
SELECT k, round(avg(correct), 8) AS correct, round(avg(top3), 8) AS top3, round(avg(nll), 8) AS nll, round(avg(brier), 8) AS brier,
       round({" + ".join(f"abs(avg(b{i}))" for i in range(15))}, 8) AS ece FROM c GROUP BY k""")
def additive_components(spark, sf_dir):
    """Metrics from one row of additive parts a group and size, calibration bins included."""
    parts = [F.avg(m).alias(m) for m in ("correct", "top3", "nll", "brier")]
    bins = [F.avg(F.when(F.col("bin") == i, F.col("correct") - F.col("confidence")).otherwise(F.lit(0.0))).alias(f"b{i}") for i in range(15)]
    c = scored(spark, sf_dir).groupBy("g", "k").agg(*parts, *bins)
    ece = sum((F.abs(F.avg(f"b{i}")) for i in range(15)), F.lit(0.0))
    return c.groupBy("k").agg(*[r(F.avg(m)).alias(m) for m in ("correct", "top3", "nll", "brier")], r(ece).alias("ece"))


@query(f"""WITH {POOLED_SQL}, v AS (SELECT g, label, k, [{", ".join(f"round(sum(p[{i}] ORDER BY mask) / count(*), {DIGITS})" for i in range(1, CLASSES + 1))}] AS p FROM sc GROUP BY ALL),
e AS (SELECT g, label, k, CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM v),
l AS (SELECT k, label, avg(c) AS c FROM e GROUP BY ALL)
SELECT k, round(avg(c), 8) AS macro_accuracy FROM l GROUP BY k""")
def legacy_ensemble_curve(spark, sf_dir):
    """Vectors averaged over a group's subsets first, scored afterwards: another quantity than the flagship's."""
    e = ensembles(spark, sf_dir)
    return M.macro(e, ["k"], ["c"]).select("k", r("macro_c").alias("macro_accuracy"))


def ensembles(spark, sf_dir) -> DataFrame:
    packed = scored(spark, sf_dir).groupBy("g", "label", "n", "k").agg(F.array_sort(F.collect_list(F.struct("mask", "p"))).alias("all"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: let(F.aggregate("all", F.lit(0.0), lambda a, m: a + F.get(m["p"], c)) / F.size("all"), lambda x: rounded(x, DIGITS)))
    return packed.withColumn("p", mean).withColumn("c", S.correct(F.col("p"), F.col("label")))


@query(f"""WITH {POOLED_SQL}, v AS (SELECT g, label, n, k, [{", ".join(f"round(sum(p[{i}] ORDER BY mask) / count(*), {DIGITS})" for i in range(1, CLASSES + 1))}] AS p FROM sc GROUP BY ALL),
e AS (SELECT g, label, k, CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(DISTINCT k) = 5)),
m AS (SELECT k, avg(c) AS a FROM (SELECT k, label, avg(c) AS c FROM e GROUP BY ALL) GROUP BY k),
t AS (SELECT k, a, lead(k) OVER (ORDER BY k) - k AS step, (a + lead(a) OVER (ORDER BY k)) / 2 AS mid FROM m),
x AS (SELECT count(*) FILTER (a.c = 0 AND b.c = 1) AS corrections, count(*) FILTER (a.c = 1 AND b.c = 0) AS regressions FROM e a JOIN e b ON a.g = b.g AND a.k = 1 AND b.k = 5)
SELECT round(sum(step * mid) / sum(step), 8) AS area, any_value(corrections) AS corrections, any_value(regressions) AS regressions FROM t, x""")
def area_under_budget_curve(spark, sf_dir):
    """Normalised trapezoid area over the cohort common to all sizes, and first-to-last changes."""
    e = ensembles(spark, sf_dir).withColumn("sizes", F.count("*").over(Window.partitionBy("g"))).filter("sizes = 5")
    w = Window.orderBy("k")  # five rows
    m = M.macro(e, ["k"], ["c"]).withColumn("step", F.lead("k").over(w) - F.col("k")).withColumn("mid", (F.col("macro_c") + F.lead("macro_c").over(w)) / 2)
    area = m.agg(r(F.sum(F.col("step") * F.col("mid")) / F.sum("step")).alias("area"))
    ends = e.groupBy("g").agg(F.max(F.when(F.col("k") == 1, F.col("c"))).alias("a"), F.max(F.when(F.col("k") == 5, F.col("c"))).alias("b"))
    changes = ends.agg(F.count_if(F.expr("a = 0 AND b = 1")).alias("corrections"), F.count_if(F.expr("a = 1 AND b = 0")).alias("regressions"))
    return area.crossJoin(F.broadcast(changes))  # one row each


@query(f"""WITH {POOLED_SQL}, one AS (SELECT g, mask, correct AS c1, prediction AS p1 FROM sc WHERE k = 1), two AS (SELECT g, label, mask, correct, prediction FROM sc WHERE k = 2),
j AS (SELECT t.g, t.label, t.mask, t.correct, sum(o.c1) AS right_ones, count(DISTINCT o.p1) AS predictions FROM two t JOIN one o ON o.g = t.g AND (o.mask & t.mask) = o.mask GROUP BY ALL)
SELECT label, count(*) AS pairs, round(avg(CASE WHEN right_ones = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS joint_wrong,
       round(avg(CASE WHEN right_ones = 0 AND predictions = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS same_wrong,
       round(avg(CASE WHEN right_ones = 0 AND correct = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS rescue,
       round(avg(CASE WHEN right_ones > 0 AND correct = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS destruction, round(avg(correct), 8) AS accuracy
FROM j GROUP BY label""")
def pair_errors(spark, sf_dir):
    """How errors of two members meet: both wrong, alike wrong, rescued or destroyed by pooling."""
    p = pair_table(spark, sf_dir)
    share = lambda c: r(F.avg(F.when(c, 1.0).otherwise(0.0)))
    none = F.col("right_ones") == 0
    return p.groupBy("label").agg(
        F.count("*").alias("pairs"), share(none).alias("joint_wrong"), share(none & (F.col("pa") == F.col("pb"))).alias("same_wrong"), share(none & (F.col("correct") == 1)).alias("rescue"),
        share(~none & (F.col("correct") == 0)).alias("destruction"), r(F.avg("correct")).alias("accuracy"),
    )


def pair_table(spark, sf_dir) -> DataFrame:
    """Each pair of a group's members with single and pooled predictions, made inside the group's row."""
    g = groups(spark, sf_dir).withColumn("pair", F.explode(B.pairs_within(F.col("photos"))))
    y, pa, pb = F.col("label"), F.col("pair.a.p"), F.col("pair.b.p")
    both = F.zip_with(pa, pb, lambda a, b: rounded((a + b) / 2, DIGITS))
    return g.select("g", "label", "n", S.argmax(pa).alias("pa"), S.argmax(pb).alias("pb"), (S.correct(pa, y) + S.correct(pb, y)).alias("right_ones"), S.correct(both, y).alias("correct"))


@query(f"""WITH {EVERY_POOLED_SQL}, e AS (SELECT g, k, avg(correct) AS a FROM sc GROUP BY ALL)
SELECT k, count(*) FILTER (a >= 0.5) AS majority_correct, count(*) AS groups FROM e GROUP BY k""")
def majority_correctness(spark, sf_dir):
    """Groups, of any size, in which half or more of the subsets are right."""
    e = M.expected(scored(spark, sf_dir, 1, None), ["g"], ["correct"])
    return e.groupBy("k").agg(F.count_if(F.expr("correct >= 0.5")).alias("majority_correct"), F.count("*").alias("groups"))


@query(f"""WITH {EVERY_POOLED_SQL}, e AS (SELECT g, label, observer, k, avg(correct) AS a FROM sc GROUP BY ALL),
d AS (SELECT x.g, x.label, x.observer, y.a - x.a AS delta FROM e x JOIN e y ON x.g = y.g AND x.k = 1 AND y.k = 2)
SELECT label, round(avg(delta), 8) AS delta, count(*) AS groups, count(DISTINCT observer) AS observers,
       count(*) FILTER (delta > 1e-12) AS gains, count(*) FILTER (delta < -1e-12) AS losses FROM d GROUP BY label""")
def paired_budget_delta(spark, sf_dir):
    """Change from one member to two within the same groups, of any size from two on."""
    rows = B.ones_and_pairs(groups(spark, sf_dir, 2, None), CLASSES, DIGITS).withColumn("correct", S.correct(F.col("p"), F.col("label")))
    return deltas(rows).groupBy("label").agg(r(F.avg("delta")).alias("delta"), F.count("*").alias("groups"), F.count_distinct("observer").alias("observers"), F.count_if(F.expr("delta > 1e-12")).alias("gains"), F.count_if(F.expr("delta < -1e-12")).alias("losses"))


def paired(spark, sf_dir) -> DataFrame:
    """g, label, observer, delta of groups of two to five."""
    return deltas(scored(spark, sf_dir).filter("k <= 2"))


def deltas(rows: DataFrame) -> DataFrame:
    """g, label, observer, delta: a pivot by size instead of a self-join."""
    e = rows.groupBy("g", "label", "observer").agg(F.avg(F.when(F.col("k") == 1, F.col("correct"))).alias("a"), F.avg(F.when(F.col("k") == 2, F.col("correct"))).alias("b"))
    return e.select("g", "label", "observer", (F.col("b") - F.col("a")).alias("delta"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, avg(correct) AS a FROM sc WHERE k = 2 GROUP BY ALL), l AS (SELECT label, avg(a) AS a FROM e GROUP BY label)
SELECT label, round((sum(a) OVER () - a) / (count(*) OVER () - 1), 8) AS left_out FROM l""")
def leave_one_label_out(spark, sf_dir):
    """The macro mean without each label."""
    l = M.expected(scored(spark, sf_dir).filter("k = 2"), ["g", "label"], ["correct"]).groupBy("label").agg(F.avg("correct").alias("a"))
    s = l.agg(F.sum("a").alias("s"), F.count("*").alias("c"))
    return l.crossJoin(F.broadcast(s)).select("label", r((F.col("s") - F.col("a")) / (F.col("c") - 1)).alias("left_out"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, n, cohort, avg(correct) AS a FROM sc WHERE k = 1 GROUP BY ALL),
x AS (SELECT label, n, avg(a) AS x FROM e WHERE cohort = 'F' GROUP BY ALL), y AS (SELECT label, n, avg(a) AS y, count(*) AS w FROM e WHERE cohort = 'O' GROUP BY ALL)
SELECT round(sum((x - y) * w) / sum(w), 8) AS gap, sum(w)::BIGINT AS weight, count(*) AS cells FROM x JOIN y USING (label, n)""")
def cardinality_standardised_gap(spark, sf_dir):
    """Difference of two cohorts within cells of label and group size, weighted by the second one's counts."""
    e = M.expected(scored(spark, sf_dir).filter("k = 1"), ["g", "label", "n", "cohort"], ["correct"])
    out = M.standardised_gap(e.filter("cohort = 'F'"), e.filter("cohort = 'O'"), ["label", "n"], "correct")
    return out.select(r("gap").alias("gap"), "weight", "cells")


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, abs(hash(g)) % 1 AS z, avg(correct) AS s1, avg(top3) AS s2, avg(confidence) AS s3 FROM sc GROUP BY ALL),
u AS (SELECT k, 's1' AS seed, label, avg(s1) AS v FROM e GROUP BY k, label UNION ALL SELECT k, 's2', label, avg(s2) FROM e GROUP BY k, label UNION ALL SELECT k, 's3', label, avg(s3) FROM e GROUP BY k, label),
m AS (SELECT k, seed, avg(v) AS v FROM u GROUP BY ALL)
SELECT k, count(DISTINCT seed) AS seeds, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd, round(min(v), 8) AS low, round(max(v), 8) AS high FROM m GROUP BY k""")
def seed_dispersion(spark, sf_dir):
    """Mean, sample deviation and range of three runs, of which each must be there."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], ["correct", "top3", "confidence"])
    m = M.macro(e, ["k"], ["correct", "top3", "confidence"]).select("k", F.col("macro_correct").alias("s1"), F.col("macro_top3").alias("s2"), F.col("macro_confidence").alias("s3"))
    u = m.unpivot("k", ["s1", "s2", "s3"], "seed", "v")
    return u.groupBy("k").agg(F.count_distinct("seed").alias("seeds"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high")).filter("seeds = 3")


@query(f"""WITH {POOLED_SQL}, ids AS (SELECT g, k, mask, (SELECT string_agg((g * 100 + b)::VARCHAR, ';' ORDER BY b) FROM range(5) t(b) WHERE (mask >> b) & 1 = 1) AS photo_ids FROM sc),
h AS (SELECT *, substr(sha256('17|' || g || '|' || k || '|' || replace(photo_ids, ';', '|')), 1, 16) AS subset_key FROM ids)
SELECT g, k AS budget, CASE WHEN count(*) OVER (PARTITION BY g, k) <= 4 THEN row_number() OVER (PARTITION BY g, k ORDER BY photo_ids) ELSE row_number() OVER (PARTITION BY g, k ORDER BY subset_key) END - 1 AS replicate, photo_ids, ('0x' || subset_key)::UBIGINT::VARCHAR AS subset_key FROM h QUALIFY replicate < 4""")
def capped_budget_plan(spark, sf_dir):
    """At most four subsets of each size, by stable key where there are more."""
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("g") * 100 + i)
    return B.budget_plan(groups(spark, sf_dir).select("g", ids.alias("ids")), "g", [1, 2, 3, 4, 5], 17, 4).withColumn("subset_key", F.col("subset_key").cast("string"))


@query(f"""WITH {POOLED_SQL} SELECT g, mask, 0::BIGINT AS times, true AS known FROM sc WHERE g % 7 = 0 AND mask = 2 UNION ALL SELECT g, mask, 2::BIGINT, true FROM sc WHERE g % 7 = 1 AND mask = 1""")
def subset_coverage_gate(spark, sf_dir):
    """Finds subsets that were left out or given twice."""
    rows = scored(spark, sf_dir).select("g", "n", "mask")
    broken = rows.filter("NOT (g % 7 = 0 AND mask = 2)").unionAll(rows.filter("g % 7 = 1 AND mask = 1"))
    return B.coverage_faults(broken, rows.select("g", "n").distinct(), "g")


@query(f"""WITH {POOLED_SQL}, b AS (SELECT g, mask, label, p, prediction, CASE WHEN g % 5 = 0 THEN [p[1] + 0.5::DOUBLE, p[2], p[3], p[4], p[5]] WHEN g % 5 = 1 THEN p[1:4] ELSE p END AS q, CASE WHEN g % 5 = 2 THEN (prediction + 1) % 5 ELSE prediction END AS shown FROM sc WHERE k = 1),
f AS (SELECT g, mask, list_filter([CASE WHEN list_position(q, list_max(q)) - 1 <> shown THEN 'argmax' END, CASE WHEN len(q) <> 5 THEN 'length' END,
  CASE WHEN len(list_filter(q, lambda x: x < 0 OR x > 1)) > 0 THEN 'outside' END, CASE WHEN abs(list_sum(q) - 1.0::DOUBLE) > 1e-5 THEN 'sum' END], lambda x: x IS NOT NULL) AS faults FROM b)
SELECT fault, count(*) AS records FROM (SELECT unnest(faults) AS fault FROM f) GROUP BY fault""")
def prediction_faults(spark, sf_dir):
    """Faults of stored vectors: wrong length, sum or argmax."""
    rows = scored(spark, sf_dir).filter("k = 1")
    q = F.expr("CASE WHEN g % 5 = 0 THEN array(p[0] + 0.5D, p[1], p[2], p[3], p[4]) WHEN g % 5 = 1 THEN slice(p, 1, 4) ELSE p END")
    shown = F.expr("IF(g % 5 = 2, (prediction + 1) % 5, prediction)")
    return rows.select(F.explode(S.faults(q, shown, CLASSES)).alias("fault")).groupBy("fault").agg(F.count("*").alias("records"))


@query(f"""WITH {POOLED_SQL}, t AS (SELECT g, mask, (SELECT string_agg(i::VARCHAR, ';' ORDER BY x DESC, i) FROM (SELECT unnest(p) AS x, unnest(range(5)) AS i ORDER BY x DESC, i LIMIT 3)) AS top FROM sc WHERE k = 1)
SELECT top, count(*) AS members FROM t GROUP BY top""")
def top_classes(spark, sf_dir):
    """The three likeliest classes of each member, as text."""
    return scored(spark, sf_dir).filter("k = 1").select(S.top_classes(F.col("p"), 3).alias("top")).groupBy("top").agg(F.count("*").alias("members"))


@query(f"""WITH {LINES_SQL}, w AS (SELECT g, photo, row_number() OVER (PARTITION BY g ORDER BY price DESC, photo) AS place, ceil(n * 0.5::DOUBLE) AS keep FROM ph)
SELECT g, string_agg(photo::VARCHAR, ';' ORDER BY photo) AS kept FROM w WHERE place <= keep GROUP BY g""")
def top_fraction_views(spark, sf_dir):
    """Half of a group's members by score, ties by id."""
    m = F.expr("array_sort(transform(photos, (x, i) -> struct(-x.l_extendedprice AS s, g * 100 + i AS photo)))")
    kept = F.array_sort(F.transform(F.slice(m, 1, F.ceil(F.col("n") * 0.5).cast("int")), lambda x: x["photo"]))
    return groups(spark, sf_dir).select("g", text_of_ids(kept).alias("kept"))


@query(f"""WITH {LINES_SQL} SELECT g, r, round(CASE WHEN n <= 1 OR stddev_pop(price) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (price - avg(price) OVER w) / stddev_pop(price) OVER w END, 6) AS z FROM ph WINDOW w AS (PARTITION BY g)""")
def zscore_views(spark, sf_dir):
    """Population z-score of each member's price within its group."""
    from lattica.functions.scalars import zscore

    return photos(spark, sf_dir).select("g", "r", r(zscore(F.col("price"), "g"), 6).alias("z"))


@query(f"""WITH {LINES_SQL} SELECT g, round(avg(p[1]), 12) AS mean0, max(p[1]) AS max0, round(median(p[2]), 12) AS median1,
 round(CASE WHEN count(*) >= 3 THEN (sum(p[3]) - max(p[3]) - min(p[3])) / (count(*) - 2) ELSE avg(p[3]) END, 12) AS trimmed2 FROM ph GROUP BY g""")
def masked_pools(spark, sf_dir):
    """Mean, maximum, median and trimmed mean over a group's members, one class each."""
    from lattica.operators.aggregators import POOLS

    at = lambda c: F.transform("photos", lambda m: F.get(m["p"], F.lit(c)))
    return groups(spark, sf_dir).select("g", r(POOLS["mean"](at(0)), 12).alias("mean0"), POOLS["max"](at(0)).alias("max0"), r(POOLS["median"](at(1)), 12).alias("median1"), r(POOLS["trimmed"](at(2)), 12).alias("trimmed2"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, avg(correct) AS m1, avg(top3) AS m2, avg(confidence) AS m3 FROM sc WHERE k = 2 GROUP BY ALL),
u AS (SELECT g, label, 'm1' AS model, m1 AS v FROM e UNION ALL SELECT g, label, 'm2', m2 FROM e UNION ALL SELECT g, label, 'm3', m3 FROM e),
d AS (SELECT a.label, a.model AS model_a, b.model AS model_b, a.v - b.v AS d FROM u a JOIN u b ON a.g = b.g AND a.model < b.model), l AS (SELECT label, model_a, model_b, avg(d) AS d FROM d GROUP BY ALL)
SELECT model_a, model_b, round(avg(d), 8) AS difference, count(*) AS labels FROM l GROUP BY ALL""")
def pairwise_models(spark, sf_dir):
    """Macro differences of all pairs of models on the same groups, from one row a group."""
    e = M.expected(scored(spark, sf_dir).filter("k = 2"), ["g", "label"], ["correct", "top3", "confidence"])
    names = {"m1": "correct", "m2": "top3", "m3": "confidence"}
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(names[a]) - F.col(names[b])).alias("d")) for a in names for b in names if a < b]))
    d = e.select("label", pairs.alias("p")).select("label", "p.*")
    return M.macro(d, ["model_a", "model_b"], ["d"]).select("model_a", "model_b", r("macro_d").alias("difference"), "labels")


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, avg(correct) AS a, avg(nll) AS l FROM sc GROUP BY ALL), m AS (SELECT k, avg(a) AS accuracy, avg(l) AS nll FROM e GROUP BY k)
SELECT k, 'accuracy' AS metric, round(accuracy, 8) AS value FROM m UNION ALL SELECT k, 'nll', round(nll, 8) FROM m""")
def metric_rows(spark, sf_dir):
    """A map of metrics as long rows."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], ["correct", "nll"]).groupBy("k").agg(F.avg("correct").alias("a"), F.avg("nll").alias("l"))
    return e.select("k", F.explode(F.create_map(F.lit("accuracy"), r("a"), F.lit("nll"), r("l"))).alias("metric", "value"))


@query(f"""WITH {POOLED_SQL}, e AS (SELECT g, label, k, avg(correct) AS a FROM sc GROUP BY ALL), x AS (SELECT * FROM e WHERE g % 13 <> 5),
f AS (SELECT k, avg(a) AS full_a FROM (SELECT k, label, avg(a) AS a FROM e GROUP BY ALL) GROUP BY k), y AS (SELECT k, avg(a) AS part_a FROM (SELECT k, label, avg(a) AS a FROM x GROUP BY ALL) GROUP BY k),
n AS (SELECT k, count(*) AS groups, count(*) FILTER (g % 13 <> 5) AS covered FROM e GROUP BY k)
SELECT k, groups, covered, round(part_a - full_a, 8) AS difference FROM f JOIN y USING (k) JOIN n USING (k)""")
def mode_comparison(spark, sf_dir):
    """All groups against those that an exclusion leaves."""
    e = M.expected(scored(spark, sf_dir), ["g", "label"], ["correct"]).withColumn("kept", F.col("g") % 13 != 5)
    l = e.groupBy("k", "label").agg(F.avg("correct").alias("a"), F.avg(F.when(F.col("kept"), F.col("correct"))).alias("b"), F.count("*").alias("n"), F.count_if("kept").alias("c"))
    return l.groupBy("k").agg(F.sum("n").alias("groups"), F.sum("c").alias("covered"), r(F.avg("b") - F.avg("a")).alias("difference"))

"""Bins, strata, family-wise correction and within-group correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.numbering import checkpoints

#: Rows up to which a table of by-groups is broadcast.
FEW = 100_000


def quantile_edges(rows: DataFrame, column: str, parts: int, by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantile edges of a column, repeated edges once. The values, equal ones counted first, are sorted by range partitions and found by their ranks, so no task holds a by-group; without values the edges are null."""
    checkpoints(rows.sparkSession)
    order = [*by, column]
    w = Window.partitionBy("_part").orderBy(*order)
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*order).agg(F.count("*").alias("_n"))
    within = counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_end", F.sum("_n").over(w)).checkpoint()
    sizes = within.groupBy("_part").agg(F.sum("_n").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    ranked = within.join(F.broadcast(before), "_part").withColumn("_end", F.col("_end") + F.col("_before"))  # one number a partition
    spans = ranked.groupBy(*by).agg(F.min(F.col("_end") - F.col("_n")).alias("_first"), F.sum("_n").alias("_all")).checkpoint()
    few = F.broadcast(spans) if not by or spans.limit(FEW + 1).count() <= FEW else spans
    each = ranked.join(few, list(by)) if by else ranked.crossJoin(few)
    places = [F.lit(i / parts) * (F.col("_all") - 1) for i in range(parts + 1)]
    wanted = F.array_distinct(F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]))
    last = F.col("_end") - F.col("_first")
    hit = each.withColumn("_at", F.filter(wanted, lambda k: (k < last) & (k >= last - F.col("_n")))).filter(F.size("_at") > 0)
    found = hit.groupBy(*by).agg(F.max("_all").alias("_all"), F.flatten(F.collect_list(F.transform("_at", lambda k: F.struct(k.alias("key"), F.col(column).cast("double").alias("value"))))).alias("_values"))
    value = lambda k: F.get(F.filter("_values", lambda v: v["key"] == k), F.lit(0))["value"]
    linear = lambda x: F.when(F.floor(x) == F.ceil(x), value(F.floor(x))).otherwise((F.ceil(x) - x) * value(F.floor(x)) + (x - F.floor(x)) * value(F.ceil(x)))
    edges = F.when(F.col("_all").isNotNull(), F.array_distinct(F.array(*[linear(x) for x in places])))
    return found.select(*by, edges.alias("edges"))


def quantile_bin(rows: DataFrame, column: str, parts: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 1, the lowest edge in the first; one value is one bin, null has none."""
    edges = quantile_edges(rows, column, parts)
    b = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(column))))
    return rows.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), b)).drop("edges")


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below x: left-closed bins from 0."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))


def fitted_bin(rows: DataFrame, column: str, fit_on: Column, at: Sequence[float], name: str = "bin") -> DataFrame:
    """Left-closed bins whose edges are quantiles of the rows that fit_on selects."""
    edges = rows.filter(fit_on).agg(F.percentile(column, F.array(*[F.lit(x) for x in at])).alias("edges"))
    return rows.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("edges", lambda e: e <= F.col(column)))).drop("edges")


def holm(rows: DataFrame, p: str, family: Sequence[str], order: Sequence[str], name: str = "adjusted") -> DataFrame:
    """Holm's step-down: the running maximum of (m - rank) p by rising p, at most 1. A null p stays null and does not count."""
    there = F.col(p).isNotNull()
    w = Window.partitionBy(*family, there)
    by_p = w.orderBy(p, *order)
    step = (F.count("*").over(w) - F.row_number().over(by_p) + 1) * F.col(p)
    run = by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("step", step).withColumn(name, F.when(there, F.least(F.lit(1.0), F.max("step").over(run)))).drop("step")


def complete_families(rows: DataFrame, family: Sequence[str], size: int) -> DataFrame:
    """Families that do not have as many tests as they must."""
    return rows.groupBy(*family).agg(F.count("*").alias("tests")).filter(F.col("tests") != size)


def within_correlation(rows: DataFrame, x: str, y: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of x and y after their label means are taken off; null for two rows or fewer, or no variance. Variances and covariances of a label are partial aggregates, so a label is no task."""
    m = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    per = m.groupBy(*by, label).agg(F.count("*").alias("n"), F.var_pop(x).alias("u"), F.var_pop(y).alias("v"), F.covar_pop(x, y).alias("c"))
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    all_in = per.groupBy(*by).agg(F.sum("n").alias("rows"), mean("u").alias("u"), mean("v").alias("v"), mean("c").alias("c"))
    ok = (F.col("rows") > 2) & (F.col("u") > 1e-24) & (F.col("v") > 1e-24)
    return all_in.select(*by, F.when(ok, F.col("c") / F.sqrt(F.col("u") * F.col("v"))).alias("r"), F.col("rows").alias("n"))


def stratified(rows: DataFrame, strata: Sequence[str], by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One pass over several strata: stratum, value, by, aggregates (an unpivot, not a scan a stratum)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata]))
    long = rows.withColumn("s", pairs)
    return long.groupBy(F.col("s.stratum").alias("stratum"), F.col("s.value").alias("value"), *by).agg(*aggregates)


def support(rows: DataFrame, stratum: Sequence[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of strata with enough rows, attrition: strata that fall out whole, with the reason)."""
    counted = rows.withColumn("size", F.count("*").over(Window.partitionBy(*stratum)))
    lost = rows.groupBy(*stratum).agg(F.count("*").alias("size")).filter(F.col("size") < least).withColumn("reason", F.lit(f"fewer than {least}"))
    return counted.filter(F.col("size") >= least).drop("size"), lost


def covariate_report(rows: DataFrame, covariates: Sequence[str], value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """by, covariate, available and missing rows, r: of each covariate with the value after their label means are taken off. One unpivot in place of a scan a covariate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates]))
    long = rows.select(*by, label, F.col(value).alias("y"), pairs.alias("c")).select(*by, label, "y", "c.*")
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = long.groupBy(*by, "covariate").agg(F.count_if(there).alias("available"), F.count_if(~there).alias("missing"))
    return counts.join(within_correlation(long, "x", "y", label, [*by, "covariate"]).drop("n"), [*by, "covariate"], "left")


def covariate_strata(rows: DataFrame, covariates: Sequence[str], value: str, label: str, parts: int = 4) -> DataFrame:
    """covariate, bin (quantile bins of its available rows; repeated edges once), rows, labels, macro (mean of the label means of the value); a covariate of one value has none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates]))
    checkpoints(rows.sparkSession)
    long = rows.select(label, F.col(value).alias("y"), pairs.alias("c")).select(label, "y", "c.*").filter("x IS NOT NULL AND y IS NOT NULL").checkpoint()
    edges = quantile_edges(long, "x", parts, ["covariate"]).filter(F.size("edges") > 1)
    binned = long.join(F.broadcast(edges), "covariate").withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("x")))))
    per = binned.groupBy("covariate", "bin", label).agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    return per.groupBy("covariate", "bin").agg(F.sum("n").alias("rows"), F.count("*").alias("labels"), F.avg("m").alias("macro"))

"""Member manifests: one fixed set of columns, a dense class index, class tables and their repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import gates
from lattica.operators.numbering import numbered


def with_class_index(rows: DataFrame, taxon: str, name: str = "class_index") -> DataFrame:
    """Classes numbered from 0 by taxon; the class table is small and joined back."""
    return rows.join(numbered(rows.select(taxon).distinct(), [taxon], name), taxon)


def combined(cohorts: Sequence[DataFrame], member: str, taxon: str) -> tuple[DataFrame, DataFrame]:
    """(union by name with a class index, members that occur twice); missing columns are null."""
    out = cohorts[0]
    for c in cohorts[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return with_class_index(out, taxon), gates.unique(out, [member])


def from_groups(groups: DataFrame, members: str, class_table: DataFrame, cohort: str) -> tuple[DataFrame, DataFrame]:
    """(a row a member of nested groups with its class, groups whose taxon has none)."""
    flat = groups.select(*[c for c in groups.columns if c != members], F.explode(members).alias("m")).select("*", "m.*").drop("m").withColumn("cohort", F.lit(cohort))
    both = flat.join(class_table.select("taxon_id", "class_index"), "taxon_id", "left")
    return both.filter("class_index IS NOT NULL"), gates.violations(both.filter("class_index IS NULL"), "no_class", F.col("observation_id"), F.col("taxon_id"))


def class_table(current: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Current classes, then new ones, by `order` and id, numbered from 0; origin tells which."""
    both = current.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1)))
    return numbered(both, ["origin", order, "taxon_id"], "class_index")


def canonical_taxa(rows: DataFrame, taxon: str, name: str, index: str) -> tuple[DataFrame, DataFrame]:
    """(taxon, name, index once each, violations): one non-blank name and one class a taxon, one taxon a class, no null taxon."""
    names = F.collect_set(F.nullif(F.trim(F.col(name)), F.lit("")))
    g = rows.groupBy(taxon).agg(names.alias("names"), F.collect_set(index).alias("classes"))
    bad = g.filter(F.col(taxon).isNull() | (F.size("names") != 1) | (F.size("classes") != 1))
    out = g.select(taxon, F.get("names", F.lit(0)).alias(name), F.get("classes", F.lit(0)).alias(index))
    return out, gates.violations(bad, "canonical_taxon", F.col(taxon), F.size("names")).unionAll(gates.unique(out.filter(F.col(index).isNotNull()), [index]))


def replaced(classes: DataFrame, removed: Column, values: dict[str, Column]) -> DataFrame:
    """The class table with one row's columns replaced; its slot stays."""
    return classes.select(*[F.when(F.col("taxon_id") == removed, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in classes.columns])


def strict_support(rows: DataFrame, taxon: str, observer: str, threshold: int) -> DataFrame:
    """Adds strict: whether the taxon has at least threshold observers."""
    n = rows.groupBy(taxon).agg((F.count_distinct(observer) >= threshold).alias("strict"))
    return rows.join(n, taxon)


def member_map(rows: DataFrame, group: str, member: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))


def group_facts(rows: DataFrame, group: str, observer: str, area: Column, edges: Sequence[float]) -> DataFrame:
    """A row a group: size, mean area, its observer's number of groups and the area's bin."""
    from lattica.operators.strata import edge_bin

    g = rows.groupBy(group, observer).agg(F.count("*").alias("size"), F.avg(area).alias("area"))
    o = g.groupBy(observer).agg(F.count("*").alias("observer_groups"))
    return g.join(o, observer).withColumn("area_bin", edge_bin(F.col("area"), edges))


def prefix_faults(done: DataFrame, plan: DataFrame, place: str, key: str) -> DataFrame:
    """Places at which a finished list is not the plan's beginning."""
    both = done.select(place, F.col(key).alias("done")).join(plan.select(place, F.col(key).alias("plan")), place, "left")
    return both.filter(~F.col("done").eqNullSafe(F.col("plan")))


def subset_of_source(cohort: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of a derived cohort that its source does not hold unchanged."""
    return cohort.select(*source.columns).exceptAll(source)


def whole_groups(part: DataFrame, full: DataFrame, group: str) -> DataFrame:
    """Rows by which the groups of a part differ from the full frame's: both ways empty for whole, unchanged groups."""
    return gates.same_rows(part, full.join(part.select(group).distinct(), group, "left_semi").select(*part.columns))

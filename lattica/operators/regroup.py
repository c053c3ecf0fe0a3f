"""Regrouping members across groups of a stratum, deterministic and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import stable_hex
from lattica.operators import gates
from lattica.operators.numbering import places

PSEUDO_OBSERVER = -1


def group_order(members: DataFrame, group: str, stratum: Sequence[str], key: Column) -> DataFrame:
    """group, stratum, i (place from 0), m (groups in the stratum): a row a group."""
    g = members.select(group, *stratum).distinct().withColumn("order_key", key)
    return places(g, stratum, ["order_key", group]).drop("order_key")


def signature(members: DataFrame, group: str, bin_column: str) -> DataFrame:
    """Sorted bins of a group's members as text."""
    return members.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.col(bin_column).cast("string"))), ";").alias("signature"))


def cross_groups(members: DataFrame, group: str, member: str, rank: str, stratum: Sequence[str], seed: int | None = None, least: int = 3) -> DataFrame:
    """slot, member, donor: slot j of group i takes member j of the group 1 + j mod (m - 1) places on. Without a seed groups stand in order of their id, with one in order of a stable key, and so do members within a group. Strata with fewer than `least` groups fall out."""
    key = F.col(group).cast("string") if seed is None else stable_hex(F.lit(seed), F.col(group))
    if seed is None:
        key = F.lpad(F.col(group).cast("string"), 20, "0")
    places = group_order(members, group, stratum, key).filter(F.col("m") >= least)
    if seed is not None:
        w = Window.partitionBy(group).orderBy(stable_hex(F.lit(seed), F.col(group), F.col(member)), member)
        members = members.withColumn(rank, F.row_number().over(w) - 1)
    slots = members.select(group, rank, *stratum).join(places, [group, *stratum])
    slots = slots.withColumn("donor_i", (F.col("i") + 1 + F.col(rank) % (F.col("m") - 1)) % F.col("m"))
    donors = places.select(F.col(group).alias("donor"), *stratum, F.col("i").alias("donor_i"))
    taken = members.select(F.col(group).alias("donor"), rank, member)
    return slots.join(donors, [*stratum, "donor_i"]).join(taken, ["donor", rank]).select(F.col(group).alias("slot"), rank, member, "donor")


def repeats(members: DataFrame, group: str, member: str, rank: str, stratum: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """cross_groups for each seed, with `repeat`."""
    out = None
    for s in seeds:
        one = cross_groups(members, group, member, rank, stratum, s).withColumn("repeat", F.lit(s))
        out = one if out is None else out.unionAll(one)
    return out


def circular_groups(members: DataFrame, group: str, stratum: Sequence[str]) -> DataFrame:
    """slot, donor: each group takes the next one's members, the last the first's; strata of one group fall out. Places are joined, so that no stratum is one task."""
    g = places(members.select(group, *stratum).distinct(), stratum, [group]).filter("m > 1")
    donors = g.select(F.col(group).alias("donor"), *stratum, F.col("i").alias("next"))
    return g.withColumn("next", (F.col("i") + 1) % F.col("m")).join(donors, [*stratum, "next"]).select(F.col(group).alias("slot"), "donor")


def circular_members(members: DataFrame, group: str, rank: str, member: str, stratum: Sequence[str]) -> DataFrame:
    """slot, rank, member: members of a stratum in order (group, rank), each place taking the one before, the first the last."""
    p = places(members.select(group, rank, member, *stratum), stratum, [group, rank])
    taken = p.select(F.col(member).alias("taken"), *stratum, F.col("i").alias("before"))
    slots = p.select(F.col(group).alias("slot"), rank, *stratum, ((F.col("i") + F.col("m") - 1) % F.col("m")).alias("before"))
    return slots.join(taken, [*stratum, "before"]).select("slot", rank, F.col("taken").alias(member))


def mapping_faults(mapping: DataFrame, members: DataFrame, group: str, member: str, label: str, least_donors: int = 2) -> DataFrame:
    """Violations of a regrouping: same pool of members, same slots and sizes, no member from its own group, enough donors, same label."""
    pool = gates.same_set(mapping, members, member)
    twice = gates.unique(mapping, [member])
    own = gates.violations(mapping.filter(F.col("slot") == F.col("donor")), "own_member", F.col("slot"), F.col(member))
    sizes = mapping.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct("donor").alias("donors"))
    want = members.groupBy(F.col(group).alias("slot")).agg(F.count("*").alias("want"), F.min(label).alias("label"))
    both = sizes.join(want, "slot", "full")
    size = gates.violations(both.filter(~F.col("n").eqNullSafe(F.col("want"))), "slot_size", F.col("slot"), F.col("n"))
    few = gates.violations(sizes.filter(F.col("donors") < F.least(F.lit(least_donors), F.col("n"))), "few_donors", F.col("slot"), F.col("donors"))
    labels = members.select(F.col(group).alias("donor"), F.col(label).alias("donor_label")).distinct()
    other = mapping.join(want.select("slot", "label"), "slot").join(labels, "donor").filter(F.col("label") != F.col("donor_label"))
    return gates.report([pool, twice, own, size, few, gates.violations(other, "other_label", F.col("slot"), F.col("donor"))])


def balance(mapping: DataFrame, members: DataFrame, group: str, member: str, value: str, bin_column: str, observer: str) -> DataFrame:
    """Per slot: mean absolute difference of the value ranks of old and new members, share of equal sorted bins, share of donors by the same observer."""
    owner = members.select(F.col(group).alias("slot"), F.col(observer).alias("slot_observer")).distinct()
    new = mapping.join(members.select(member, value, bin_column, F.col(observer).alias("o")), member).join(owner, "slot")
    order = lambda f, by: f.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(value, member)))
    a = order(new, "slot").select("slot", "place", F.col(value).alias("v"), F.col(bin_column).alias("b"), (F.col("o") == F.col("slot_observer")).cast("double").alias("same"))
    b = order(members, group).select(F.col(group).alias("slot"), "place", F.col(value).alias("w"), F.col(bin_column).alias("c"))
    return a.join(b, ["slot", "place"]).groupBy("slot").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("difference"), F.avg((F.col("b") == F.col("c")).cast("double")).alias("bin_match"), F.avg("same").alias("same_observer"))

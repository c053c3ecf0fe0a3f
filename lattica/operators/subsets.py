"""The lattice of non-empty subsets of a group's members, as bitmasks over their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import rounded, stable_hex

#: 2^n - 1 rows a group: larger groups are refused, not cut.
MOST_MEMBERS = 12

#: So many members' sums are one compiled method where groups have any size; with 12 it is too long to be made machine code and takes four times as long.
COMPILED = 8


def members(photos: Column, mask: Column) -> Column:
    """The members whose bit is set."""
    return F.filter(photos, lambda x, i: F.getbit(mask, i) == 1)


def with_subsets(groups: DataFrame, photos: str = "photos", low: int = 2, high: int = 5) -> DataFrame:
    """A row for each subset: mask, k and its members, of groups with low to high members."""
    if not 1 <= low <= high <= MOST_MEMBERS:
        raise ValueError(f"group sizes must be within 1 and {MOST_MEMBERS}")
    kept = groups.filter(F.size(photos).between(low, high)).withColumn("n", F.size(photos))
    masks = F.sequence(F.lit(1).cast("long"), F.expr(f"shiftleft(1L, size({photos}))") - 1)
    each = kept.withColumn("mask", F.explode(masks)).withColumn("k", F.bit_count("mask"))
    return each.withColumn("members", members(F.col(photos), F.col("mask")))


def pooled(subsets: DataFrame, classes: int, digits: int | None = None) -> DataFrame:
    """Adds p, the members' mean probability vector, inside the row: no shuffle."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.aggregate("members", F.lit(0.0), lambda a, m: a + F.get(m["p"], c)) / F.size("members"))
    return subsets.withColumn("p", F.transform(mean, lambda x: rounded(x, digits)) if digits else mean)


def pooled_subsets(groups: DataFrame, classes: int, digits: int | None = None, photos: str = "photos", low: int = 2, high: int | None = 5) -> DataFrame:
    """A row for each subset: mask, k and p, the members' mean vector, without the members themselves. A group's vectors become one flat array; a subset's sums are plain arithmetic on it, which is compiled, and nothing is exchanged. high None: groups of any size, for which members beyond the first eight are added by a fold and masks are made by blocks, so that no row holds them all."""
    if low < 1 or high is not None and not low <= high <= MOST_MEMBERS:
        raise ValueError(f"group sizes must be within 1 and {MOST_MEMBERS}")
    flat = F.flatten(F.transform(photos, lambda x: x["p"]))
    kept = groups.filter(F.size(photos) >= low if high is None else F.size(photos).between(low, high)).withColumn("n", F.size(photos)).withColumn("flat", flat).drop(photos)
    if high is None:
        each = every_mask(kept)
    else:
        each = kept.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, n)") - 1)))
    each = each.withColumn("k", F.bit_count("mask"))

    def sum_of(c: int) -> Column:
        out = F.lit(0.0)
        for i in range(high or COMPILED):
            out = out + F.when(F.getbit("mask", F.lit(i)) == 1, F.get("flat", F.lit(i * classes + c))).otherwise(F.lit(0.0))
        return out

    def mean_of(total: Column) -> Column:
        return rounded(total / F.col("k"), digits) if digits else total / F.col("k")

    if high is not None:
        return each.withColumn("p", F.array(*[mean_of(sum_of(c)) for c in range(classes)])).drop("flat")
    added = lambda a, i: F.array(*[F.get(a, F.lit(c)) + F.get("flat", i * classes + c) for c in range(classes)])
    # the first members' sums are a column of their own and used twice: inside the fold they wouldn't be compiled
    each = each.withColumn("sums", F.array(*[sum_of(c) for c in range(classes)]))
    fold = F.aggregate("beyond", F.col("sums"), lambda a, i: F.when(F.getbit("mask", i) == 1, added(a, i)).otherwise(a))
    each = each.withColumn("sums", F.when(F.size("beyond") == 0, F.col("sums")).otherwise(fold))
    return each.withColumn("p", F.array(*[mean_of(F.get("sums", F.lit(c))) for c in range(classes)])).drop("flat", "beyond", "sums")


def every_mask(groups: DataFrame) -> DataFrame:
    """Adds mask, a row for each non-empty subset of n members, and beyond, the ranks from COMPILED on. A group's masks come by blocks of 65,536; more than 40 members (10^12 masks) raise."""
    last = F.when(F.col("n") <= 40, F.expr("shiftleft(1L, n)") - 1).otherwise(F.raise_error(F.lit("the subsets of more than 40 members can't be listed")).cast("long"))
    beyond = F.when(F.col("n") > COMPILED, F.sequence(F.lit(COMPILED), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    each = groups.withColumn("beyond", beyond).withColumn("last", last).withColumn("block", F.explode(F.expr("sequence(0L, shiftright(last, 16))")))
    return each.withColumn("mask", F.explode(F.expr("sequence(greatest(shiftleft(block, 16), 1L), least(shiftleft(block, 16) + 65535, last))"))).drop("last", "block")


def budget_plan(groups: DataFrame, key: str, budgets: list[int], seed: int, most: int | None = None, ids: str = "ids") -> DataFrame:
    """Per group and budget k <= n the k-subsets of its distinct sorted ids, in order of their ids; more than `most` are cut to those with the smallest stable keys, in that order. replicate numbers them. Made inside the group's row; larger groups than MOST_MEMBERS raise."""
    sized = groups.select(key, F.array_sort(F.array_distinct(ids)).alias("ids"))
    size = F.when(F.size("ids") <= MOST_MEMBERS, F.size("ids")).otherwise(F.raise_error(F.lit(f"a group has more than {MOST_MEMBERS} members")).cast("int"))
    each = sized.withColumn("n", size).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in sorted(set(budgets))]))).filter("budget <= n AND budget > 0")
    masks = F.filter(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, n)") - 1), lambda m: F.bit_count(m) == F.col("budget"))
    each = each.withColumn("subsets", F.transform(masks, lambda m: members(F.col("ids"), m)))
    text = lambda x, by: F.array_join(F.transform(x, lambda i: i.cast("string")), by)
    named = F.transform("subsets", lambda x: F.struct(stable_hex(F.lit(seed), F.col(key), F.col("budget"), text(x, "|")).alias("subset_key"), x.alias("ids")))
    in_order = F.array_sort(F.transform("named", lambda s: F.struct(s["ids"].alias("ids"), s["subset_key"].alias("subset_key"))))
    by_key = F.transform(F.slice(F.array_sort("named"), 1, most or 1), lambda s: F.struct(s["ids"].alias("ids"), s["subset_key"].alias("subset_key")))
    kept = F.when(F.size("named") <= most, in_order).otherwise(by_key) if most else in_order
    plan = each.withColumn("named", named).select(key, "budget", F.posexplode(kept).alias("replicate", "s"))
    return plan.select(key, "budget", "replicate", text(F.col("s.ids"), ";").alias("photo_ids"), F.conv("s.subset_key", 16, 10).cast("decimal(20,0)").alias("subset_key"))


def coverage_faults(records: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Subsets that a group (key, n) should have once and does not: (key, mask, times)."""
    expected = groups.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, n)") - 1)).alias("mask"), F.lit(1).alias("expected"))
    actual = records.groupBy(key, "mask").agg(F.count("*").alias("times"))
    both = expected.join(actual, [key, "mask"], "full")
    return both.filter("expected IS NULL OR times IS NULL OR times <> 1").select(key, "mask", F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.col("expected").isNotNull().alias("known"))


def edges(scored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Steps of the lattice: a subset (lower mask) with each one that adds a member; columns of both as low_* and high_*. Groups must be complete (see coverage_faults). One exchange by the group."""
    grouped = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mask", "k", *columns))).alias("all"))
    low = grouped.select(key, "all", F.expr("cast(round(log2(size(all) + 1)) AS int)").alias("n"), F.explode("all").alias("a"))
    step = low.withColumn("bit", F.explode(F.expr("filter(sequence(0, n - 1), i -> getbit(a.mask, i) = 0)")))
    both = step.withColumn("b", F.expr("get(all, cast((a.mask | shiftleft(1L, bit)) - 1 AS int))"))
    return both.select(key, F.col("a.k").alias("k"), F.col("a.mask").alias("low_mask"), F.col("b.mask").alias("high_mask"), *[F.col(f"a.{c}").alias(f"low_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"high_{c}") for c in columns])


def any_steps(scored: DataFrame, key: str, column: str) -> DataFrame:
    """key, k, down, up (0 or 1): whether any step from k members to k + 1 turns column from 1 to 0, and from 0 to 1; groups (n) of any size, which must be complete. The outcomes of 64 subsets that differ in the first six members are the bits of a word: a step to one of these is a shift within the word, a step to a later member meets another word. A row is a word, never a lattice."""
    first, whole = F.shiftright("mask", 6), F.col("mask").bitwiseAND(63).cast("int")
    words = scored.select(key, "n", first.alias("base"), F.when(F.col(column) == 1, F.call_function("shiftleft", F.lit(1).cast("long"), whole)).otherwise(0).cast("long").alias("w"))
    words = words.groupBy(key, "n", "base").agg(F.bit_or("w").alias("w"))
    # step 0: within the word; i > 0: to member i + 5, whose bit of base is i - 1
    met = words.withColumn("step", F.explode(F.expr("sequence(0, greatest(n - 6, 0))"))).withColumn("bit", F.expr("if(step = 0, 0L, shiftleft(1L, step - 1))"))
    with_it = F.col("base").bitwiseAND(F.col("bit")) != 0
    met = met.groupBy(key, "n", F.expr("base & ~bit").alias("base"), "step").agg(F.bit_or(F.when(~with_it, F.col("w")).otherwise(0)).alias("low"), F.bit_or(F.when(with_it, F.col("w")).otherwise(0)).alias("high"))

    def within(lost: bool) -> Column:
        out = F.lit(0).cast("long")
        for i in range(6):
            without = sum(1 << m for m in range(64) if not m >> i & 1)
            after = F.shiftrightunsigned("low", 1 << i)
            changed = F.col("low").bitwiseAND(F.bitwise_not(after)) if lost else F.bitwise_not("low").bitwiseAND(after)
            out = out.bitwiseOR(F.when(F.col("n") > i, changed.bitwiseAND(F.lit(without).cast("long"))).otherwise(0))
        return out

    inside = F.col("step") == 0
    both = met.select(key, "n", "base", F.when(inside, within(True)).otherwise(F.expr("low & ~high")).alias("lost"), F.when(inside, within(False)).otherwise(F.expr("~low & high")).alias("gained"))
    of_size = [sum(1 << m for m in range(64) if m.bit_count() == j) for j in range(7)]
    sizes = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(x - (x >> 63 << 64)).cast("long").alias("x")) for j, x in enumerate(of_size)]))
    each = both.withColumn("size", sizes).withColumn("k", F.bit_count("base") + F.col("size.j")).filter("k BETWEEN 1 AND n - 1")
    hit = lambda c: F.max((F.col(c).bitwiseAND(F.col("size.x")) != 0).cast("int"))
    return each.groupBy(key, "k").agg(hit("lost").alias("down"), hit("gained").alias("up"))


def ones_and_pairs(groups: DataFrame, classes: int, digits: int | None = None, photos: str = "photos") -> DataFrame:
    """The part of pooled_subsets with k of 1 and 2, of groups of any size: k and p, without masks, n (n + 1) / 2 rows a group."""
    flat = F.flatten(F.transform(photos, lambda x: x["p"]))
    each = groups.withColumn("n", F.size(photos)).withColumn("flat", flat).drop(photos).filter("n > 0").withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("j", F.explode(F.expr("sequence(i, n - 1)")))
    # i = j is a member by itself: (x + x) / 2 is x
    mean = [(F.get("flat", F.col("i") * classes + c) + F.get("flat", F.col("j") * classes + c)) / 2 for c in range(classes)]
    return each.withColumn("k", F.when(F.col("i") == F.col("j"), 1).otherwise(2)).withColumn("p", F.array(*[rounded(m, digits) if digits else m for m in mean])).drop("flat", "i", "j")


def pairs_within(photos: Column) -> Column:
    """All unordered pairs (i < j) of an array's members, as structs (a, b)."""
    n = F.size(photos)
    rows = F.transform(photos, lambda x, i: F.transform(F.slice(photos, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return F.flatten(rows)


def samples(groups: DataFrame, key: str, k: int, mode: str, seed: int = 0, epoch: int = 0, ids: str = "ids") -> DataFrame:
    """key, photo_ids: the k-subsets of a group's ids that a training pass takes: all (exhaustive), the first, or one at random by stable key. Groups with fewer than k ids have none."""
    plan = budget_plan(groups, key, [k], seed, ids=ids)
    if mode == "exhaustive":
        return plan.select(key, "photo_ids")
    packed = plan.groupBy(key).agg(F.array_sort(F.collect_list("photo_ids")).alias("all"))
    if mode == "first":
        at = F.lit(0)
    elif mode == "random":
        draw = F.conv(F.substring(stable_hex(F.lit(seed), F.lit(epoch), F.col(key)), 1, 12), 16, 10).cast("long")
        at = (draw % F.size("all")).cast("int")
    else:
        raise ValueError(f"unknown mode {mode}")
    return packed.select(key, F.get("all", at).alias("photo_ids"))


def prediction_frame(scored: DataFrame, key: str, ids: Column, prediction: Column) -> DataFrame:
    """Subset predictions in their exchange form: key, budget, label, prediction, photo_ids as text, probabilities as JSON."""
    return scored.select(key, F.col("k").alias("budget"), "label", prediction.alias("prediction"), F.array_join(F.transform(members(ids, F.col("mask")), lambda x: x.cast("string")), ";").alias("photo_ids"), F.to_json("p").alias("probabilities_json"))


def record_faults(records: DataFrame, groups: DataFrame, key: str, classes: int) -> DataFrame:
    """key, photo_ids, fault of stored predictions against groups (key, ids, label): unknown group, wrong size, foreign member, wrong label, and the vector's own faults."""
    from lattica.functions.scalars import ids_of_text, vector_of_json
    from lattica.functions.scoring import faults

    both = records.join(groups.select(key, "ids", F.col("label").alias("true_label")), key, "left")
    own = ids_of_text(F.col("photo_ids"))
    p = vector_of_json(F.col("probabilities_json"))
    checks = {"foreign_member": F.size(F.array_except(own, F.coalesce("ids", F.expr("array()")))) > 0, "unknown_group": F.col("ids").isNull(), "wrong_label": F.col("label") != F.col("true_label"), "wrong_size": (F.size(own) != F.col("budget")) | (F.size(F.array_distinct(own)) != F.size(own))}
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return both.select(key, "photo_ids", F.explode(F.concat(found, faults(p, F.col("prediction"), classes))).alias("fault"))

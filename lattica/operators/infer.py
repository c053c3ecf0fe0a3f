"""Resampling inference: influence tables by DataFrame operations, draws as rows of a plan.

What enters a draw is a few numbers a cluster (an observer), already summed; clusters are in
chunks of bounded size, each giving its part of every draw, and the percentiles of the draws'
sums are aggregates. Only `label_interval` has a row as long as its group has labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.numbering import checkpoints

#: Draws that one row of a plan makes.
DRAW_BLOCK = 64
#: Clusters that one row of draws holds, about.
CHUNK = 8192
#: Rows up to which a table of labels or by-groups is broadcast.
FEW = 100_000


def _label_parts(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str]) -> DataFrame:
    """by, cluster, label, s and n (sum and rows of the cell), label_s and label_n (of its label), labels (of its by): partial sums a cell, no window over a label."""
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, label, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    per_label = cells.groupBy(*by, label).agg(F.sum("s").alias("label_s"), F.sum("n").alias("label_n"))
    kinds = per_label.groupBy(*by).agg(F.count("*").alias("labels"))
    known = per_label.join(kinds, list(by)) if by else per_label.crossJoin(F.broadcast(kinds))  # one row
    return cells.join(known, [*by, label])


def influence(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """by, cluster, influence: of the label-macro mean, summed a cluster."""
    part = (F.col("s") - F.col("n") * F.col("label_s") / F.col("label_n")) / F.col("label_n") / F.col("labels")
    return _label_parts(rows, value, label, cluster, by).groupBy(*by, cluster).agg(F.sum(part).alias("influence"))


def contributions(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """by, cluster, contribution: each cluster's share of the label-macro mean; they add up to it. What a sign-flip test flips."""
    part = F.col("s") / F.col("label_n") / F.col("labels")
    return _label_parts(rows, value, label, cluster, by).groupBy(*by, cluster).agg(F.sum(part).alias("contribution"))


def macro_mean(rows: DataFrame, value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, label).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("estimate"))


def _packed(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """by, clusters and an array of each of the values, in one order; a row a by-group, as long as it has clusters."""
    one = rows.groupBy(*by).agg(F.count("*").alias("clusters"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *values))).alias("all"))
    return one.select(*by, "clusters", *[F.col(f"all.{v}").alias(v) for v in values])


def _dealt(packed: DataFrame, by: Sequence[str], draws: Column) -> DataFrame:
    """A row a block of draws, spread over the tasks: `first` draw and `last` (one behind)."""
    starts = F.sequence(F.lit(0).cast("long"), draws.cast("long") - 1, F.lit(DRAW_BLOCK).cast("long"))
    blocks = packed.withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + DRAW_BLOCK, draws.cast("long")))
    return blocks.repartition(*by, "first")


def _picks(seed: int, draw: int, n: int) -> np.ndarray:
    """The clusters of one draw with replacement; every draw has a generator of its own, so that blocks may run anywhere."""
    return np.random.default_rng((seed, draw)).integers(0, n, n)


def _beside(rows: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """The join with a checkpointed table of a row a label or by-group, which are few keys for many rows: broadcast up to FEW rows, so that no key is a task."""
    return rows.join(F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small, list(on))


def _chunks(each: DataFrame, by: Sequence[str], key: Column, order: str, values: Sequence[str]) -> DataFrame:
    """by, clusters, sizes, at, and an array of each of the values: the rows (one a cluster, checkpointed) in chunks of about CHUNK by a hash of the key; sizes of the by-group's chunks and the place of this one among them. Up to CHUNK rows are one chunk."""
    n = each.groupBy(*by).agg(F.count("*").alias("clusters")).checkpoint()
    placed = _beside(each, n, by).withColumn("chunk", F.pmod(F.xxhash64(key), F.ceil(F.col("clusters") / CHUNK)))
    counted = placed.groupBy(*by, "chunk").agg(F.count("*").alias("size"))
    sizes = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "size"))).alias("sizes")).checkpoint()
    packed = placed.groupBy(*by, "clusters", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *values))).alias("all"))
    at = (F.array_position("sizes.chunk", F.col("chunk")) - 1).cast("int")
    return _beside(packed, sizes, by).select(*by, "clusters", at.alias("at"), F.col("sizes.size").alias("sizes"), *[F.col(f"all.{v}").alias(v) for v in values])


def _times(seed: int, first: int, last: int, sizes: np.ndarray, at: int) -> np.ndarray:
    """A row a draw: how often it takes each cluster of a chunk when as many clusters as there are are drawn with replacement. How many fall into each chunk is a multinomial draw that every chunk repeats; within one they are uniform."""
    n, m = int(sizes.sum()), int(sizes[at])
    if len(sizes) == 1:
        return np.stack([np.bincount(_picks(seed, d, n), minlength=n) for d in range(first, last)]).astype(float)
    own = [int(np.random.default_rng((seed, d)).multinomial(n, sizes / n)[at]) for d in range(first, last)]
    return np.stack([np.bincount(np.random.default_rng((seed, d, at + 1)).integers(0, m, k), minlength=m) for d, k in zip(range(first, last), own, strict=True)]).astype(float)


def _drawn(chunks: DataFrame, by: Sequence[str], values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """by, draw, sums: of each number of the arrays (and arrays of arrays) `values` over the clusters of a draw. Chunks give partial sums, so no task holds a by-group."""

    @F.pandas_udf("array<array<double>>")
    def partial(sizes: pd.Series, at: pd.Series, x: pd.DataFrame) -> pd.Series:
        out = []
        for z, a, *columns in zip(sizes, at, *[x[v] for v in values], strict=True):
            m = np.hstack([np.stack(c).astype(float).reshape(len(c), -1) for c in columns])
            out.append(list(np.vstack([_times(seed, f, min(f + DRAW_BLOCK, draws), np.asarray(z), int(a)) @ m for f in range(0, draws, DRAW_BLOCK)])))
        return pd.Series(out)

    return _summed(chunks.select(*by, F.posexplode(partial("sizes", "at", F.struct(*values))).alias("draw", "sums")), by)


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, draw, sums: partial sums of chunks, added place by place."""
    each = parts.select(*by, "draw", F.posexplode("sums").alias("place", "v")).groupBy(*by, "draw", "place").agg(F.sum("v").alias("v"))
    return each.groupBy(*by, "draw").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("all")).select(*by, "draw", F.col("all.v").alias("sums"))


def _percentiles(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, low, high, status of drawn values `v`: EMPIRICAL_DEGENERATE where they do not differ."""
    ends = values.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), (F.max("v") - F.min("v")).alias("range"))
    return ends.select(*by, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.when(F.col("range") < 1e-14, "EMPIRICAL_DEGENERATE").otherwise("OK").alias("status"))


def cluster_interval(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str], draws: int = 5000, seed: int = 0) -> DataFrame:
    """by, estimate, low, high, clusters, status: percentile interval of the label-macro mean when clusters are drawn with replacement: the estimate moves by the influence of those drawn. Fewer than two clusters: NOT_ESTIMABLE; no width: EMPIRICAL_DEGENERATE. Clusters are drawn in chunks, whose sums a draw are added."""
    known, each = _shares(rows, value, label, cluster, by)
    return _interval(known, each, cluster, by, draws, seed)


def _shares(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(by, label, label_s, label_n, labels; by, cluster, influence, contribution), both checkpointed: one pass over the rows."""
    checkpoints(rows.sparkSession)
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, label, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n")).checkpoint()
    per_label = cells.groupBy(*by, label).agg(F.sum("s").alias("label_s"), F.sum("n").alias("label_n")).checkpoint()
    known = per_label.join(per_label.groupBy(*by).agg(F.count("*").alias("labels")), list(by)).checkpoint()
    flows = (F.col("s") - F.col("n") * F.col("label_s") / F.col("label_n")) / F.col("label_n") / F.col("labels")
    share = F.col("s") / F.col("label_n") / F.col("labels")
    return known, _beside(cells, known, [*by, label]).groupBy(*by, cluster).agg(F.sum(flows).alias("influence"), F.sum(share).alias("contribution")).checkpoint()


def _interval(known: DataFrame, each: DataFrame, cluster: str, by: Sequence[str], draws: int, seed: int) -> DataFrame:
    points = known.groupBy(*by).agg(F.avg(F.col("label_s") / F.col("label_n")).alias("estimate")).join(each.groupBy(*by).agg(F.count("*").alias("clusters")), list(by)).checkpoint()
    chunks = _chunks(each, by, F.col(cluster), cluster, ["influence"]).filter("clusters > 1")
    drawn = _beside(_drawn(chunks, by, ["influence"], draws, seed), points, by).select(*by, (F.col("estimate") + F.get("sums", F.lit(0))).alias("v"))
    out = points.join(_percentiles(drawn, by), list(by), "left")
    return out.select(*by, "estimate", "low", "high", "clusters", F.coalesce("status", F.lit("NOT_ESTIMABLE")).alias("status"))


def label_interval(rows: DataFrame, value: str, label: str, by: Sequence[str], draws: int = 5000, seed: int = 0) -> DataFrame:
    """by, estimate, low, high, labels: percentile interval of the mean of label means when labels are drawn with replacement. A by-group without rows has no row."""
    means = rows.groupBy(*by, label).agg(F.avg(value).alias("m")).filter("m IS NOT NULL")
    packed = _packed(means, by, label, ["m"]).withColumn("estimate", F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / F.col("clusters"))

    @F.pandas_udf("array<double>")
    def mean(x: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([[v[_picks(seed, d, len(v))].mean() for d in range(a, b)] for v, a, b in zip(x, first, last, strict=True)])

    drawn = _dealt(packed, by, F.lit(draws)).select(*by, F.explode(mean("m", "first", "last")).alias("v"))
    return packed.join(_percentiles(drawn, by), list(by)).select(*by, "estimate", "low", "high", F.col("clusters").alias("labels"))


def signflip_exact(rows: DataFrame, value: str, most: int = 13) -> DataFrame:
    """n, p: share of all 2^n sign patterns whose absolute sum reaches the observed one. One row; the rows are one a cluster and at most `most`."""
    packed = rows.agg(F.array_sort(F.collect_list(value)).alias("x")).withColumn("n", F.size("x"))
    checked = packed.withColumn("x", F.when(F.col("n") <= most, F.col("x")).otherwise(F.raise_error(F.lit(f"more than {most} clusters need draws")).cast("array<double>")))
    masks = checked.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, n)") - 1)))
    flipped = F.aggregate(F.transform("x", lambda v, i: F.when(F.getbit(F.col("mask"), i) == 1, v).otherwise(-v)), F.lit(0.0), lambda a, v: a + v)
    seen = F.abs(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return masks.select("n", (F.abs(flipped) >= seen - 1e-12).alias("extreme")).groupBy("n").agg((F.sum(F.col("extreme").cast("double")) / F.count("*")).alias("p"))


def signflip(rows: DataFrame, value: str, by: Sequence[str], draws: int = 9999, seed: int = 0, exact_up_to: int = 13, cluster: str | None = None) -> DataFrame:
    """by, n, p, error: two-sided sign-flip test of a sum. Up to exact_up_to rows every sign pattern is a draw; beyond, p = (1 + extreme) / (1 + draws) with the Monte-Carlo error of draws + 1. Rows are flipped in chunks (by `cluster`, if given, a key of the rows), whose sums a draw are added."""
    checkpoints(rows.sparkSession)
    each = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("x"), (F.col(cluster) if cluster else F.monotonically_increasing_id()).alias("_key")).checkpoint()
    seen = each.groupBy(*by).agg(F.count("*").alias("clusters"), F.sum("x").alias("seen")).checkpoint()

    @F.pandas_udf("array<double>")
    def flipped(sizes: pd.Series, at: pd.Series, x: pd.Series) -> pd.Series:
        def sums(z: np.ndarray, a: int, v: np.ndarray) -> np.ndarray:
            n = len(v)
            if z.sum() <= exact_up_to:
                return v.sum() - 2 * (((np.arange(1 << n)[:, None] >> np.arange(n)) & 1) @ v)
            own = () if len(z) == 1 else (a + 1,)
            return np.array([v.sum() - 2 * (np.random.default_rng((seed, d, *own)).integers(0, 2, n, np.int64 if not own else np.int8) @ v) for d in range(draws)])

        return pd.Series([sums(np.asarray(z), int(a), np.asarray(v)) for z, a, v in zip(sizes, at, x, strict=True)])

    exact = F.col("clusters") <= exact_up_to
    total = F.when(exact, F.pow(F.lit(2.0), F.col("clusters")).cast("long")).otherwise(F.lit(draws))
    parts = _chunks(each, by, F.col("_key"), "x", ["x"]).select(*by, F.posexplode(flipped("sizes", "at", "x")).alias("draw", "v"))
    summed = _beside(parts.groupBy(*by, "draw").agg(F.sum("v").alias("v")), seen, by)
    found = summed.groupBy(*by).agg(F.count_if(F.abs("v") >= F.abs("seen") - 1e-12).alias("extreme"))
    p = F.when(exact, F.col("extreme") / total).otherwise((F.col("extreme") + 1) / F.lit(1.0 + draws))
    both = seen.join(found, list(by)).withColumn("p", p)
    return both.select(*by, F.col("clusters").alias("n"), "p", F.when(exact, 0.0).otherwise(F.sqrt(F.col("p") * (1 - F.col("p")) / F.lit(1.0 + draws))).alias("error"))


def paired_records(rows: DataFrame, transitions: Sequence[tuple[int, int]], group: str, label: str, cluster: str, size: str, value: str) -> DataFrame:
    """from, to, group, label, cluster, delta of groups that have both sizes; one pivot, no self-join. A transition without groups has no row."""
    wide = rows.groupBy(group, label, cluster).agg(*[F.max(F.when(F.col(size) == k, F.col(value))).alias(f"v{k}") for k in sorted({k for t in transitions for k in t})])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), (F.col(f"v{b}") - F.col(f"v{a}")).alias("delta")) for a, b in transitions]))
    return wide.select(group, label, cluster, each.alias("t")).select("t.from", "t.to", group, label, cluster, "t.delta").filter("delta IS NOT NULL")


def paired_inference(pairs: DataFrame, label: str, cluster: str, transitions: Sequence[tuple[int, int]], draws: int = 2000, seed: int = 0) -> DataFrame:
    """A row a transition, estimable or not: estimate, interval and sign-flip p (1 where not estimable)."""
    spark = pairs.sparkSession
    skeleton = spark.createDataFrame([(a, b) for a, b in transitions], "`from` int, `to` int")
    known, each = _shares(pairs, "delta", label, cluster, ["from", "to"])
    intervals = _interval(known, each, cluster, ["from", "to"], draws, seed)
    flips = signflip(each, "contribution", ["from", "to"], draws, seed, cluster=cluster)
    both = skeleton.join(intervals, ["from", "to"], "left").join(flips.select("from", "to", "p"), ["from", "to"], "left")
    return both.withColumn("status", F.coalesce("status", F.lit("NOT_ESTIMABLE"))).withColumn("p", F.when(F.col("status") == "NOT_ESTIMABLE", F.lit(1.0)).otherwise(F.col("p")))


def group_bootstrap(rows: DataFrame, label: str, by: Sequence[str], metric: Callable[[pd.DataFrame], float], draws: int = 500, seed: int = 0) -> DataFrame:
    """by, low, high of any metric under resampling of rows within labels; a by-group must fit a task."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.Generator(np.random.PCG64(seed))
        f = f.sort_values(list(f.columns)).reset_index(drop=True)
        parts = [i.to_numpy() for _, i in f.groupby(label).groups.items()]
        values = [metric(f.iloc[np.concatenate([rng.choice(p, len(p)) for p in parts])]) for _ in range(draws)]
        low, high = np.percentile(values, [2.5, 97.5])
        return pd.DataFrame([{b: f[b].iloc[0] for b in by} | {"low": low, "high": high}])

    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", low double, high double")


def random_subsets(labels: DataFrame, value: str, sizes: Sequence[int], repeats: int = 100, seed: int = 0) -> DataFrame:
    """size, repeat, mean of that many labels drawn without replacement; labels are one row each, gathered as one array."""
    packed = labels.agg(F.array_sort(F.collect_list(value)).alias("x"))
    spark = labels.sparkSession
    plan = spark.createDataFrame([(s, r) for s in sizes for r in range(repeats)], "size int, repeat int")

    @F.pandas_udf("double")
    def drawn(x: pd.Series, size: pd.Series, repeat: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.Generator(np.random.PCG64([seed, s, r])).choice(v, s, replace=False).mean()) if s <= len(v) else None for v, s, r in zip(x, size, repeat, strict=True)])

    return plan.crossJoin(F.broadcast(packed)).select("size", "repeat", drawn("x", "size", "repeat").alias("mean"))


def metric_intervals(components: DataFrame, by: Sequence[str], cluster: str, label: str, means: Sequence[str], bins: Sequence[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """by, metric, estimate, low, high, status: percentile intervals of several metrics at once from additive parts (a row a group) when clusters are drawn with replacement. macro_<first mean> is the mean of label means: the labels stay fixed and the estimate moves by the influence of the clusters drawn. The others are ratios whose denominators are drawn too: means over groups, and ece, the sum of absolute bin means. Clusters are drawn in chunks, whose sums a draw are added."""
    names = [f"macro_{means[0]}", *means, *(["ece"] if bins else [])]
    parts = [*means, *bins]
    checkpoints(components.sparkSession)
    number = lambda c: F.col(c).cast("double")
    totals = [x for i, c in enumerate(parts) for x in (F.sum(number(c)).alias(f"s_{i}"), F.count(c).alias(f"n_{i}"))]
    per_label = components.groupBy(*by, label).agg(*totals).checkpoint()
    first, first_n = F.col("s_0"), F.col("n_0")
    known = per_label.join(per_label.groupBy(*by).agg(F.count_if(first_n > 0).alias("_labels")), list(by)).select(*by, label, (first / F.nullif(first_n, F.lit(0))).alias("_m"), first_n.alias("_n"), "_labels").checkpoint()
    flows = (number(means[0]) - F.col("_m")) / F.col("_n") / F.col("_labels")
    rows = _beside(components, known, [*by, label])
    each = rows.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.array(*[F.sum(number(c)) for c in parts]).alias("sums"), F.sum(flows).alias("influence")).filter("influence IS NOT NULL").checkpoint()
    mean = lambda i: F.sum(f"s_{i}") / F.sum(f"n_{i}")
    ece = [sum((F.abs(mean(len(means) + i)) for i in range(len(bins))), F.lit(0.0))] if bins else []
    total = per_label.groupBy(*by).agg(F.array(F.avg(first / F.nullif(first_n, F.lit(0))), *[mean(i) for i in range(len(means))], *ece).alias("point"))
    points = total.join(each.groupBy(*by).agg(F.count("*").alias("clusters")), list(by)).checkpoint()
    chunks = _chunks(each, by, F.col(cluster), cluster, ["n", "sums", "influence"]).filter("clusters > 1")
    drawn = _beside(_drawn(chunks, by, ["n", "sums", "influence"], draws, seed), points, by)
    ratio = lambda i: F.get("sums", F.lit(1 + i)) / F.get("sums", F.lit(0))
    spread = [sum((F.abs(ratio(len(means) + i)) for i in range(len(bins))), F.lit(0.0))] if bins else []
    moved = F.get("point", F.lit(0)) + F.get("sums", F.lit(1 + len(parts)))
    draw = drawn.select(*by, F.posexplode(F.array(moved, *[ratio(i) for i in range(len(means))], *spread)).alias("place", "v"))
    ends = _percentiles(draw, [*by, "place"])
    at = points.select(*by, F.posexplode("point").alias("place", "estimate"))
    named = at.join(ends, [*by, "place"], "left").withColumn("metric", F.get(F.array(*map(F.lit, names)), F.col("place")))
    return named.select(*by, "metric", "estimate", "low", "high", F.coalesce("status", F.lit("NOT_ESTIMABLE")).alias("status"))

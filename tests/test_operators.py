"""Operators on small frames with known answers, odd rows included."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import scalars as V
from lattica.functions import scoring as S
from lattica.functions import urls
from lattica.operators import aggregators, dedup, gates, infer, joins, lineage, macro, regroup, select, strata, subsets
from lattica.sources import readers, writers
from lattica.streaming import fold


def one(df):
    return df.collect()[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v"))).v


def lit(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


# Subsets and scores


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(1, 0, [[0.9, 0.1], [0.3, 0.7]]), (2, 1, [[0.2, 0.8], [0.6, 0.4], [0.1, 0.9]])]
    df = spark.createDataFrame([(g, y, [(i, p) for i, p in enumerate(ps)]) for g, y, ps in rows], "g long, label int, photos array<struct<i: int, p: array<double>>>")
    s = subsets.pooled(subsets.with_subsets(df), 2)
    return s.withColumn("correct", S.correct(F.col("p"), F.col("label")))


def test_lattice(toy):
    assert toy.count() == 3 + 7
    assert {(r.g, r.k): r.a for r in toy.groupBy("g", "k").agg(F.avg("correct").alias("a")).collect()} == {(1, 1): 0.5, (1, 2): 1.0, (2, 1): pytest.approx(2 / 3), (2, 2): 1.0, (2, 3): 1.0}
    e = subsets.edges(toy, "g", ["correct"])
    assert {(r.g, r.k): r["count"] for r in e.groupBy("g", "k").count().collect()} == {(1, 1): 2, (2, 1): 6, (2, 2): 3}
    net = {(r.g, r.k): r.net for r in e.groupBy("g", "k").agg(F.avg(F.col("high_correct") - F.col("low_correct")).alias("net")).collect()}
    assert net[1, 1] == pytest.approx(0.5) and net[2, 1] == pytest.approx(1 / 3)


def test_coverage(toy):
    rows = toy.select("g", "mask", F.size("photos").alias("n"))
    broken = rows.filter("NOT (g = 1 AND mask = 2)").unionAll(rows.filter("g = 2 AND mask = 5")).unionAll(rows.limit(1).select(F.lit(2).cast("long"), F.lit(99).cast("long"), F.lit(3)))
    bad = subsets.coverage_faults(broken, rows.select("g", "n").distinct(), "g").collect()
    assert {tuple(r) for r in bad} == {(1, 2, 0, True), (2, 5, 2, True), (2, 99, 1, False)}


def test_macro_ignores_missing(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, 0.0), (1, 1, None)], "k int, label int, a double")
    assert one(macro.macro(df, ["k"], ["a"])).macro_a == 0.5


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=4, max_size=4), st.integers(0, 3))
def test_scores_match_numpy(spark, raw, y):
    p = np.array(raw, float) + 0.0
    p = p / p.sum() if p.sum() else np.full(4, 0.25)
    v, c = lit(*p), F.lit(y)
    row = one(spark.range(1).select(S.argmax(v).alias("a"), S.nll(v, c).alias("n"), S.brier(v, c).alias("b"), S.rank_of(v, c).alias("r")))
    assert row.a == int(p.argmax())
    assert row.n == pytest.approx(-math.log(max(1e-12, p[y])))
    assert row.b == pytest.approx(((p - np.eye(4)[y]) ** 2).sum())
    assert row.r == 1 + sorted(range(4), key=lambda i: (-p[i], i)).index(y)


def test_bins_clamp(spark):
    assert [value(spark, S.floor_bin(F.lit(x), 15)) for x in (0.0, 0.5, 1.0)] == [0, 7, 14]
    assert [value(spark, S.edge_bin(F.lit(x), 10)) for x in (0.0, 0.1, 0.95, 1.0)] == [0, 1, 9, 9]


def test_faults(spark):
    f = lambda *p, pred=0: value(spark, S.faults(lit(*p), F.lit(pred), 2))
    assert f(0.7, 0.3) == [] and f(0.3, 0.7) == ["argmax"] and f(0.7, 0.7) == ["sum"] and f(1.5, -0.5) == ["outside"]
    assert "not_finite" in f(float("nan"), 0.5) and "length" in f(1.0)
    assert value(spark, S.faults(F.lit(None).cast("array<double>"), F.lit(0), 2)) == ["unreadable"]


def test_top_classes(spark):
    assert value(spark, S.top_classes(lit(0.2, 0.5, 0.2, 0.1), 3)) == "1;0;2"


# Scalars


def test_keys(spark):
    import hashlib

    want = int(hashlib.sha256(b"7|a|3").hexdigest()[:16], 16)
    assert value(spark, V.stable_key(F.lit(7), F.lit("a"), F.lit(3))) == want
    assert value(spark, V.stable_jitter(F.lit("x"))) == pytest.approx(int(hashlib.sha256(b"x").hexdigest()[:16], 16) / 2**64)


def test_parsing(spark):
    assert [value(spark, V.whole_number(F.lit(x))) for x in ("123.0", "7", "1.5", "x", "NaN", "")] == [123, 7, None, None, None, None]
    assert value(spark, V.identity_number(F.lit(" "))) is None
    assert value(spark, V.instant(F.lit("2024-01-01T00:00:00Z"))) is not None and value(spark, V.instant(F.lit("2024-01-01T00:00:00"))) is None
    assert value(spark, V.vector_of_json(F.lit("[0.5, 0.5]"))) == [0.5, 0.5] and value(spark, V.vector_of_json(F.lit("[1,"))) is None
    assert value(spark, V.ids_of_text(F.lit("3;1;2"))) == [1, 2, 3] and value(spark, V.text_of_ids(F.array(F.lit(1), F.lit(2)))) == "1;2"


def test_urls(spark):
    hosts = ("static.example.org",)
    assert value(spark, urls.large_url(F.lit("https://static.example.org/p/1/square.jpg?7"), hosts)) == "https://static.example.org/p/1/large.jpg"
    assert value(spark, urls.large_url(F.lit("http://static.example.org/p/1/square.jpg"), hosts)) is None
    assert value(spark, urls.resized(F.lit("https://x.org/1/medium.jpeg?a=1"))) == "https://x.org/1/large.jpeg?a=1"
    assert value(spark, urls.resized(F.lit("https://x.org/1/medium."), need_extension=False)) == "https://x.org/1/large."
    assert value(spark, urls.resized(F.lit("https://x.org/1/medium."))) is None and value(spark, urls.resized(F.lit("https://x.org/1/medium"), need_extension=False)) is None
    assert value(spark, urls.resized(F.lit("https://x.org/1/original.jpg"))) is None
    for leaf, want in [("small.webp", "large.webp"), ("original.JPG", "large.JPG"), ("square.", "large."), ("square", None), ("huge.jpg", None), ("small.tiff", None), ("small.jpg.png", None)]:
        assert value(spark, urls.large_url(F.lit(f"https://static.example.org/p/1/{leaf}?x=1#y"), hosts)) == (want and f"https://static.example.org/p/1/{want}")
    assert value(spark, urls.large_url(F.lit("https://other.org/p/1/small.jpg"), hosts)) is None
    assert value(spark, urls.resized(F.lit("https://x.org/1/huge.jpg"))) is None
    assert value(spark, urls.api_url("https://x.org/o", q=F.lit("a b"), page=F.lit(2))) == "https://x.org/o?q=a+b&page=2"


def test_vectors(spark):
    assert sum(value(spark, V.softmax(lit(1, 2, 3)))) == pytest.approx(1)
    assert value(spark, V.cosine(lit(1, 0), lit(1, 1))) == pytest.approx(2**-0.5)
    assert value(spark, V.hamming(F.lit(5).cast("long"), F.lit(6).cast("long"))) == 2
    assert value(spark, V.hash_from_hex(F.lit("ffffffffffffffff"))) == -1 and value(spark, V.hash_from_hex(F.lit("xyz"))) is None


def test_zscore(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 2.0), (3, 2.0)], "g int, x double")
    assert sorted((r.g, r.z) for r in df.select("g", V.zscore(F.col("x"), "g").alias("z")).collect()) == [(1, -1), (1, 1), (2, 0), (3, 0), (3, 0)]


# Gates, joins, strata


def test_gates(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, 10, " "), (2, 11, None)], "id int, g int, t string")
    assert {r.gate for r in gates.report([gates.unique(df, ["id"]), gates.not_blank(df, "id", ["t"]), gates.constant_in_group(df, "id", ["g"]), gates.size_between(df, "g", 2, 5), gates.failing(df, "t", "id", F.col("t") == "a")]).collect()} == {"unique_id", "not_blank", "constant_in_group", "size_between", "t"}
    with pytest.raises(ValueError, match="unique_id"):
        gates.require(gates.unique(df, ["id"]))
    gates.require(gates.unique(df, ["id", "g"]))
    assert one(gates.decision({"a": gates.unique(df, ["id", "g"]), "b": gates.unique(df, ["id"])})).verdict == "STOP_B"
    assert gates.disjoint(df, df.filter("id = 1"), "id").count() == 1


def test_seed_table(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6)], "g int, a double")
    out, bad = joins.seed_table([df, df, df.limit(1)], ["g"], 3)
    assert out.count() == 5 and bad.count() == 1


def test_holm(spark):
    df = spark.createDataFrame([(0.01, 1), (0.04, 2), (0.03, 3), (None, 4)], "p double, id int").withColumn("f", F.lit(0))
    got = {r.id: r.adjusted for r in strata.holm(df, "p", ["f"], ["id"]).collect()}
    assert got[4] is None and [got[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06])
    assert strata.complete_families(df, ["f"], 3).count() == 1


def test_quantile_bin_matches_right_closed(spark):
    xs = [1, 1, 1, 2, 3, 4, 4, 9]
    df = strata.quantile_bin(spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double"), "x", 4)
    edges = sorted(set(np.quantile(xs, [0, 0.25, 0.5, 0.75, 1])))
    want = [max(1, sum(e < x for e in edges)) for x in xs]
    got = sorted(((r.x, r.bin) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [b for _, b in got] == [*sorted(want), None]


def test_within_correlation_guards(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 4.0)], "l int, x double, y double")
    assert one(strata.within_correlation(df, "x", "y", "l")).r is None


# Regrouping


def test_cross_groups_is_a_clean_mapping(spark):
    rows = [(g, g * 10 + j, j, 0, 3) for g in range(7) for j in range(3)] + [(90, 900, 0, 1, 1)]
    m = spark.createDataFrame(rows, "g long, photo long, r int, label int, n int")
    for seed in (None, 4):
        mapping = regroup.cross_groups(m, "g", "photo", "r", ["label", "n"], seed)
        assert mapping.count() == 21
        assert regroup.mapping_faults(mapping, m.filter("g < 90"), "g", "photo", "label").count() == 0
    bad = mapping.withColumn("donor", F.when(F.col("slot") == 1, 1).otherwise(F.col("donor")))
    assert {r.gate for r in regroup.mapping_faults(bad, m.filter("g < 90"), "g", "photo", "label").collect()} >= {"own_member"}
    assert regroup.circular_groups(m, "g", ["label", "n"]).count() == 7
    assert regroup.repeats(m, "g", "photo", "r", ["label", "n"], [1, 2]).count() == 42


# Near duplicates


def test_near_pairs_lose_nothing(spark):
    rng = np.random.default_rng(0)
    hashes = rng.integers(-(1 << 62), 1 << 62, 30)
    hashes = np.concatenate([hashes, hashes[:10] ^ (1 << 5), hashes[:10] ^ (np.int64(3) << 40)])
    df = spark.createDataFrame([(i, int(h)) for i, h in enumerate(hashes)], "id long, hash long")
    want = {(a, b) for a, b in itertools.combinations(range(len(hashes)), 2) if bin((int(hashes[a]) ^ int(hashes[b])) & (2**64 - 1)).count("1") <= 4}
    assert {(r.a, r.b) for r in dedup.near_pairs(df, df, 4).collect()} == want


def test_components(spark):
    nodes = spark.range(1, 9).toDF("id")
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 6), (6, 7), (7, 8)], "a long, b long")
    assert {r.id: r.root for r in dedup.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}
    with pytest.raises(ValueError):
        dedup.components(nodes, spark.createDataFrame([(1, 99)], "a long, b long"))


def test_cover_is_least():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 7
        pairs = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(9)})
        w = {i: int(rng.integers(1, 9)) for i in range(n) if any(i in p for p in pairs)}
        chosen, exact = dedup.cover(pairs, w)
        best = min(sum(w[i] for i in s) for k in range(n + 1) for s in itertools.combinations(w, k) if all(set(p) & set(s) for p in pairs))
        assert exact and all(set(p) & chosen for p in pairs) and sum(w[i] for i in chosen) == best


def test_cover_of_a_large_component_is_exact_or_said_not_to_be():
    # a path of 300 vertices, and a ring of 60 with chords
    path = [(i, i + 1) for i in range(299)]
    chosen, exact = dedup.cover(path, dict.fromkeys(range(300), 1.0))
    assert exact and len(chosen) == 150
    ring = [tuple(sorted((i, (i + d) % 60))) for i in range(60) for d in (1, 2)]
    chosen, exact = dedup.cover(sorted(set(ring)), dict.fromkeys(range(60), 1.0))
    assert exact and len(chosen) == 40
    chosen, exact = dedup.cover(sorted(set(ring)), dict.fromkeys(range(60), 1.0), 1)
    assert not exact and all(set(p) & chosen for p in ring)


def test_vertex_cover(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    nodes = spark.createDataFrame([(i, 1.0) for i in (1, 2, 3, 7, 8)], "id long, weight double")
    got = dedup.vertex_cover(edges, dedup.components(nodes, edges), nodes).filter("chosen").collect()
    assert {r.id for r in got if r.id < 5} == {2} and len(got) == 2


def test_hashes_have_two_polarities():
    x = np.tile(np.arange(9), (8, 1))
    assert dedup.difference_hash(x) == 2**64 - 1 and dedup.difference_hash(x, False) == 0


def test_images(spark):
    pixels = [float(i % 18) * 14 for i in range(16 * 18)]
    df = spark.createDataFrame([(1, pixels, 18, 16)], "id int, pixels array<double>, width int, height int")
    assert one(dedup.hash_images(df, "id")).hash == -1
    assert one(dedup.image_proxies(df, "id")).energy > 0


# Inference


def test_signflip(spark):
    for xs, p in (([1.0, 1.0], 0.5), ([1.0, -1.0], 1.0), ([1.0, 2.0, 3.0], 0.25)):
        df = spark.createDataFrame([(0, x) for x in xs], "f int, x double")
        assert one(infer.signflip_exact(df, "x")).p == p and one(infer.signflip(df, "x", ["f"])).p == p
    many = spark.createDataFrame([(0, 1.0)] * 20, "f int, x double")
    r = one(infer.signflip(many, "x", ["f"], 500))
    assert r.p == pytest.approx(1 / 501) and r.error == pytest.approx(math.sqrt(r.p * (1 - r.p) / 501))
    rng = np.random.default_rng(3)
    some = spark.createDataFrame([(0, float(v)) for v in rng.normal(0.3, 1, 13)], "f int, x double")
    xs = np.array([v.x for v in some.collect()])
    signs = 1 - 2 * ((np.arange(1 << 13)[:, None] >> np.arange(13)) & 1)
    assert one(infer.signflip(some, "x", ["f"])).p == pytest.approx((np.abs(signs @ xs) >= abs(xs.sum()) - 1e-12).mean())


def test_cluster_interval(spark):
    rows = [(0, o, o % 2, float((o * 7) % 5)) for o in range(30)] + [(1, 0, 0, 1.0)] + [(2, o, 0, 1.0) for o in range(4)]
    df = spark.createDataFrame(rows, "f int, o int, label int, x double")
    got = {r.f: r for r in infer.cluster_interval(df, "x", "label", "o", ["f"], 300, 1).collect()}
    assert got[0].low < got[0].estimate < got[0].high and got[0].status == "OK"
    assert got[1].status == "NOT_ESTIMABLE" and got[2].status == "EMPIRICAL_DEGENERATE"
    again = {r.f: r for r in infer.cluster_interval(df.repartition(7), "x", "label", "o", ["f"], 300, 1).collect()}
    assert again[0].low == pytest.approx(got[0].low)


def test_label_interval(spark):
    rows = [(0, i % 6, float(i % 6) + (i % 2)) for i in range(60)] + [(1, 0, 2.0), (1, 1, 2.0)]
    df = spark.createDataFrame(rows, "f int, label int, x double")
    got = {r.f: r for r in infer.label_interval(df, "x", "label", ["f"], 400, 2).collect()}
    assert got[0].labels == 6 and got[0].estimate == pytest.approx(3.0) and 1 < got[0].low < 3 < got[0].high < 5
    assert got[1].low == got[1].high == 2.0


def test_influence_equals_its_definition(spark):
    rows = [(o % 7, o % 3, float((o * 5) % 11)) for o in range(40)]
    df = spark.createDataFrame(rows, "o int, label int, x double")
    means = {k: np.mean([x for _, label, x in rows if label == k]) for k in range(3)}
    n = {k: sum(label == k for _, label, _ in rows) for k in range(3)}
    want = {o: sum((x - means[k]) / n[k] / 3 for p, k, x in rows if p == o) for o in range(7)}
    assert {r.o: r.influence for r in infer.influence(df, "x", "label", "o").collect()} == pytest.approx(want)


def test_budget_plan_keeps_order_unless_it_cuts(spark):
    g = spark.createDataFrame([(1, [30, 10, 20]), (2, [1, 2, 3, 4])], "g long, ids array<long>")
    key = lambda *x: hashlib.sha256("|".join(map(str, (5, *x))).encode()).hexdigest()[:16]
    got = [(*r[:4], f"{int(r.subset_key):016x}") for r in subsets.budget_plan(g, "g", [2], 5, 4).orderBy("g", "replicate").collect()]
    assert got[:3] == [(1, 2, k, f"{a};{b}", key(1, 2, a, b)) for k, (a, b) in enumerate([(10, 20), (10, 30), (20, 30)])]
    cut = sorted(itertools.combinations((1, 2, 3, 4), 2), key=lambda s: key(2, 2, *s))[:4]
    assert [r[3] for r in got[3:]] == [f"{a};{b}" for a, b in cut]
    with pytest.raises(Exception, match="more than 12"):
        subsets.budget_plan(spark.createDataFrame([(1, list(range(13)))], "g long, ids array<long>"), "g", [2], 5).collect()


def test_pooled_subsets_equal_the_plain_form(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(g, [(i, rng.random(3).tolist()) for i in range(2 + g % 4)]) for g in range(12)], "g long, photos array<struct<id: long, p: array<double>>>")
    plain = {(r.g, r["mask"]): r.p for r in subsets.pooled(subsets.with_subsets(df), 3, 9).collect()}
    assert {(r.g, r["mask"]): r.p for r in subsets.pooled_subsets(df, 3, 9).collect()} == plain


def test_contributions_add_up(spark):
    df = spark.createDataFrame([(o, o % 3, float(o)) for o in range(10)], "o int, label int, x double")
    assert one(infer.contributions(df, "x", "label", "o").agg(F.sum("contribution").alias("s"))).s == pytest.approx(one(infer.macro_mean(df, "x", "label")).estimate)
    assert one(infer.influence(df, "x", "label", "o").agg(F.sum("influence").alias("s"))).s == pytest.approx(0)


def test_paired_inference(spark):
    rows = [(g, g % 2, g % 5, k, 0.1 * k + (g % 3) * 0.01) for g in range(20) for k in (1, 2)]
    df = spark.createDataFrame(rows, "g int, label int, o int, k int, a double")
    t = [(1, 2), (2, 3)]
    got = {(r["from"], r["to"]): r for r in infer.paired_inference(infer.paired_records(df, t, "g", "label", "o", "k", "a"), "label", "o", t, 100).collect()}
    assert got[1, 2].estimate == pytest.approx(0.1) and got[1, 2].p == pytest.approx(2 / 32) and got[2, 3].status == "NOT_ESTIMABLE" and got[2, 3].p == 1


def test_other_draws(spark):
    df = spark.createDataFrame([(0, i % 2, float(i)) for i in range(12)], "f int, label int, x double")
    r = one(infer.group_bootstrap(df, "label", ["f"], lambda f: float(f["x"].mean()), 50))
    assert r.low < 5.5 < r.high
    assert infer.random_subsets(df, "x", [5, 20], 3).filter("mean IS NOT NULL").count() == 3


# Selection


def test_flow_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), int(o), int(100 + i)) for i, (t, o) in enumerate(zip(rng.integers(0, 3, 10), rng.integers(0, 5, 10), strict=True))]
    df = spark.createDataFrame(rows, "taxon long, observer long, observation long")
    lower, upper = {0: 1, 1: 1, 2: 1}, {0: 2, 1: 2, 2: 2}
    import hashlib

    cost = lambda g: int(hashlib.sha256(f"9|{g}".encode()).hexdigest()[:8], 16)
    best = None
    for s in itertools.combinations(rows, 4):
        taxa, observers = [r[0] for r in s], [r[1] for r in s]
        if len(set(observers)) == 4 and all(lower[t] <= taxa.count(t) <= upper[t] for t in range(3)):
            best = min(x for x in (best, sum(cost(r[2]) for r in s)) if x is not None)
    if best is None:
        with pytest.raises(ValueError):
            select.bounded_selection(df, lower, upper, 4, 1, 9)
    else:
        assert sum(cost(r.observation) for r in select.bounded_selection(df, lower, upper, 4, 1, 9).collect()) == best
    with pytest.raises(ValueError):
        select.balanced_selection(df, {0: 50, 1: 1, 2: 1}, 1, 9)


def test_flow_reduces_before_it_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(int(t), int(o), 1000 + i) for i, (t, o) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 6, 400), strict=True))]
    import hashlib

    cost = lambda g: int(hashlib.sha256(f"9|{g}".encode()).hexdigest()[:8], 16)
    least = {}
    for t, o, g in rows:
        least[t, o] = min(least.get((t, o), 1 << 40), cost(g))
    # one group an observer, and the wanted number of groups a taxon
    best = min(sum(least[t, o] for o, t in enumerate(p)) for p in itertools.product(range(3), repeat=6) if all(p.count(t) == 2 for t in range(3)))
    df = spark.createDataFrame(rows, "taxon long, observer long, observation long")
    got = select.bounded_selection(df, dict.fromkeys(range(3), 2), dict.fromkeys(range(3), 2), 6, 1, 9, most=18).collect()
    assert sum(cost(r.observation) for r in got) == best and len(got) == 6
    with pytest.raises(ValueError):
        select.bounded_selection(df, dict.fromkeys(range(3), 2), dict.fromkeys(range(3), 2), 6, 1, 9, most=17)


def test_observer_split(spark):
    df = spark.createDataFrame([(o, t) for o in range(30) for t in range(3)], "observer long, taxon long")
    got = select.observer_split(df, {"train": 0.6, "validation": 0.2, "test": 0.2}, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 18, "validation": 6, "test": 6}


# Lineage, sources, sinks


def test_lineage(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(text)
    d = lineage.file_digests(spark, str(tmp_path))
    markers = lineage.finish(None, "s1", "c", d)
    assert lineage.resumable(markers, "s1", "c", d) and not lineage.resumable(markers, "s2", "c", d)
    with pytest.raises(ValueError):
        lineage.resumable(markers, "s1", "other", d)
    with pytest.raises(ValueError):
        lineage.finish(markers, "s1", "c", d)
    kept = [tuple(r) for r in markers.collect()]
    markers = spark.createDataFrame(kept, lineage.MARKERS)
    (tmp_path / "a").write_text("changed")
    now = lineage.file_digests(spark, str(tmp_path))
    with pytest.raises(ValueError, match="changed"):
        lineage.resumable(markers, "s1", "c", now)
    assert [r.state for r in lineage.drift(markers.select(F.col("artifact").alias("path"), "sha256"), now).collect()] == ["changed"]


def test_tree(spark):
    markers = spark.createDataFrame([("root", "c", "mid", "h1"), ("root", "c", "x", "h2"), ("mid", "c", "leaf", "h3"), ("leaf", "c", "mid", "h1")], lineage.MARKERS)
    digests = spark.createDataFrame([("mid", "h1"), ("x", "BAD")], "path string, sha256 string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert {r.artifact: r.state for r in lineage.verify_tree(markers, digests, "root").collect()} == {"mid": "ok", "x": "changed", "leaf": "missing"}


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert one(lineage.frame_digest(df)) == one(lineage.frame_digest(df.orderBy("t").select("t", "i")))
    assert one(lineage.frame_digest(df)) != one(lineage.frame_digest(df.unionAll(df)))


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("photo_id,dhash,name\n1.0,00ff,\n2,00aa,x\n")
    rows = readers.manifest(spark, str(tmp_path / "m.csv"), ["photo_id"]).collect()
    assert [(r.photo_id, r.dhash, r.name) for r in rows] == [(1, "00ff", ""), (2, "00aa", "x")]
    (tmp_path / "bad.csv").write_text("photo_id\n1.5\n")
    with pytest.raises(Exception, match="no whole number"):
        readers.manifest(spark, str(tmp_path / "bad.csv"), ["photo_id"]).collect()
    (tmp_path / "n.json").write_text('{"groups": [{"id": 1, "photos": [{"p": 5}, {"p": 6}]}]}')
    o = readers.json_objects(spark, str(tmp_path / "n.json"), "groups array<struct<id: long, photos: array<struct<p: long>>>>")
    assert {tuple(r) for r in readers.nested_members(o, "groups", "photos", ["id"], ["p"]).collect()} == {(1, 5), (1, 6)}
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    index = spark.createDataFrame([(7, 2), (8, 0)], "photo_id long, feature_row long")
    assert {r.photo_id: r.feature for r in readers.feature_matrix(spark, str(tmp_path / "x.npy"), index, "photo_id").collect()} == {7: [4.0, 5.0], 8: [0.0, 1.0]}
    (tmp_path / "c.json").write_text('{"status": "Frozen ", "freeze": {"a": "1"}}')
    c = readers.config(str(tmp_path / "c.json"))
    readers.require_frozen(c, {"a": "1"})
    with pytest.raises(ValueError):
        readers.require_frozen(c, {"a": "2"})


def test_writers_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    writers.json(df, str(tmp_path / "j"))
    writers.parquet(df, str(tmp_path / "p"))
    writers.csv(df, str(tmp_path / "c"))
    for w in (writers.json, writers.parquet, writers.csv):
        with pytest.raises(Exception, match="exist"):
            w(df, str(tmp_path / w.__name__[0]))


# Aggregators and intake


def test_several_matrices_need_their_names(spark, tmp_path):
    for name, x in (("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[5.0, 6.0], [7.0, 8.0]])):
        np.save(tmp_path / f"{name}.npy", np.array(x, np.float32))
    index = spark.createDataFrame([(7, "a.npy", 1), (8, "b.npy", 1)], "photo_id long, matrix string, feature_row long")
    got = {r.photo_id: r.feature for r in readers.feature_matrix(spark, str(tmp_path / "*.npy"), index, "photo_id").collect()}
    assert got == {7: [3.0, 4.0], 8: [7.0, 8.0]}
    with pytest.raises(ValueError):
        readers.feature_matrix(spark, str(tmp_path / "*.npy"), index.drop("matrix"), "photo_id")
    bad = spark.createDataFrame([(7, 0), (7, 5)], "photo_id long, feature_row long")
    assert {r.gate for r in readers.index_faults(bad, 3, "photo_id").collect()} == {"unique_photo_id", "feature_row_outside", "index_length"}


def test_rival_model_follows_its_formula(spark):
    rng = np.random.default_rng(6)
    w = {k: rng.normal(size=s) for k, s in {"weight": (4, 5), "bias": 4, "norm_weight": 5, "norm_bias": 5, "hidden_weight": (6, 5), "hidden_bias": 6, "out_weight": (1, 6), "out_bias": 1}.items()}
    w |= {"scale": 1.0, "gate": -2.0, "rivals": 2}
    x = rng.normal(size=(3, 5))
    logits = x @ w["weight"].T + w["bias"]
    order = np.argsort(-logits.mean(0), kind="stable")
    z = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w["norm_weight"] + w["norm_bias"]
    h = z @ w["hidden_weight"].T + w["hidden_bias"]
    h = h * 0.5 * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))
    reliable = (h @ w["out_weight"].T + w["out_bias"])[:, 0]
    taken = []
    for k in order[1:3]:
        d = w["weight"][order[0]] - w["weight"][k]
        s = reliable + (x - x.mean(0)) @ (d / np.linalg.norm(d))
        e = np.exp(s - s.max())
        taken.append((e / e.sum()) @ x)
    e = np.exp(logits.mean(0)[order[1:3]])
    selected = (e / e.sum()) @ np.array(taken)
    mixed = x.mean(0) + (selected - x.mean(0)) / (1 + math.exp(2))
    assert np.allclose(aggregators.rival_conditioned(x, w), mixed @ w["weight"].T + w["bias"])
    one_view = aggregators.rival_conditioned(x[:1], w)
    assert np.allclose(one_view, x[0] @ w["weight"].T + w["bias"])
    df = spark.createDataFrame([(1, x.tolist()), (2, x[::-1].tolist()), (3, x[:2].tolist())], "g long, f array<array<double>>")
    got = {r.g: r.probabilities for r in aggregators.classify(df, "g", "f", "rival_conditioned", w).collect()}
    assert np.allclose(got[1], got[2]) and np.isclose(sum(got[3]), 1)


def test_detector_proxies(spark):
    gray = np.add.outer(np.arange(4.0), np.zeros(4)).ravel().tolist()
    rows = [(1, [[0.0, 0.0, 4.0, 2.0], [0.0, 0.0, 8.0, 8.0]], [0.9, 0.4], [16, 16], 8, 4, gray), (2, [[0.0, 0.0, 9.0, 9.0]], [0.9], [3], 8, 4, gray), (3, [], [], [], 8, 4, gray), (4, [[-1.0, -1.0, 9.0, 9.0]], [0.7], [16], 8, 4, gray)]
    df = spark.createDataFrame(rows, "id long, boxes array<array<double>>, scores array<double>, labels array<int>, width int, height int, gray array<double>")
    got = {r.id: r for r in dedup.detector_proxies(df.withColumn("rows", F.lit(4)), "id").collect()}
    assert (got[1]["detections"], got[1].score, got[1].area) == (1, 0.9, 0.25) and got[1].background == pytest.approx(1.0)
    assert got[2]["detections"] == got[3]["detections"] == 0 and got[2].area is None and got[3].score is None and got[3].background is None
    assert got[4].area == 1.0 and got[4].background is None


def test_models_do_not_depend_on_order(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3, 4))
    w = {"weight": rng.standard_normal((2, 4)), "bias": np.zeros(2)}
    deep = {"phi_weight": rng.standard_normal((5, 4)), "phi_bias": np.zeros(5), "rho_weight": rng.standard_normal((6, 5)), "rho_bias": np.zeros(6), "weight": rng.standard_normal((2, 6)), "bias": np.zeros(2)}
    for name, f in aggregators.MODELS.items():
        if name == "rival_conditioned":
            continue  # has a test of its own
        ws = deep if name == "deep_sets" else w
        assert f(x, ws) == pytest.approx(f(x[::-1], ws))
    df = spark.createDataFrame([(1, x.tolist())], "g long, v array<array<double>>")
    assert sum(one(aggregators.classify(df, "g", "v", "deep_sets", deep)).probabilities) == pytest.approx(1)


def test_aligned_features_fail_closed(spark):
    f = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [3.0])], "k long, feature array<double>")
    assert one(aggregators.aligned(f, spark.createDataFrame([(1,)], "k long"), "k")).feature == [1.0]
    for k in (2, 3):
        with pytest.raises(Exception, match="are not one"):
            aggregators.aligned(f, spark.createDataFrame([(k,)], "k long"), "k").collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"t{rng.integers(3)}", i, int(rng.integers(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, event_id long, user_id long")
    src = str(tmp_path / "in")
    df.filter("event_id >= 200").coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for _ in range(2):
            s = fold.accept_stream(spark.readStream.schema(df.schema).parquet(src), 2, 20)
            q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
            df.filter("event_id < 200").coalesce(1).write.mode("append").parquet(src)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.key, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).filter("state = 'accepted'").collect()}
    want = {(r.key, r.event_id) for r in fold.accepted(df, "key", "user_id", "event_id").collect()}
    first = {k: [e for kk, e in sorted(want, reverse=True) if kk == k] for k in {k for k, _ in want}}
    # a stream takes a user's second event only while the key is open; the batch form cuts at the same event
    assert got <= want and all(len([1 for k, _ in got if k == key]) > 0 for key in first)


def test_page_faults(spark):
    df = spark.createDataFrame([("t", 0, 0, 9), ("t", 0, 1, 7), ("t", 1, 0, 7), ("t", 1, 1, 3)], "key string, page int, place int, id long")
    assert [(r.page, r.place) for r in fold.page_faults(df, "key", "page", "place", "id").collect()] == [(1, 0)]


def test_rounded_is_what_duckdb_rounds_to(spark):
    import duckdb

    # products beside a half, halves of both signs, large and special values
    xs = [0.062812500000000004, 0.0628125, 0.1234565, 2.5e-9, -0.5, -1.5, 0.49999999999999994, 1e300, 2.0**60 + 1, float("inf"), None]
    xs += [(i / 1e9 + (3 * i + 1) / 1e9) / 2 for i in range(123_456, 50_000_000, 77_777)] + [i / 1e7 for i in range(5, 10_000_000, 9_990)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = df.select(V.rounded(F.col("x"), 9).alias("a"), V.rounded(F.col("x"), 6).alias("b"), V.rounded(F.col("x"), 0).alias("c")).collect()
    sql = "SELECT round(?::DOUBLE, 9), round(?::DOUBLE, 6), round(?::DOUBLE, 0)"
    wanted = [duckdb.execute(sql, [x] * 3).fetchall()[0] for x in xs]
    assert [tuple(r) for r in got] == wanted


def test_near_pairs_collect_no_keys_on_the_driver(spark):
    h = spark.createDataFrame([(1, 0), (2, 15), (3, -1), (4, 0)], "id long, hash long")
    pairs = dedup.near_pairs(h, h, 4)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 4), (1, 4, 0), (2, 4, 4)]


def test_vertex_cover_takes_small_components_together(spark):
    nodes = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, 2.5).otherwise(1.0).alias("weight"))
    edges = nodes.filter("id % 4 = 0").select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("b"))
    got = dedup.vertex_cover(edges, edges.select(F.col("a").alias("id"), F.col("a").alias("root")).unionAll(edges.select("b", "a")).distinct(), nodes)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a call a component
    assert {r.id for r in got.collect() if r.chosen and r.exact} == set(range(0, 400, 4)) and got.count() == 400


def test_observer_split_in_blocks(spark):
    rows = [(o, t) for o in range(600) for t in range(1, 4) for _ in range(1 + (o * t) % 3)] + [(o, 9) for o in range(5, 605, 100)]
    df = spark.createDataFrame(rows, "observer long, taxon long")
    wanted = {"train": 0.6, "validation": 0.2, "test": 0.2}
    got = select.observer_split(df, wanted, 1, most=400)
    assert got.count() == got.select("observer").distinct().count() == 600
    n = {(r.taxon, r.split): r["count"] for r in df.join(got, "observer").groupBy("taxon", "split").count().collect()}
    assert len(n) == 12  # the rare taxon too is in every split
    for t in (1, 2, 3):
        assert all(abs(n[t, s] / sum(n[t, x] for x in wanted) - share) < 0.03 for s, share in wanted.items())


def test_draws_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(0, o, o % 3, float(x)) for o, x in enumerate(rng.normal(0.02, 1, 900))]
    df = spark.createDataFrame(rows, "f int, o long, label int, x double")
    whole = one(infer.cluster_interval(df, "x", "label", "o", ["f"], 1000, 5))
    p = one(infer.signflip(df, "x", ["f"], 1000, 5)).p
    points = {r.metric: r for r in infer.metric_intervals(df, ["f"], "o", "label", ["x"], ["x"], 300, 5).collect()}
    monkeypatch.setattr(infer, "CHUNK", 50)
    each = df.select("f", "o", "x").checkpoint()
    chunks = infer._chunks(each, ["f"], F.col("o"), "o", ["x"]).collect()
    assert len(chunks) == 18 and sum(len(r.x) for r in chunks) == 900 and max(len(r.x) for r in chunks) < 100
    sizes = np.array(chunks[0].sizes)
    assert all(sum(infer._times(5, 0, 20, sizes, i).sum(1) for i in range(len(sizes))) == 900)
    parts = one(infer.cluster_interval(df, "x", "label", "o", ["f"], 1000, 5))
    assert parts.estimate == pytest.approx(whole.estimate) and parts.clusters == 900
    assert (parts.low, parts.high) == pytest.approx((whole.low, whole.high), abs=0.02)
    assert one(infer.signflip(df, "x", ["f"], 1000, 5, cluster="o")).p == pytest.approx(p, abs=0.06)
    again = {r.metric: r for r in infer.metric_intervals(df, ["f"], "o", "label", ["x"], ["x"], 300, 5).collect()}
    for m, r in points.items():
        assert again[m].estimate == pytest.approx(r.estimate) and (again[m].low, again[m].high) == pytest.approx((r.low, r.high), abs=0.03)


def test_quantile_edges_by_ranks(spark):
    rng = np.random.default_rng(6)
    xs = {0: rng.normal(size=501).tolist(), 1: rng.integers(0, 4, 300).astype(float).tolist(), 2: [7.0]}
    df = spark.createDataFrame([(b, x) for b, v in xs.items() for x in v] + [(1, None)], "b int, x double")
    edges = strata.quantile_edges(df, "x", 4, ["b"])
    assert "percentile" not in edges._jdf.queryExecution().optimizedPlan().toString()  # which holds a by-group's values
    got = {r.b: r.edges for r in edges.collect()}
    for b, v in xs.items():
        assert got[b] == pytest.approx(sorted(set(np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))))
    assert one(strata.quantile_edges(df, "x", 2)).edges == pytest.approx(np.quantile(sum(xs.values(), []), [0, 0.5, 1]))

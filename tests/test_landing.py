"""Landed records, manifests, reviews and stored predictions on small frames."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import infer, manifest, review, subsets
from lattica.sources import landing


def photo(i):
    return {"id": i, "license_code": "cc-by", "attribution": "a", "url": f"https://static.inaturalist.org/{i}/square.jpg"}


def record(**changes):
    base = {"id": 1, "user": {"id": 9}, "taxon": {"id": 5, "ancestor_ids": [1, 5]}, "quality_grade": "research", "created_at": "2024-01-01T00:00:00Z", "observed_on": None, "photos": [photo(i) for i in (4, 3, 2)]}
    return base | changes


def test_first_reason_of_landed_records(spark, tmp_path):
    cases = [
        (record(id=10), None), (record(id=None), "invalid_source_identity"), (record(id=11, user={"id": None}), "invalid_source_identity"), (record(id=77), "historical_observation"), (record(id=12, user={"id": 88}), "historical_observer"),
        (record(id=13, taxon={"id": 6, "ancestor_ids": [1]}), "not_exact_species_id"), (record(id=19, taxon={"id": 6, "ancestor_ids": [1, 5, 6]}), "not_exact_species_id"), (record(id=14, quality_grade="casual"), "not_research_grade"), (record(id=15, created_at="2024-01-01T00:00:00"), "invalid_created_at"),
        (record(id=16, created_at="2025-01-01T00:00:00Z"), "after_creation_cutoff"), (record(id=17, photos=record()["photos"][:1]), "fewer_than_two_usable_photos"), (record(id=18, photos=None), "fewer_than_two_usable_photos"),
        (record(id=20, photos=[photo(5), photo(5)]), "fewer_than_two_usable_photos"), (record(id=21, photos=[photo(5), photo(99)]), "fewer_than_two_usable_photos"),
        (record(id=22, photos=[photo(5), photo(6) | {"license_code": "cc-by-nc"}]), "fewer_than_two_usable_photos"), (record(id=23, photos=[photo(5), photo(6) | {"url": "https://x.org/6/square.jpg"}]), "fewer_than_two_usable_photos"),
    ]
    with gzip.open(tmp_path / "p1.json.gz", "wt") as f:
        json.dump({"page": 1, "results": [c for c, _ in cases]}, f)
    rows = landing.pages(spark, str(tmp_path))
    old = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = landing.classified(rows, 5, "2024-06-01T00:00:00Z", old(77), old(88), old(99)).orderBy("place").collect()
    below = landing.classified(rows.filter("id = 19"), 5, "2024-06-01T00:00:00Z", old(77), old(88), descendants=True).collect()
    assert below[0].reason is None
    assert [r.reason for r in got] == [w for _, w in cases]
    assert [p.id for p in got[0].kept] == [2, 3, 4] and got[1].kept is None
    assert landing.page_stream(spark, str(tmp_path)).isStreaming
    hashed = rows.filter("id = 10").select(landing.hashed_photos(F.col("photos"), 3, 2).alias("p")).collect()[0].p
    assert len(hashed) == 2


def test_names_and_census(spark):
    found = spark.createDataFrame([("Ab", 1, True), ("ab", 1, True), ("cd", 2, True), ("CD", 3, True), ("ef", 4, False)], "name string, id long, is_active boolean")
    wanted = spark.createDataFrame([("AB",), ("cd",), ("ef",)], "name string")
    assert {r.name: r.id for r in landing.exact_names(wanted, found).collect()} == {"AB": 1, "cd": None, "ef": None}
    rows = spark.createDataFrame([(1, 1, 7), (1, 1, 7), (2, 1, 8)], "id long, taxon long, observer long")
    r = landing.census(rows, "taxon", "observer", 5).collect()[0]
    assert (r.records, r.observers, r.shortfall) == (2, 2, 3)


def test_manifest(spark):
    a = spark.createDataFrame([(1, 30), (2, 10)], "photo long, taxon long")
    b = spark.createDataFrame([(2, 20, "x")], "photo long, taxon long, note string")
    out, bad = manifest.combined([a, b], "photo", "taxon")
    assert {(r.photo, r.taxon): r.class_index for r in out.collect()} == {(1, 30): 2, (2, 10): 0, (2, 20): 1} and bad.count() == 1
    classes = spark.createDataFrame([(5, 0, "a"), (6, 1, "b")], "taxon_id long, class_index int, name string")
    assert {r.taxon_id: r.class_index for r in manifest.replaced(classes, F.lit(6), {"taxon_id": F.lit(9).cast("long"), "name": F.lit("c")}).collect()} == {5: 0, 9: 1}
    g = spark.createDataFrame([(1, 5, [(100,), (101,)]), (2, 7, [(102,)])], "observation_id long, taxon_id long, photos array<struct<photo_id: long>>")
    rows, missing = manifest.from_groups(g, "photos", classes, "c1")
    assert rows.count() == 2 and [r.key for r in missing.collect()] == ["2"]
    assert manifest.subset_of_source(a.filter("photo = 1"), a).count() == 0 and manifest.whole_groups(out.filter("photo = 1"), out, "taxon").count() == 0


def test_review(spark):
    pairs = spark.createDataFrame([(1, 10, 11, "x", "x", True, False, False), (2, 10, 12, "x", "y", False, False, False), (3, 10, 13, "x", "z", True, False, False), (4, 10, 14, "x", "q", False, False, False), (5, 10, 12, "x", "y", False, True, True), (6, 1, 2, "", "", False, False, False)][:5], "pair_id long, a long, b long, sha_a string, sha_b string, exact boolean, same_group boolean, history boolean")
    decisions = spark.createDataFrame([(1, "exact_duplicate"), (3, "exact_duplicate"), (4, "distinct"), (5, "distinct"), (9, "distinct")], "pair_id long, decision string")
    digests = spark.createDataFrame([(10, "x"), (11, "x"), (12, "y"), (13, "z"), (14, "changed")], "id long, sha256 string")
    assert {r.pair_id: r.fault for r in review.bound(pairs, decisions, digests).collect()} == {1: None, 2: "missing", 3: "exactness", 4: "changed", 5: "not_allowed", 9: "stale"}
    p = spark.createDataFrame([(1, "k", [0.5, 0.5]), (1, "k", [0.25, 0.75]), (1, "l", [1.0, 0.0])], "budget int, key string, p array<double>")
    r = review.shared_differences(p, "key", "p").collect()
    assert len(r) == 1 and r[0].difference == 0.25


def test_samples(spark):
    g = spark.createDataFrame([(1, [3, 4, 5]), (2, [6])], "g long, ids array<long>")
    assert subsets.samples(g, "g", 2, "exhaustive").count() == 3
    assert subsets.samples(g, "g", 2, "first").collect()[0].photo_ids in {"3;4", "3;5", "4;5"}
    assert {subsets.samples(g, "g", 2, "random", 1, e).collect()[0].photo_ids for e in range(6)} <= {"3;4", "3;5", "4;5"}
    with pytest.raises(ValueError):
        subsets.samples(g, "g", 2, "other")


def test_metric_intervals(spark):
    rows = [(0, g, g % 2, g % 4, (g % 3) / 2, 0.1 * (g % 5)) for g in range(24)] + [(1, 99, 0, 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "f int, g int, label int, o int, a double, b0 double")
    got = {(r.f, r.metric): r for r in infer.metric_intervals(df, ["f"], "o", "label", ["a"], ["b0"], 200).collect()}
    mean = sum((g % 3) / 2 for g in range(24)) / 24
    assert got[0, "a"].estimate == pytest.approx(mean) and got[0, "a"].low <= mean <= got[0, "a"].high
    # labels stay fixed: the macro interval is the one that influences give
    rows = [(0, g, label, o, a, 0.0) for g, (label, o, a) in enumerate([(0, 0, 1.0), (0, 1, 0.0), (0, 2, 1.0), (0, 1, 1.0), (0, 0, 0.0), (0, 2, 1.0), (1, 0, 0.8)])]
    few = spark.createDataFrame(rows, "f int, g int, label int, o int, a double, b0 double")
    macro = next(r for r in infer.metric_intervals(few, ["f"], "o", "label", ["a"], ["b0"], 300, 4).collect() if r.metric == "macro_a")
    plain = infer.cluster_interval(few, "a", "label", "o", ["f"], 300, 4).collect()[0]
    assert (macro.estimate, macro.low, macro.high) == pytest.approx((plain.estimate, plain.low, plain.high))
    assert got[1, "a"].status == "NOT_ESTIMABLE" and got[0, "ece"].estimate == pytest.approx(sum(0.1 * (g % 5) for g in range(24)) / 24)

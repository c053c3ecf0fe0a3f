"""The pipeline's stages on a small corpus with planted cases, and its registration."""

import random

import corpus_pipeline
from tests.llm.test_text_operators import prose


def corpus(spark, path):
    rng = random.Random(11)
    passage = prose(rng, 70)
    item = prose(rng, 25)
    clean = [(i, prose(rng, 120)) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}$$$" for w in prose(rng, 100).split())) for i in range(30)]
    base = prose(rng, 150)
    copies = [(200 + i, base) for i in range(4)] + [(210, base + " more"), (211, None), (212, "")]
    shared = [(300 + i, f"{prose(rng, 50)} {passage} {prose(rng, 50)}") for i in range(3)]
    leaks = [(400, f"{prose(rng, 40)} {item} {prose(rng, 40)}")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + junk + copies + shared + leaks]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean[:30]] + [(i, 0, 0) for i, _ in junk[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = docs
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").collect()}
    assert not {x for x in ids("quality_classifier") if 100 <= x < 200} and set(range(60)) <= ids("quality_classifier")
    assert {x for x in ids("near_dedup") if 200 <= x <= 210} == {200} and set(range(60)) <= ids("near_dedup")
    texts = {r.doc_id: r for r in kept["substring_dedup"].collect()}
    assert all(passage[50:250] not in (r.text or "") for r in texts.values())
    assert all(len(r.text or "") == r.n_chars for r in texts.values()) and set(range(60)) | {300, 301, 302} <= set(texts)
    assert 400 not in ids("decontamination") and set(range(60)) <= ids("decontamination")
    assert ids("packing") == ids("decontamination")


def test_null_and_repeated_ids(spark, tmp_path):
    corpus(spark, str(tmp_path))
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    rng = random.Random(12)
    base, other, third = prose(rng, 150), prose(rng, 150), prose(rng, 150)
    leak = f"{prose(rng, 40)} {item} {prose(rng, 40)}"
    texts = [(None, base), (None, base + " more"), (None, other), (7, third), (7, other + " less"), (7, leak), (None, leak + " too"), (8, base), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert rows(near) == sorted([(8, base), (7, other + " less"), (7, third), (7, leak), (None, None), (None, "")], key=repr)
    assert near.columns == docs.columns
    clean = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert rows(clean) == sorted([x for x in texts if item not in (x[1] or "")], key=repr)
    assert clean.columns == docs.columns


def test_empty_input(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names

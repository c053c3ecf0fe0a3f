"""Each operator against brute force on small tables, and on null, empty, long, repeated and clashing rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontamination, language_id, license_scan, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, warc
from lattica.llm.common import id_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digit int, `key` string, words string, node string, label string, `row` int, chunk int, bucket int, spans string"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text, lang); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "k", "w", "n", "l", 2, 3, 4, "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = prose(rng, 60)
    base = prose(rng, 200)
    out = [(i, prose(rng, rng.choice([3, 12, 80, 300])), "en") for i in range(40)]
    out += [(40 + i, f"{prose(rng, 40)} {shared} {prose(rng, 30)}", "en") for i in range(6)]
    out += [(50, base, "en"), (51, base, "en"), (52, base.replace(base.split()[90], "zzz", 1), "en")]
    out += [(60, None, None), (61, "", "en"), (62, " \n\t ", "en"), (63, "#$%& *** 12", "en"), (None, prose(rng, 50), "en"), (None, None, None)]
    out += [(70, "For " * 3000, "en"), (71, prose(rng, 20_000), "en"), (72, "é" * 500, "fr"), (72, "é" * 500, "fr"), (73, "x" * 250, None)]
    out += [(74, f"{prose(rng, 20)}\nAll rights reserved.\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "en")]
    return out


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_quality_rules(spark, rows):
    got = quality_rules.measured_cascade(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        c = Counter(wins)
        inside = {k + j for k, w in enumerate(wins) if c[w] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), len(ws) < 10 or 100 * len(inside) > 20 * len(ws)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    # the cascade's verdict is that of all rules, whatever their order
    every = {repr((i, t)): not any(r.rejects(quality_rules.Text((t or "").encode())) for r in quality_rules.RULES) for i, t, _ in rows}
    asked = quality_rules.quality_cascade(frame(spark, rows)).collect()
    assert sorted((str(i), every[repr((i, t))]) for i, t, _ in rows) == sorted((str(r.doc_id), r.kept) for r in asked) == sorted((str(r.doc_id), r.kept) for r in got)
    assert all((r.rejected_by is None) == r.kept and 1 <= r.asked <= len(quality_rules.RULES) for r in asked)
    assert any(r.asked < len(quality_rules.RULES) for r in asked) and all(r.asked == len(quality_rules.RULES) for r in asked if r.kept)
    assert quality_rules.measured_cascade(frame(spark, [])).count() == 0


def test_rejected_texts_pay_for_no_later_measure():
    text = quality_rules.Text(b"a b")
    assert quality_rules.judged(text, (quality_rules.RULES[0], *quality_rules.RULES[1:])) == ("short", 1)
    assert "pair_chars" not in vars(text) and "n_repeat_words" not in vars(text)
    pair = quality_rules.Text(b"one two three one two four one two five one two six")
    assert pair.pair_chars == 24 and quality_rules.Text(b"").pair_chars == 0


def test_cascade_orders_by_rejections_per_cost():
    rules = tuple(quality_rules.Rule(n, None) for n in "abc")
    order = quality_rules.ordered(rules, [("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 0.01, 0.0)])
    assert [r.name for r in order] == ["b", "a", "c"]


def near_classes(docs):
    """A class for each row of (doc_id, text), by all pairs: the smallest id in it, if any."""
    cut = []
    for _, t in docs:
        w = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", (t or "").lower()).split() or (t or "").split()
        cut.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if cut[a] and cut[b]:
                both = len(cut[a] & cut[b])
                if both and both >= 0.8 * (len(cut[a]) + len(cut[b]) - both) - 1e-9:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)].append(i)
    return [min(ids[find(k)], default=None) for k in range(len(docs))]


def test_near_duplicates_match_exact_similarity(spark, rows):
    docs = [(i, t) for i, t, _ in rows]
    rng = random.Random(8)
    for k in range(12):  # a centre and texts some words away
        ws = prose(rng, 150).split()
        docs.append((100 + 20 * k, " ".join(ws)))
        for j in range(1, 8):
            v = list(ws)
            for at in rng.sample(range(150), j):
                v[at] = prose(rng, 1) + "q"
            docs.append((100 + 20 * k + j, " ".join(v)))
    # rows without an id and with one id: copies across both, and different texts
    a, b, c = prose(rng, 100), prose(rng, 100), prose(rng, 100)
    docs += [(None, a), (None, a), (900, a), (None, b), (None, b + " more"), (901, b), (901, c), (901, prose(rng, 90)), (None, prose(rng, 90)), (902, c + " x")]
    got = near_dedup.near_duplicates(frame(spark, [(i, t, "en") for i, t in docs])).collect()
    want = [(i, c) for (i, _), c in zip(docs, near_classes(docs), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(None, "a b c", "en"), (1, None, "en")])).count() == 2


def test_alignment_follows_order():
    h = np.arange(100, dtype=np.uint64)
    turned = np.concatenate([h[50:], h[:50]])
    assert near_dedup.aligned(h, h, h, h) == 1
    assert near_dedup.aligned(h, turned, h, turned) <= 0.5


@pytest.mark.parametrize("most", [2 << 20, 1])
def test_substring_dedup(spark, rows, most):
    rows = [r for r in rows if r[0] != 71]
    found = substring_dedup.without_repeats(frame(spark, rows), 200, most).collect()
    count = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        want.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    got = [(r.row.doc_id, r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.rest)).hexdigest()) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0


def test_license_scan(spark, rows):
    docs = [*rows, rows[-1], (None, rows[-1][1], "en")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, sorted({x.label for x in r.found})) for r in license_scan.license_scan(frame(spark, docs)).collect()]
    want = []
    for i, t, _ in docs:
        ws = words_of(t)
        places = [k for p, _ in license_scan.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        labels = set()
        for text, label, must, without in license_scan.TEMPLATES:
            run, ts = license_scan.run_length(text), set(text.split())
            for k in range(max(1, len(ws) - run + 1)):
                held = set(ws[k : k + run])
                if set(must.split()) <= held and not held & set(without.split()) and len(held & ts) >= license_scan.needed(len(ts)):
                    labels.add(label)
        want.append((i, len(ws), len(places), min(places, default=None), max(places, default=None), sorted(labels)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert license_scan.license_scan(frame(spark, [])).count() == 0


#: Notices as their licences word them, wrapped and marked as in source files.
NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation",
    "lgpl": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is hereby granted",
    "": "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose and without fee is hereby granted",
    "bsd": "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software")',
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2 only.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
}


def test_license_scan_tells_neighbours_apart(spark):
    rng = random.Random(9)
    docs = [(i, f"{prose(rng, 40)}\n{prose(rng, 5)}\n{t}\n{prose(rng, 30)}\n{prose(rng, 9)}", "en") for i, t in enumerate(NOTICES.values())]
    wants = {i: {label} - {""} for i, label in enumerate(NOTICES)}
    others = ["Released under the Apache license, see the file", "This work is licensed under the GNU General Public License.", NOTICES["gpl"].split("\n")[0] + f"\n{prose(rng, 60)}\n" + NOTICES["gpl"].split("\n")[1], " ".join(f"{w} {prose(rng, 3)}" for w in NOTICES["bsd"].split())]
    docs += [(100 + i, t, "en") for i, t in enumerate(others)] + [(200, "\n".join(NOTICES["bsd"].split()), "en")]
    got = {r.doc_id: {x.label for x in r.found} for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert got == wants | {100 + i: set() for i in range(len(others))} | {200: {"bsd"}}


def test_decontamination(spark, rows):
    texts = {i: t for i, t, _ in rows}
    rng = random.Random(6)
    items = [(1, " ".join((texts[71]).split()[100:130])), (2, "zzz never seen " * 5), (3, texts[0]), (3, texts[0]), (4, None), (5, " "), (None, texts[5]), (6, " ".join(texts[40].split()[10:16]))]
    items += [(7, " ".join(texts[41].split()[3:5])), (8, texts[42].split()[1]), (9, " ".join(texts[40].split()[8:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [*rows, (None, texts[71]), (901, texts[40]), (901, texts[40]), (902, " ".join(texts[40].split()[9:30]) + prose(rng, 20))]
    docs = [(r[0], r[1], "en") for r in docs]
    found = decontamination.contamination(frame(spark, docs), bench)
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.select("*", decontamination.covered(F.col("spans")).alias("n_hit")).collect()]
    windows = set()
    for i, t in items:
        ws = words_of(t)
        if i is not None and ws:
            windows |= {(str(i), tuple(ws[k : k + 10])) for k in range(max(1, len(ws) - 9))}
    want = []
    for i, t, _ in docs:
        ws, hit, ids = words_of(t), set(), set()
        for item, w in windows:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    ids.add(item)
        want.append((i, len(ws), len(hit), tuple(sorted(ids))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert decontamination.contamination(frame(spark, docs), bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.contamination(frame(spark, []), bench).count() == 0


def test_decontamination_of_many_windows(spark):
    """More windows than the bitmap has bits for at its least size, by the same plan."""
    rng = random.Random(7)
    vocabulary = [prose(rng, 1) + str(k) for k in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=1000)) for _ in range(120)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontamination.item_windows(bench).count() > 100_000
    docs = [(k, f"{prose(rng, 30)} {' '.join(items[k].split()[50 * k : 50 * k + 12])} {prose(rng, 30)}", "en") for k in range(15)] + [(100 + k, " ".join(rng.choices(vocabulary, k=200)), "en") for k in range(10)]
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(frame(spark, docs), bench).select("*", decontamination.covered(F.col("spans")).alias("n_hit")).collect()}
    assert found == {k: (12, [str(k)]) for k in range(15)} | {100 + k: (0, []) for k in range(10)}


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tok = Tokenizer.from_file(path)
    tricky = [(80, "It's THE <|endoftext|> Ünïcode… don't!! ?!x 12,5 ß İstanbul école  a b.", "en"), (81, "naïve, naïve. (naïve) I'll 日本語。", "en")]
    rng = random.Random(4)
    marks = "aBé'1٣.,!?-_#$% \n\t<|>ßİǺ…—日ñ’\"\\x"
    tricky += [(100 + i, "".join(rng.choices(marks, k=rng.randint(1, 60))), "en") for i in range(300)]
    rows = rows + tricky
    got = packing.pack(packing.pieces(frame(spark, rows), path), group_pieces=30, max_docs=9).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want.append((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048 and len(b) <= 9
    for r in got:
        own = bins[r.sequence_id]
        assert (r.tokens_left, r.documents_left, r.cost_left) == (2048 - sum(n for _, n in own), 9 - len(own), 2048**2 - sum(n * n for _, n in own))
    assert packing.pack(packing.pieces(frame(spark, []), path)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 2049, 800)
    bins, offset = packing.best_fit(n, 2048, max_docs=3, max_cost=2048 * 2048 // 2 + 2048 * 1024, rule=rule)
    for b in range(bins.max() + 1):
        own = n[bins == b]
        assert own.sum() <= 2048 and len(own) <= 3 and ((own.astype(float) ** 2).sum() <= 2048 * 2048 // 2 + 2048 * 1024 or len(own) == 1)
    assert offset.max() < 2048


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "payload " * 40_000
    rows = [(5, "http://a/\r\nx", "h" * 100), (3, "u", "h" * 100), (9, None, "h" * 100), (4, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", big), (8, "u", big), (None, "u", "h" * 100), (1, "é", "é" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = str(tmp_path / "a")
    manifest = warc.write_archive(pages, folder, roll_bytes=2000, shard_rows=3)
    files = {r.file: r.sha256 for r in manifest.collect()}
    got = warc.read_archive(manifest, folder).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows) and len(files) > 2
    first = {"h" * 100: 3, big: 8, "é" * 60: 1}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h)
        again = f is not None and f != i
        want.append((None if i is None else str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(f) if again else None, None if again else b))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    # rows that share an id or have none are dealt by their digest
    same = [(None if k % 2 else 7, f"u{k}", f"{k:03d} " * 50) for k in range(400)] + [(k, "u", f"page {k}") for k in range(100)]
    alike = spark.createDataFrame(same, "page_id long, url string, html string")
    where = str(tmp_path / "d")
    listed = warc.write_archive(alike, where, shard_rows=20)
    assert len({r.shard for r in listed.collect()}) > 15
    assert sorted((str(r.page_id), r.payload_digest) for r in warc.read_archive(listed, where).collect()) == sorted((str(i), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in same)
    again = warc.write_archive(pages.repartition(3), str(tmp_path / "b"), roll_bytes=2000, shard_rows=3)
    assert {r.file: r.sha256 for r in again.collect()} == files
    assert warc.read_archive(warc.write_archive(pages.limit(0), str(tmp_path / "c")), str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize("most_fan", [256, 3])
def test_language_model(spark, rows, most_fan):
    docs = frame(spark, rows)
    rest = id_remainder(F.col("doc_id"), 10)
    got = lm_scoring.score_texts(docs.select("doc_id", "text", (rest == 0).alias("held_out"), (rest == 1).alias("deleted")), chunk_bytes=20_000, most_fan=most_fan).collect()
    end = object()
    tokens = [((t or "").encode().lower().split() + [end], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, i) for i, t, _ in rows]
    c = Counter(x for ws, held, _ in tokens if not held for x in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held, len(ws), sum(c[x] > 0 for x in ws), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws), 4)) for ws, held, i in tokens)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    # the mixture, from counts by hand
    pairs_of = lambda ws: list(zip(["<", *ws[:-1]], ws, strict=True))
    rest_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10

    def counts(keep):
        one, two, begin = Counter(), Counter(), 0
        for ws, _, i in tokens:
            if keep(rest_of(i)):
                one.update(ws)
                two.update(pairs_of(ws))
                begin += 1
        return one, two, lambda x: begin if x == "<" else one[x]

    one, two, context = counts(lambda r: r > 1)
    total, kinds, cells = sum(one.values()), len(one), Counter()
    for ws, _, i in tokens:
        if rest_of(i) == 1:
            for a, b in pairs_of(ws):
                p = (two[a, b] / max(1, context(a)), one[b] / max(1, total))
                logs = [round(lm_scoring.STEPS * math.log(x * (kinds + 1))) if x else lm_scoring.NONE * 10**6 for x in p]
                cells[int(lm_scoring.bucket(np.array([context(a)]))[0]), *logs] += 1
    weights = lm_scoring.mixture(sorted((*k, n) for k, n in cells.items()))
    one, two, context = counts(lambda r: r > 0)
    scores = []
    for ws, _, i in tokens:
        score = 0.0
        for a, b in pairs_of(ws):
            w = weights[int(lm_scoring.bucket(np.array([context(a)]))[0])]
            score += math.log10(w[0] * two[a, b] / max(1, context(a)) + w[1] * one[b] / n + w[2] / (v + 1))
        scores.append((str(i), len(ws), round(score, 3)))
    assert sorted(scores) == sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in got)
    assert lm_scoring.score_texts(docs.limit(0).select("doc_id", "text", F.lit(False).alias("held_out"), F.lit(False).alias("deleted"))).count() == 0


def test_mixture_recovers_weights():
    # tokens that the bigram explains a thousand times better than the others
    w = lm_scoring.mixture([(3, 8 * 9, 8 * 2, 900), (3, lm_scoring.NONE * 10**6, 8 * 2, 100)])
    assert w[3].argmax() == 0 and abs(w[3].sum() - 1) < 1e-9 and (w > 0).all()


def test_quality_classifier(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, rng.randint(20, 200)), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}{'#$%&'[k % 4] * 3}" for k, w in enumerate(prose(rng, 80).split())), "en") for i in range(40)]
    docs = frame(spark, good + bad + [(300, None, None), (301, "", None), (302, "x " * 60_000, None), (None, "a b", None), (0, "again", None)])
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good[:30]] + [(i, 0) for i, _, _ in bad[:20]] + [(0, 1), (None, 1), (5, None)], "doc_id long, label int")
    scored = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(scored) == 105 and all(0 <= r.score <= 1 for r in scored)
    by = {r.doc_id: r.score for r in scored}
    assert sum(by[i] >= 0.7 for i, _, _ in good[30:]) >= 28 and sum(by[i] < 0.7 for i, _, _ in bad[20:]) >= 19
    # the vote, neighbour by neighbour
    model = quality_classifier.fit(docs, labels)
    texts = [(t or "").encode() for _, t, _ in good + bad]
    for t, score in zip(texts, model.score(texts), strict=True):
        vector = model.project(quality_classifier.features([t]))[0]
        cosines = [float(vector @ other) for other in model.vectors]
        chosen = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: model.k]
        votes = [max(0.0, cosines[j]) ** model.power for j in chosen]
        assert score == pytest.approx(sum(v * model.labels[j] for v, j in zip(votes, chosen, strict=True)) / sum(votes), abs=1e-3)
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score_documents(docs, None).collect()} == {0.5}
    assert quality_classifier.good_documents(docs, quality_classifier.fit(docs, labels), 0.7).columns == docs.columns
    assert quality_classifier.score_documents(docs.limit(0), quality_classifier.fit(docs, labels)).count() == 0


def test_neighbours_tie_in_order():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [0.1, 0.2, 0.3, 0.4, 0.5]], np.float32)
    assert [sorted(x) for x in quality_classifier.nearest(near, 2).tolist()] == [[0, 1], [0, 1], [3, 4]]


def hashed_grams(data, dims, n):
    """Counts of byte n-grams by hand."""
    out = np.zeros(dims)
    for k in range(len(data) - n + 1):
        h = 0
        for b in data[k : k + n]:
            h = (h * 0x01000193 + b) % 2**32
        out[h * 0x9E3779B1 % 2**32 >> (32 - dims.bit_length() + 1)] += 1
    return out


def test_language_id_learns_from_rows_without_ids(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, 20) + " the", "en") for _ in range(300)] + [(7, "ß " + prose(rng, 20), "de") for _ in range(300)] + [(None, "le même", "fr")] * 300
    docs = frame(spark, rows)
    model = language_id.fit(docs, per_language=5)
    assert model.members == {"germanic": ["de", "en"], "romance": ["fr"]}


def test_language_id(spark):
    rng = random.Random(3)
    parts = {"en": "th er ing the of and wh".split(), "de": "sch ung keit der die und ß".split(), "fr": "eau é ç que les ment oi".split(), "es": "ción ñ los que ll rr ado".split()}
    text = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 30)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 ###", "en"), (203, text("de"), None), (None, text("fr"), "fr")]
    model = language_id.fit(frame(spark, rows[:80] + odd), per_language=15)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(frame(spark, rows + odd), model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[80:])
    assert [got[i][0] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= s <= 1 for _, s in got.values())
    # families, then votes of pairs, by hand
    for i, t, _ in rows[80:100]:
        data = b" " + b" ".join(t.lower().encode().translate(language_id.FOLD).split()) + b" "
        x = np.sqrt(np.concatenate([hashed_grams(data, 256, 1), hashed_grams(data, 4096, 2), hashed_grams(data, 4096, 3)]))
        x = np.append(x / np.linalg.norm(x), 1.0)
        family = max(sorted(model.members), key=lambda f: x @ model.families[f])
        votes = Counter(a if x @ w > 0 else b for (a, b), w in model.pairs.items() if language_id.family(a) == family)
        assert got[i][0] == max(model.members[family], key=lambda lang: votes[lang])
        pairs = [float(x @ w) * (1 if got[i][0] == a else -1) for (a, b), w in model.pairs.items() if got[i][0] in (a, b)]
        logistic = lambda m: 1 / (1 + math.exp(-2 * max(-20, min(20, m))))
        assert got[i][1] == pytest.approx(logistic(x @ model.families[family]) * logistic(min(pairs)), abs=1e-3)
    empty = language_id.predict_language(frame(spark, []), model)
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang_pred", "score"]
    assert language_id.fit(frame(spark, [])) is None
    assert {r.lang_pred for r in language_id.predict_language(frame(spark, rows[:4]), None).collect()} == {"und"}

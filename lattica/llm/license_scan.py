"""Licence scan as an exact set-similarity join of text blocks and licence templates.

A block is a run of words, wherever lines end: a quarter more words than the template's
text has, so that a notice may be wrapped, marked as a comment or hold some words more,
and no long line matches on scattered words. A block meets a template if it holds at
least the stated share (0.8) of the template's distinct words, all words that the
template requires (those that tell it from its neighbours: nc, sa, mit, a version) and
none that it excludes (lesser, affero).

Words are ordered globally by the number of documents that hold them, rarest first. The
join key is a word of the template's prefix (its first |T| - ceil(0.8 |T|) + 1 words in
that order, of which every matching block holds one). Around each place of a key stand
the words that a block with it can reach: the length filter asks for enough template
words among them, the positional filter for enough of them from the key on. Containment is then
computed exactly for each block around the key.

DataFrame functions only. The template table is a fixed list, so its words are literals
and it is broadcast. Texts are matched by the two 64-bit hashes of their content, so rows
with null or repeated doc_ids and repeated rows each get their text's result. Null and
empty texts have no words, places or labels; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import DUCK_WORDS, known_set, text_keys, words_of

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Sentences of public licence notices, the label of each, words that must and words that must not stand in the block.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2", ""),
    ("released under the mit license", "mit", "mit license", ""),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "granted associated files", ""),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1.0", "granted organization accompanying", ""),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "gnu general 3", "lesser library affero"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", "gnu general 2", "lesser library affero"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3.0", "gnu lesser 3", "affero"),
    ("this work is licensed under the gnu affero general public license version 3", "agpl-3.0", "gnu affero 3", "lesser library"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "redistribute gnu general", "lesser library affero"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "redistribute gnu lesser", "affero"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", "redistribute gnu affero", "lesser library"),
    ("licensed under cc by 4 0", "cc-by", "cc by 4", "nc nd sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc", "nd sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd", "nc sa"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa", "nc nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa", "nd"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "cc by nc nd", "sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution", "noncommercial noderivatives sharealike"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "creative commons noncommercial", "noderivatives sharealike"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", "creative commons sharealike", "noncommercial noderivatives"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution binary permitted", ""),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla 2", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "copy modify distribute fee", "documentation"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered public domain", ""),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2.0", "eclipse 2", ""),
    ("unauthorized copying distribution or reproduction of this content is strictly prohibited", "proprietary", "unauthorized prohibited", ""),
)
SHARE = 0.8


def needed(size: int, share: float = SHARE) -> int:
    return math.ceil(share * size - 1e-9)


def run_length(text: str, share: float = SHARE) -> int:
    """Words of a block: so many that a share of them may be foreign."""
    return math.ceil(len(text.split()) / share - 1e-9)


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first; one row a word reaches the driver."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col("text")))
    counts = {r.word: r["count"] for r in docs.select(F.explode_outer(held).alias("word")).filter("word IS NOT NULL").groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def starts(phrase: str) -> Column:
    """Word positions at which the phrase stands in the array `words`."""
    first, *rest = phrase.split()
    follow = " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1)) or "true"
    return F.expr(f"IF(array_contains(words, '{first}'), filter(transform(words, (w, i) -> IF(w = '{first}' AND {follow}, i, NULL)), x -> x IS NOT NULL), CAST(array() AS array<int>))")


PREFIX = "label string, template_words array<string>, must array<string>, without array<string>, need int, length int, template_at int, key string"


def prefixes(templates: tuple, order: list[str], share: float) -> list[tuple]:
    """A row (as in PREFIX) a template and prefix word, in the global order of words."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for text, label, must, without in templates:
        ws = sorted(set(text.split()), key=rank.get)
        need = needed(len(ws), share)
        rows += [(label, ws, must.split(), without.split(), need, run_length(text, share), i, w) for i, w in enumerate(ws[: len(ws) - need + 1])]
    return rows


def matches(docs: DataFrame, templates: tuple = TEMPLATES, share: float = SHARE) -> DataFrame:
    """k1, k2 (a text's key) and `found`, the set of (label, containment) of matched templates; only texts with any. A written table."""
    vocabulary = sorted({w for t in templates for w in t[0].split()})
    if not all(re.fullmatch(r"[0-9a-z\x80-\U0010ffff]+", w) for w in vocabulary):
        raise ValueError("a template's text must be words that single spaces part")
    order = document_frequency(docs, vocabulary)
    listed = prefixes(templates, order, share)
    prefix = docs.sparkSession.createDataFrame(listed, PREFIX)
    keys = sorted({r[-1] for r in listed}, key=order.index)
    least = min(needed(len(set(t[0].split())), share) for t in templates)
    reach = max(run_length(t[0], share) for t in templates) - 1
    rows = docs.select(*text_keys(), words_of(F.col("text")).alias("words"))
    # what a block with the key can reach, where it holds enough of any template
    near = F.expr(
        f"""IF(arrays_overlap(words, array({known_set(keys)})),
          filter(transform(words, (w, i) -> IF(w IN ({known_set(keys)}), struct(w AS key, CAST(least(i, {reach}) AS int) AS off, slice(words, greatest(i - {reach}, 0) + 1, least(i, {reach}) + {reach + 1}) AS near), NULL)),
                 r -> r IS NOT NULL AND size(array_intersect(r.near, array({known_set(order)}))) >= {least}),
          CAST(array() AS array<struct<key: string, off: int, near: array<string>>>))"""
    )
    # (outer, so that no test of the array's size is pushed below and the text split again for it)
    places = rows.select("k1", "k2", F.explode_outer(near).alias("p")).filter("p IS NOT NULL").select("k1", "k2", "p.*")
    joined = places.join(F.broadcast(prefix), "key")  # some rows a template
    held = F.array_intersect("template_words", "near")
    # length filter, then the positional one: words before the key that are there, and all from the key on
    long_enough = F.size(held) >= F.col("need")
    before = F.size(F.array_intersect(F.expr("slice(template_words, 1, template_at)"), "near"))
    placed = before + F.size("template_words") - F.col("template_at") >= F.col("need")
    able = joined.filter(long_enough & placed).withColumn("reached", F.expr("slice(near, greatest(off - length + 1, 0) + 1, least(off, length - 1) + length)"))
    best = F.expr(
        """array_max(transform(transform(sequence(0, greatest(size(reached) - length, 0)), i -> slice(reached, i + 1, length)),
             b -> IF(size(array_except(must, b)) = 0 AND NOT arrays_overlap(b, without), size(array_intersect(template_words, b)), 0)))"""
    )
    found = able.withColumn("held", best).filter("held >= need")
    return written(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("label", (F.col("held") / F.size("template_words")).alias("containment"))).alias("found")), "licences")


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, the places of base phrases, and `found`: the set of (label, containment) of matched templates; a row a row of docs."""
    found = matches(docs.select("text"), templates, share)
    base = docs.select("doc_id", *text_keys(), words_of(F.col("text")).alias("words"))
    base = base.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.array(*[starts(p) for p, _ in PHRASES]).alias("places"))
    place = lambda f: F.expr(f"{f}(flatten(places))").cast("long").alias
    base = base.select(
        "doc_id", "k1", "k2", "n_words", F.expr("cast(size(flatten(places)) AS long)").alias("n_base"), place("array_min")("first_word"), place("array_max")("last_word"),
        F.filter(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()).alias("base_set"),
    )
    none = F.array().cast(found.schema["found"].dataType)
    return base.join(found, ["k1", "k2"], "left").withColumn("found", F.coalesce("found", none)).drop("k1", "k2")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_set", F.transform("found", lambda x: x.label))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.containment)), F.lit(0.0)))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _oracle() -> str:
    phrases = "\n UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE " + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    listed = lambda x: f"string_split('{x}', ' ')" if x else "[]::VARCHAR[]"
    templates = ", ".join(f"('{label}', list_distinct({listed(text)}), {listed(must)}, {listed(without)}, {run_length(text)})" for text, label, must, without in TEMPLATES)
    return f"""
WITH w AS (SELECT doc_id, text AS t, {DUCK_WORDS.replace("(t,", "(text,")} AS ws FROM documents),
p AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
k AS (SELECT doc_id, label, ts, must, without, ws[s:s + run - 1] AS bs FROM (SELECT doc_id, ws, label, ts, must, without, run, unnest(range(1, greatest(len(ws) - run + 1, 1) + 1)) AS s
      FROM w, (VALUES {templates}) AS t(label, ts, must, without, run) WHERE list_has_all(ws, must))),
m AS (SELECT doc_id, label, len(list_intersect(ts, bs)) / len(ts) AS c, len(list_intersect(ts, bs)) AS n, len(ts) AS size FROM k WHERE list_has_all(bs, must) AND NOT list_has_any(bs, without)),
f AS (SELECT doc_id, label, c FROM m WHERE n >= ceil({SHARE} * size - 1e-9)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM f) GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS c FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP4_SQL = _oracle()

"""License scans: phrases, and an exact set-similarity join of blocks of text with license notices. SQL functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: What separates words: ASCII characters that are neither digits nor letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates paragraphs: a line of white space only.
GAP = r"\n[\x20\x09-\x0D]*\n"
#: Phrases whose words are looked up one after the other, and their labels. Fixed values.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Notices by label, looked up in single lines or in paragraphs. The licenses' own words.
NOTICES = [
    ("line", "mit", "released under the mit license"),
    ("line", "apache-2.0", "licensed under the apache license version 2 0"),
    ("line", "bsd-3-clause", "released under the bsd 3 clause license"),
    ("line", "gpl-2.0", "licensed under the gnu general public license version 2"),
    ("line", "gpl-3.0", "licensed under the gnu general public license version 3"),
    ("line", "lgpl", "licensed under the gnu lesser general public license"),
    ("line", "agpl", "licensed under the gnu affero general public license"),
    ("line", "cc-by-4.0", "licensed under cc by 4 0"),
    ("line", "cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("line", "cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("line", "cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("line", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("paragraph", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("paragraph", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("paragraph", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("paragraph", "bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("paragraph", "apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("paragraph", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version"),
    ("paragraph", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
]
#: A block meets a notice if it contains nine in ten of the notice's different words.
CONTAINED = (9, 10)


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN, -1), "")


def need(size: int) -> int:
    """How many of the different words of a notice a block must contain."""
    return -(-CONTAINED[0] * size // CONTAINED[1])


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def frequency_order(docs: DataFrame, text: str = "text") -> list[str]:
    """The words of the notices, those in the fewest of all texts first. The notices bound what reaches the driver."""
    known = sorted({w for _, _, notice in NOTICES for w in notice.split()})
    seen = docs.select(F.explode(F.array_intersect(_strings(known), words(lowered(text_of(text))))).alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in seen.collect()}
    return sorted(known, key=lambda w: (often.get(w, 0), w))


def _starts(w: Column, phrase: str) -> Column:
    """The numbers of the words where the phrase begins."""
    parts = phrase.split()

    def here(x: Column, i: Column) -> Column:
        fits = x == parts[0]
        for k, part in enumerate(parts[1:], 1):
            fits = fits & (F.get(w, i + k) == part)
        return F.when(fits, i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_base (places of phrases), first_word and last_word (the least and
    greatest of their starts, or null), base_labels and labels (different ones, sorted, joined by commas), score, and found,
    an array of (kind, block, label, contained) of the blocks that meet a notice, numbered from 0 by kind.

    The set-similarity join is exact. The notices' words are ordered by the number of texts that they are in; a block is the
    set of its words that any notice has, in this order. A block that contains need(n) of a notice's n words has one of the
    n - need(n) + 1 rarest (prefix filter), need(n) words itself (length filter), and, where its j-th word is the notice's i-th
    and the first that both have, min(n - i, size - j) more at most (positional filter). What passes is counted out. Blocks are
    lines, and paragraphs between lines of white space. score is the greatest containment of a block that meets a notice, 1 where a
    phrase is found, else 0.

    Null and empty texts have no words and no labels. Rows are judged one by one, so repeated rows and ids come out as often as
    they are there; an empty table gives an empty result; other columns are ignored."""
    spark, order = docs.sparkSession, frequency_order(docs)
    rank = {w: i for i, w in enumerate(order)}
    notices = [sorted(set(notice.split()), key=rank.get) for _, _, notice in NOTICES]
    index = [(kind, w, no, i + 1, len(n), need(len(n)), label) for no, ((kind, label, _), n) in enumerate(zip(NOTICES, notices)) for i, w in enumerate(n[: len(n) - need(len(n)) + 1])]
    prefixes = sorted({r[1] for r in index}, key=rank.get)
    least = min(need(len(n)) for n in notices)
    heads = [p.split()[0] for p, _ in PHRASES]

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lowered(text_of()).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    rows = rows.withColumn("present", F.array_intersect(_strings(dict.fromkeys(heads + prefixes)), F.col("w")))
    places = F.array(*[F.when(F.array_contains("present", head), _starts(F.col("w"), p)).otherwise(F.array().cast("array<int>")) for head, (p, _) in zip(heads, PHRASES)])
    rows = rows.select("row", "doc_id", "text", F.size("w").cast("long").alias("n_words"), "present", places.alias("places"))

    def block(kind: str):
        return lambda text, i: F.struct(F.lit(kind).alias("kind"), i.alias("block"), F.array_intersect(_strings(order), words(text)).alias("has"))

    blocks = F.concat(F.transform(F.split("text", "\n", -1), block("line")), F.transform(F.split("text", GAP, -1), block("paragraph")))
    fit = F.filter(blocks, lambda b: F.size(b["has"]) >= least)
    maybe = F.when(F.arrays_overlap("present", _strings(prefixes)), F.transform(fit, lambda b: b.withField("firsts", F.array_intersect(b["has"], _strings(prefixes)))))
    base = F.flatten("places")
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, label) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())))
    rows = rows.select(
        "row", "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        labels.alias("phrases"), F.explode_outer(maybe).alias("b"),
    )
    told = ["doc_id", "n_words", "n_base", "first_word", "last_word", "phrases"]
    tried = rows.select("row", *told, "b.kind", "b.block", "b.has", F.explode_outer("b.firsts").alias("word")).withColumn("j", F.array_position("has", F.col("word")))
    of = spark.createDataFrame(index, "kind string, word string, notice int, i int, size int, need int, label string")
    met = tried.join(F.broadcast(of), ["kind", "word"], "left")  # the notices bound the index
    possible = (F.size("has") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i"), F.size("has") - F.col("j")) >= F.col("need"))
    shared = F.when(possible, F.size(F.array_intersect("has", F.get(F.array(*[_strings(n) for n in notices]), F.col("notice")))))
    met = met.withColumn("shared", shared)
    one = F.when(F.col("shared") >= F.col("need"), F.struct("kind", "block", "label", (F.col("shared") / F.col("size")).alias("contained")))
    out = met.groupBy("row").agg(*[F.first(c).alias(c) for c in told], F.array_sort(F.collect_set(one)).alias("found"))
    every = F.array_sort(F.array_union("phrases", F.transform("found", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["contained"])), F.lit(0.0))
    score = F.greatest(best, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("phrases", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "found"
    )


def sql() -> str:
    """DuckDB SQL for scan() without found: every block against every notice."""
    listed = ", ".join(f"({i}, '{kind}', '{label}', {sorted(set(notice.split()))})" for i, (kind, label, notice) in enumerate(NOTICES))
    heads = [p.split() for p, _ in PHRASES]
    fits = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p)) + ")" for p in heads)
    label = "CASE " + " ".join(f"WHEN w[i] = '{p[0]}' THEN '{name}'" for p, (_, name) in zip(heads, PHRASES)) + " END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce("text", ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents),
d AS (SELECT *, list_filter(regexp_split_to_array(t, '{BETWEEN}'), lambda x: x <> '') AS w FROM t),
p AS (SELECT r, i - 1 AS start, {label} AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {fits}),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
n AS (SELECT * FROM (VALUES {listed}) AS v(notice, kind, label, has)),
k AS (SELECT r, 'line' AS kind, unnest(string_split(t, chr(10))) AS b FROM d UNION ALL SELECT r, 'paragraph', unnest(regexp_split_to_array(t, '{GAP}')) FROM d),
s AS (SELECT r, kind, list_distinct(list_filter(regexp_split_to_array(b, '{BETWEEN}'), lambda x: x <> '')) AS has FROM k),
m AS (SELECT r, label, len(list_intersect(s.has, n.has)) AS shared, len(n.has) AS size FROM s JOIN n USING (kind)),
f AS (SELECT r, label, shared / size AS contained FROM m WHERE {CONTAINED[1]} * shared >= {CONTAINED[0]} * size),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION ALL SELECT r, label FROM p) GROUP BY r),
c AS (SELECT r, max(contained) AS best FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)
"""

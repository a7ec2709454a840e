"""Licence scan by a positional rare-token index, in DataFrame functions only.

The words of a fixed set of licence notices form a vocabulary.  How many
documents hold each of its words is counted over the whole corpus.  Of each
notice the `PER_NOTICE` different words with the highest IDF go to the index (word ->
notice, place), and of each of its mandatory phrases the `PER_PHRASE` such words, however
frequent they are: where the phrases stand, enough postings agree, so the index
loses no notice in any document.  A document looks up its words, intersects the postings by relative
position, and a notice is found where at least two postings (or all of a notice
that has fewer) agree on one offset and each mandatory phrase of the notice stands
in the text.

Null text is empty; a document without words has no labels and a score of 0; a
text of any length is scanned whole.  Rows are independent, so repeated rows,
ties, null ids and further columns, whatever their names, pass through (an added
column replaces one of its name); an empty table gives none.  Only the counts, at
most one row for each word of the notices, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.quality import let

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice and mandatory phrases, in words as the scan sees them.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software foundation", "general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "this work is licensed under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]

_POSTINGS = [(w, t, p) for t, (_, notice, _) in enumerate(NOTICES) for p, w in enumerate(notice.split())]
VOCABULARY = sorted({w for w, _, _ in _POSTINGS})
PER_NOTICE, PER_PHRASE, MIN_VOTES = 4, 2, 2
#: Each notice as a whole and each of its phrases, with the number of words of it that are indexed.
_INDEXED = [(t, part, PER_NOTICE if k == 0 else PER_PHRASE) for t, (_, notice, phrases) in enumerate(NOTICES) for k, part in enumerate([notice, *phrases])]

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAIR = "array<struct<t:int,o:int>>"


def normalised(text: Column) -> Column:
    """The words of a text with one space before, between and after; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(" ")), _NOT_WORD, " ")


def _split(spaced: Column) -> Column:
    return F.when(F.length(spaced) > 1, F.split(F.btrim(spaced), " ")).otherwise(F.array().cast("array<string>"))


def document_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Number of documents that hold each vocabulary word."""
    seen = docs.select(F.array_distinct(F.filter(_split(normalised(F.col(text))), lambda w: w.isin(VOCABULARY))).alias("w"))
    return {r["w"]: r["n"] for r in seen.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def rare_postings(counts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, notice, place) of the rarest words of each notice and of its phrases."""
    chosen = {(w, t) for t, part, most in _INDEXED for w in sorted(set(part.split()), key=lambda w: (counts.get(w, 0), w))[:most]}
    return [(w, t, p) for w, t, p in _POSTINGS if (w, t) in chosen]


def _phrase_places(words: Column, spaced: Column, phrase: str) -> Column:
    parts = phrase.split()
    wanted = F.array(*[F.lit(p) for p in parts])
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    places = F.filter(starts, lambda i: F.slice(words, i + 1, len(parts)) == wanted)
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score."""
    postings = rare_postings(document_counts(docs, text) if counts is None else counts)
    sizes = [sum(1 for _, t, _ in postings if t == k) for k in range(len(NOTICES))]
    by_word: dict[str, list[tuple[int, int]]] = {}
    for w, t, p in postings:
        by_word.setdefault(w, []).append((t, p))

    # the given columns stay together in one, so that no name of theirs meets one of this scan
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), normalised(F.col(text)).alias("_spaced"))
    out = out.withColumn("_words", _split(F.col("_spaced")))
    out = out.withColumns({f"_at_{k}": _phrase_places(F.col("_words"), F.col("_spaced"), p) for k, p in enumerate(BASE)})
    out = out.withColumn("_at", F.concat(*[F.col(f"_at_{k}") for k in range(len(BASE))]))
    base_labels = [F.when(F.size(f"_at_{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, label in enumerate(BASE.values())]

    index = F.expr("map(" + ", ".join(f"'{w}', array(" + ", ".join(f"named_struct('t', {t}, 'p', {p})" for t, p in at) + ")" for w, at in by_word.items()) + ")")
    known = list(by_word)
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(known))
    hits = F.when(F.exists("_words", lambda w: w.isin(known)), hits).otherwise(F.expr("cast(array() as array<struct<w:string,i:int>>)"))
    out = out.withColumn("_hits", hits)
    aligned = F.flatten(F.transform("_hits", lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("o")))))
    out = out.withColumn("_pairs", F.sort_array(aligned))

    def runs(pairs: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (F.get(pairs, i - 1) != F.get(pairs, i)))
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(pairs, i)["t"].alias("t"), (F.coalesce(F.get(f, k + 1), F.size(pairs)) - i).alias("n"))))

    out = out.withColumn("_runs", F.when(F.size("_pairs") > 0, let(F.col("_pairs"), runs)).otherwise(F.expr("cast(array() as array<struct<t:int,n:int>>)")))

    def votes_of(t: int) -> Column:
        return F.array_max(F.transform(F.filter("_runs", lambda x: x["t"] == t), lambda x: x["n"]))

    found, scores = [], []
    for t, (label, _, phrases) in enumerate(NOTICES):
        votes = votes_of(t)
        verified = votes >= min(MIN_VOTES, sizes[t])
        for phrase in phrases:
            verified = verified & F.contains("_spaced", F.lit(f" {phrase} "))
        verified = F.coalesce(verified, F.lit(False))
        found.append(F.when(verified, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
        scores.append(F.when(verified, votes / F.lit(sizes[t])).otherwise(F.lit(0.0)))
    joined = lambda parts: F.array_join(F.sort_array(F.array_distinct(F.concat(*parts))), ",")
    any_base = F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    added = {
        "n_words": F.size("_words").cast("long"),
        "n_base": F.size("_at").cast("long"),
        "first_word": F.array_min("_at").cast("long"),
        "last_word": F.array_max("_at").cast("long"),
        "base_labels": joined(base_labels),
        "labels": joined(base_labels + found),
        "score": F.greatest(any_base, F.lit(0.0), *scores),
    }
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text")


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    postings = ", ".join(f"({quote(w)}, {t}, {p})" for w, t, p in _POSTINGS)
    notices = ", ".join(f"({t}, {quote(label)}, [{', '.join(quote(f' {x} ') for x in phrases)}])" for t, (label, _, phrases) in enumerate(NOTICES))
    indexed = ", ".join(f"({k}, {t}, {quote(w)}, {most})" for k, (t, part, most) in enumerate(_INDEXED) for w in part.split())
    base = ", ".join(f"({quote(p)}, {len(p.split())}, {quote(v)})" for p, v in BASE.items())
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(' ' || translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') || ' ', '{_NOT_WORD}', ' ', 'g') AS s FROM documents),
split AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS words FROM base),
phrases(phrase, size, label) AS (VALUES {base}),
notices(t, label, phrases) AS (VALUES {notices}),
postings(w, t, p) AS (VALUES {postings}),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM split),
grams AS (SELECT r, i, w AS a, w || ' ' || lead(w, 1) OVER o AS b, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS c
          FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
base_hits AS (SELECT r, i, label FROM grams JOIN phrases ON phrase = CASE size WHEN 2 THEN b ELSE c END),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base_hits GROUP BY r),
df AS (SELECT w, count(DISTINCT r) AS n FROM placed WHERE w IN (SELECT w FROM postings) GROUP BY w),
indexed(part, t, w, most) AS (VALUES {indexed}),
ranked AS (SELECT t, w, row_number() OVER (PARTITION BY part ORDER BY n, w) AS k, most
           FROM (SELECT DISTINCT part, t, i.w, most, coalesce(df.n, 0) AS n FROM indexed i LEFT JOIN df ON df.w = i.w)),
used AS (SELECT w, t, p FROM postings WHERE (w, t) IN (SELECT (w, t) FROM ranked WHERE k <= most)),
sizes AS (SELECT t, count(*) AS size FROM used GROUP BY t),
votes AS (SELECT r, t, i - p AS o, count(*) AS n FROM placed JOIN used USING (w) GROUP BY r, t, i - p),
best AS (SELECT r, t, max(n) AS n FROM votes GROUP BY r, t),
verified AS (
  SELECT b.r, label, CAST(n AS DOUBLE) / size AS score FROM best b JOIN sizes USING (t) JOIN notices USING (t) JOIN split ON split.r = b.r
  WHERE n >= least({MIN_VOTES}, size) AND len(list_filter(notices.phrases, lambda x: NOT contains(s, x))) = 0),
matched AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM verified GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(matched.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(matched.score, 0.0) END::DOUBLE AS score
FROM split LEFT JOIN based USING (r) LEFT JOIN matched USING (r)"""


ORACLE = _oracle()

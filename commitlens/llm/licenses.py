"""Licence scan with a positional index of rare words.

Licence notices are kept as templates. Their words are indexed: for each, the
templates and places where it stands. A file that holds all words of a template's
mandatory key phrases looks up these words by IDF over all documents, the rarest first: its
places in the file, less its place in the template, are the positions where the notice may begin,
and the postings of the other key words are intersected with them by relative position. Where the
phrases stand at exactly those places and at least half of the template's words agree, the
label is given. IDF only orders the work: however common a word is, or however many notices
a file holds, nothing is left out. All of it runs on a row's own arrays, with DataFrame
functions only; the one shuffle is the count of documents per licence word (a row per word and task).

Edge cases: a null text is empty; a file without words has no places and no
labels, score 0; a notice cut off at either end counts by the words that are there; of equally
rare words the first by spelling is looked up; rows that repeat are scanned each; very long texts are whole
arrays of words; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, words of a notice, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed to the apache software foundation under one or more contributor license agreements", ("apache software foundation",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under the creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a template's places, the share that must agree on a position.
AGREE = 0.5


def words_of(text: str | Column) -> Column:
    """The words of a lower-cased text, in order. Lower-casing other letters than A-Z changes no word's place or number."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def stands(words: Column, at: Column, phrase: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.get(words, at + i) == w for i, w in enumerate(phrase)))


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; files that lack one of them aren't searched."""
    parts = phrase.split()
    has = reduce(lambda a, b: a & b, (F.array_contains(words, w) for w in parts))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: stands(words, i, parts))
    return F.when(has & (F.size(words) >= len(parts)), places).otherwise(F.array().cast("array<int>"))


def licence_idf(words: DataFrame) -> dict[str, float]:
    """IDF over all documents of the licence words. At most a row per licence word comes to the driver."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    # "" stands for the document itself
    held = words.select(F.explode(F.array_append(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), "")).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def key_places(parts: list[str], keys: tuple[str, ...]) -> list[tuple[int, str]]:
    """Place and word of the key phrases' words in a template's."""
    found = set()
    for phrase in map(str.split, keys):
        first = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
        found |= {(first + i, w) for i, w in enumerate(phrase)}
    return sorted(found)


def verified(words: Column, template: tuple[str, str, tuple[str, ...]], idf: dict[str, float]) -> Column:
    """label and share for each position at which a template's key phrases stand and enough of its words agree."""
    label, text, keys = template
    parts = text.split()
    by_rarity = sorted(key_places(parts, keys), key=lambda x: (-idf[x[1]], x[1], x[0]))
    (offset, rarest), *others = by_rarity
    holds = reduce(lambda a, b: a & b, (F.array_contains(words, w) for w in dict.fromkeys(w for _, w in by_rarity)))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == rarest)
    fits = reduce(lambda a, b: lambda i: a(i) & b(i), ((lambda i, o=o, w=w: F.get(words, i + (o - offset)) == w) for o, w in others), lambda i: F.lit(True))
    agree = lambda i: sum((F.get(words, i + (j - offset)).eqNullSafe(F.lit(w)).cast("int") for j, w in enumerate(parts)), F.lit(0))
    hits = F.transform(F.filter(places, fits), lambda i: F.struct(F.lit(label).alias("label"), (agree(i) / F.lit(len(parts))).cast("double").alias("share")))
    return F.when(holds, F.filter(hits, lambda h: h["share"] >= AGREE)).otherwise(F.array().cast("array<struct<label:string,share:double>>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, and the labels and score (best share of agreeing places) of verified templates."""
    words = docs.select("doc_id", words_of("text").alias("words"))
    idf = licence_idf(words)
    found = words.select(
        "doc_id",
        F.size("words").alias("n_words"),
        *[phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)],
        F.concat(*(verified(F.col("words"), t, idf) for t in TEMPLATES)).alias("hits"),
    )
    places = F.array_union(F.array_union("p0", "p1"), "p2")
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    n_base = sum((F.size(f"p{i}") for i in range(len(PHRASES))), F.lit(0))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """The query over ``documents`` in DuckDB's SQL, by joins on words and places."""
    rows = lambda items: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in items)
    template = [(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    labels = [(t, label) for t, (label, _, _) in enumerate(TEMPLATES)]
    keys = [(t, i, w) for t, (_, text, phrases) in enumerate(TEMPLATES) for i, w in key_places(text.split(), phrases)]
    base = []
    for phrase, label in PHRASES:
        first, *rest = phrase.split()
        joins = " ".join(f"JOIN place p{i} ON p{i}.rid = p.rid AND p{i}.i = p.i + {i} AND p{i}.word = '{w}'" for i, w in enumerate(rest, 1))
        base.append(f"SELECT p.rid, p.i, '{label}' AS label FROM place p {joins} WHERE p.word = '{first}'")
    return f"""
    WITH files AS (
      SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
      FROM documents),
    place AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM files),
    template(t, pos, word) AS (VALUES {rows(template)}),
    named(t, label) AS (VALUES {rows(labels)}),
    keyed(t, pos, word) AS (VALUES {rows(keys)}),
    standing AS (SELECT p.rid, k.t, p.i - k.pos AS start, count(*) AS n FROM place p JOIN keyed k ON k.word = p.word GROUP BY ALL),
    stand AS (SELECT rid, t, start FROM standing JOIN (SELECT t, count(*) AS keys FROM keyed GROUP BY t) USING (t) WHERE n = keys),
    agreed AS (
      SELECT s.rid, s.t, s.start, count(*) AS n FROM stand s JOIN template x ON x.t = s.t JOIN place p ON p.rid = s.rid AND p.i = s.start + x.pos AND p.word = x.word GROUP BY ALL),
    hits AS (
      SELECT rid, label, CAST(n AS DOUBLE) / places AS share FROM agreed JOIN (SELECT t, count(*) AS places FROM template GROUP BY t) USING (t) JOIN named USING (t)
      WHERE CAST(n AS DOUBLE) / places >= {AGREE}),
    base AS ({' UNION ALL '.join(base)}),
    by_base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
    by_label AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM hits UNION SELECT rid, label FROM base) GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
    FROM files LEFT JOIN by_base USING (rid) LEFT JOIN by_label USING (rid) LEFT JOIN (SELECT rid, max(share) AS score FROM hits GROUP BY rid) USING (rid)"""

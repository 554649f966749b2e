r"""License scan by a positional index of rare licence words, in DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. A template is a passage
of a licence, a licence notice or the bare name of a licence, with key phrases that are mandatory.

1. ``weights`` counts in how many documents of the whole corpus each licence word stands. A word's weight
   is its inverse document frequency, as an integer, so that sums are exact.
2. ``index`` takes of each template's mandatory words the one of highest weight: (word, template,
   position in the template). It has a row for each template, so it is part of the plan.
3. A file's words that are in the index are looked up with their positions. A posting at ``at`` and a word
   at ``i`` put the template at ``i - at``; the posting is intersected with the template's other mandatory words
   at their relative positions, by direct access, so a file of n hits costs n times a template's length.
   Where all key phrases stand, the share of the template's weight that stands in place is the place's score.

A place needs all its mandatory words, the rarest among them, so looking up one word a template loses no
place, whatever the weights are; they decide the cost and the score. A row is finished in the task that
reads it: nothing is shuffled but one count for each licence word and task.

Score of a file: the greatest share over its places of passages and notices; the bare name of a licence
counts NAMED, no place 0.

Defined results: a null or empty text has no words, no labels and score 0; a null doc_id stays null; repeated
rows are scanned alike; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, lower_ascii

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NAMED = 0.5

# Names, notices and passages of licences (public texts). Key phrases stand in brackets.
NAMES = (
    ("mit", "[mit license]"),
    ("apache", "[apache license]"),
    ("gpl", "[general public license]"),
)
PASSAGES = (
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and [associated documentation files]"),
    ("apache", "licensed under the [apache license version] 2 0"),
    ("apache", "you may not use this file except [in compliance with the license]"),
    ("gpl", "this work is licensed under the gnu [general public license version]"),
    ("gpl", "it [under the terms of the gnu general public license] as published by the free software foundation"),
    ("lgpl", "it under the terms of the gnu [lesser general public license] as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu [affero general public license] as published by the free software foundation"),
    ("mpl", "this source code form is [subject to the terms of the mozilla public license]"),
    ("epl", "made available [under the terms of the eclipse public license]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that]"),
    ("isc", "[permission to use copy modify and] or distribute this software [for any purpose with or without fee]"),
    ("zlib", "altered source versions must be plainly [marked as such and must not be misrepresented]"),
    ("boost", "[obtaining a copy of the software and accompanying documentation] covered by this license"),
    ("unlicense", "this is [free and unencumbered software] released into the public domain"),
    ("cc0", "the person who associated a work with this deed has [dedicated the work to the public domain]"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nc", "[creative commons attribution noncommercial]"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "[creative commons attribution sharealike]"),
    ("cc-by", "licensed under [cc by 4 0]"),
)
# End of the fixed values.


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[bool, ...]
    named: bool  # the bare name of a licence


def template(label: str, text: str, named: bool = False) -> Template:
    """From a text whose key phrases stand in brackets."""
    words, must, inside = [], [], False
    for w in text.split():
        inside = inside or w.startswith("[")
        words.append(w.strip("[]"))
        must.append(inside)
        inside = inside and not w.endswith("]")
    if not any(must):
        raise ValueError(f"no key phrase in {text!r}")
    return Template(label, tuple(words), tuple(must), named)


TEMPLATES = tuple(template(*x, named=True) for x in NAMES) + tuple(template(*x) for x in PASSAGES)


def opened(docs: DataFrame) -> DataFrame:
    """doc_id, ``_w``: what stands between breaks, with an empty piece before a leading and after a trailing break."""
    return docs.select("doc_id", F.split(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), BREAKS).alias("_w"))


def weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """1,000 times the inverse document frequency of each licence word over all of ``docs``, and 1 more."""
    known = sorted({w for t in templates for w in t.words})
    seen = opened(docs).select(F.explode_outer(F.array_intersect("_w", F.array(*map(F.lit, known)))).alias("word"))
    count = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    return {w: math.floor(1000 * math.log((n + 1) / (count.get(w, 0) + 1))) + 1 for w in known}


def index(templates: tuple[Template, ...], weight: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, position): of each template its mandatory word of highest weight (ties: the first in order of words)."""
    found = []
    for k, t in enumerate(templates):
        at = min((i for i, m in enumerate(t.must) if m), key=lambda i: (-weight[t.words[i]], t.words[i], i))
        found.append((t.words[at], k, at))
    return found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places: an array of (template, label, named, start, n_words, share) for each row of ``docs``."""
    weight = weights(docs, templates)
    postings = index(templates, weight)
    rare = sorted({w for w, _, _ in postings})
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(at).alias("at")) for w, k, at in postings])
    entry = lambda t: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(m).alias("must"), F.lit(weight[w]).cast("long").alias("weight")) for w, m in zip(t.words, t.must, strict=True)])
    book = F.array(*[
        F.struct(F.lit(t.label).alias("label"), F.lit(t.named).alias("named"), F.lit(sum(weight[w] for w in t.words)).cast("long").alias("total"), entry(t).alias("entries"))
        for t in templates
    ])
    lead = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.element_at("_w", -1) == "", 1).otherwise(0)
    rows = opened(docs).select("doc_id", "_w", lead.alias("_lead"), F.greatest(F.size("_w") - lead - tail, F.lit(0)).cast("long").alias("n_words"))
    # Positions of the rare words; nearly all rows have none.
    at = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "n_words", "_lead", F.when(F.arrays_overlap("_w", F.array(*map(F.lit, rare))), at).alias("_at"), "_w")

    def place(i: Column, p: Column) -> Column:
        """The template of posting ``p`` where its word is the file's word ``i``; null unless all its key phrases stand."""
        start = i - p["at"]

        def whole(t: Column) -> Column:
            stands = lambda e, k: F.coalesce(F.get("_w", start + k) == e["word"], F.lit(False))
            misses = F.filter(t["entries"], lambda e, k: e["must"] & ~stands(e, k))
            got = F.aggregate(F.filter(t["entries"], stands), F.lit(0).cast("long"), lambda n, e: n + e["weight"])
            return F.when(
                F.size(misses) == 0,
                F.struct(
                    p["template"].alias("template"), t["label"].alias("label"), t["named"].alias("named"), (start - F.col("_lead")).cast("long").alias("start"),
                    F.size(t["entries"]).alias("n_words"), (got / t["total"]).alias("share"),
                ),
            )

        return F.get(F.transform(F.array(F.get(book, p["template"])), whole), F.lit(0))

    found = F.flatten(F.transform("_at", lambda i: F.transform(F.filter(table, lambda p: p["word"] == F.get("_w", i)), lambda p: place(i, p))))
    places = F.filter(found, lambda x: x.isNotNull())
    return rows.select("doc_id", "n_words", F.when(F.col("_at").isNull(), F.array().cast(_PLACES)).otherwise(places).alias("places"))


_PLACES = "array<struct<template:int,label:string,named:boolean,start:bigint,n_words:int,share:double>>"


def report(scanned: DataFrame) -> DataFrame:
    """The columns of the contract, from rows of ``scan``; base places are those of the bare names."""
    rows = scanned.select("doc_id", "n_words", "places", F.filter("places", lambda p: p["named"]).alias("_base"))
    starts, joined = F.transform("_base", lambda p: p["start"]), lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    scores = F.transform("places", lambda p: F.when(p["named"], F.lit(NAMED)).otherwise(p["share"]))
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("_base").alias("base_labels"), joined("places").alias("labels"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )


def op13_licenses(spark, sf_dir):
    return report(scan(documents(spark, sf_dir)))


def _sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """Every alignment of every template by a join of all words; no index, no rarest word."""
    rows = ", ".join(f"({k}, {i}, '{w}', {str(m).lower()}, '{t.label}', {str(t.named).lower()})" for k, t in enumerate(templates) for i, (w, m) in enumerate(zip(t.words, t.must, strict=True)))
    return rf"""
WITH e(k, i, word, must, label, named) AS (VALUES {rows}),
t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS MATERIALIZED (SELECT d, pos - 1 AS pos, word FROM (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t) WHERE word IN (SELECT word FROM e)),
f AS (SELECT word, floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT d) + 1))) + 1 AS weight FROM (SELECT word, NULL AS d FROM e UNION ALL SELECT word, d FROM p) GROUP BY word),
o AS (SELECT d, k, pos - i AS start, label, named, count_if(must) AS got, sum(weight) AS weight FROM p JOIN e USING (word) JOIN f USING (word) GROUP BY ALL),
n AS (SELECT k, count_if(must) AS needed, sum(weight) AS total FROM e JOIN f USING (word) GROUP BY k),
s AS (SELECT d, start, label, named, CASE WHEN named THEN {NAMED} ELSE CAST(weight AS DOUBLE) / total END AS share FROM o JOIN n USING (k) WHERE got = needed),
g AS (SELECT d, count_if(named) AS n_base, min(start) FILTER (named) AS first_word, max(start) FILTER (named) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (named) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN g USING (d)
"""


OP13_SQL = _sql()

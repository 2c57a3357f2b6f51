"""License scans, in DataFrame functions only.

Texts and license templates are words of ``[a-z0-9]`` after lower-casing; their
five-word shingles are hashed to 64 bits.  Overlapping windows of a text's
shingles get MinHash values under ``PERMUTATIONS`` permutations, one band a
permutation; a template (or, for long ones, a piece of it) is retrieved when a
window agrees with it in any band.  Retrieved templates are verified exactly: the
share of the template's shingles that the text has must be ``CONTAINMENT`` or more.

Band settings: with bands of one row, a window with Jaccard similarity J to a
piece is missed with probability (1 - J)^PERMUTATIONS.  Window and stride of each
size class bound J from below for a text that has 80 % of the piece (see
``least_similarity``); ``miss_bound`` is under 0.2 % for each piece, and a long
template is missed only if all its pieces are.

Texts that cannot have 80 % of any template's shingles are skipped by an exact
test: ``anchors`` gives words of which every sufficient share of shingles of every
template has one, and a text without these words is out.

Defined cases: null and empty texts, and texts under five words, match nothing.
Rows with equal or null doc_id are separate.  Templates are a constant list of
known size; no data is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

K = 5
CONTAINMENT = 0.8
PERMUTATIONS = 32
#: Size classes: template shingles up to, window shingles, stride.
CLASSES = ((2, 4, 3), (5, 9, 4), (12, 20, 8), (28, 44, 16))
PIECE = CLASSES[-1][0]

TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "apache2-header": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def shingles(text: str) -> list[tuple[str, ...]]:
    ws = re.findall("[a-z0-9]+", text.lower())
    return [tuple(ws[i : i + K]) for i in range(len(ws) - K + 1)]


def pieces(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, int, list[tuple[str, ...]]]]:
    """Template, class, shingles; long templates in pieces of about equal length."""
    out = []
    for name, text in templates.items():
        s = shingles(text)
        parts = max(1, -(-len(s) // PIECE))
        step = -(-len(s) // parts)
        for i in range(0, len(s), step):
            part = s[i : i + step]
            out.append((name, next(c for c, (most, _, _) in enumerate(CLASSES) if len(part) <= most), part))
    return out


def least_similarity(n: int, c: int) -> float:
    """J of the best window with a contiguous piece of ``n`` shingles, of which 80 % are left in its place.

    A stride of at most window - n + 1 puts some window around the piece wholly.
    """
    _, window, stride = CLASSES[c]
    assert stride <= window - n + 1
    kept = -(-int(CONTAINMENT * 100) * n // 100)
    return kept / (window + n - kept)


def miss_bound(templates: dict[str, str] = TEMPLATES) -> float:
    return max((1 - least_similarity(len(s), c)) ** PERMUTATIONS for _, c, s in pieces(templates))


def anchors(templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Words one of which is in every text that holds CONTAINMENT of some template."""
    chosen: set[str] = set()
    for text in templates.values():
        s = list(dict.fromkeys(shingles(text)))
        # greedy: until the shingles without a chosen word are too few to match
        while len(bare := [x for x in s if not chosen & set(x)]) >= CONTAINMENT * len(s):
            names = sorted({w for x in bare for w in x}, key=lambda w: (-sum(w in x for x in bare), -len(w), w))
            long = [w for w in names if len(w) > 5] or names
            chosen.add(long[0])
    return sorted(chosen)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def _hashes(w: str) -> Column:
    """64-bit hashes of the shingles of the word array in column ``w``."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))
    return F.when(F.size(w) >= K, grams).otherwise(F.array().cast("array<bigint>"))


def _bands(h: str, c: Column, window: Column, stride: Column) -> Column:
    """Band keys of the windows of the hash array in column ``h``, for all permutations."""

    def of(p: Column) -> Column:
        permuted = F.array(F.transform(h, lambda x: F.xxhash64(x, p)))  # an array, so that it is computed once
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - window + stride, F.lit(1)), stride)
        keys = F.transform(permuted, lambda v: F.transform(starts, lambda i: F.xxhash64(F.array_min(F.slice(v, i, window)), c, p)))
        return F.get(keys, F.lit(0))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), of))


def _literals(spark: SparkSession, found: list[tuple[str, int, list[tuple[str, ...]]]]) -> list[tuple[str, int, list[int], list[int]]]:
    """Template, class, shingle hashes and band keys of each piece, from Spark's own hash function."""
    # a piece's shingles overlap by all but one word
    rows = [(i, c, " ".join([*s[0][:-1], *(x[-1] for x in s)])) for i, (_, c, s) in enumerate(found)]
    h = spark.createDataFrame(rows, "i int, c int, t string").select("i", "c", _words(F.col("t")).alias("w")).select("i", "c", _hashes("w").alias("h"))
    got = h.select("i", "h", _bands("h", F.col("c"), F.size("h"), F.lit(1)).alias("k")).collect()
    return [(found[r.i][0], found[r.i][1], r.h, r.k) for r in sorted(got, key=lambda r: r.i)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, matches: array of (template, containment), sorted by template."""
    spark = docs.sparkSession
    parts = _literals(spark, pieces(templates))
    longs = lambda xs: F.expr("array(" + ", ".join(f"{x}L" if x != -(2**63) else "(-9223372036854775807L - 1L)" for x in xs) + ")")
    low = F.lower(F.coalesce("text", F.lit("")))
    near = low.rlike("(?<![a-z0-9])(?:" + "|".join(anchors(templates)) + ")(?![a-z0-9])")
    words = F.when(near, _words(F.coalesce("text", F.lit("")))).otherwise(F.array().cast("array<string>"))
    two = docs.select("doc_id", words.alias("w")).select("doc_id", _hashes("w").alias("h"))
    mine = {c: [k for _, pc, _, keys in parts if pc == c for k in keys] for c in range(len(CLASSES))}
    none = F.array().cast("array<bigint>")
    bands = two.select("doc_id", "h", *(F.when(F.size("h") > 0, F.array_intersect(_bands("h", F.lit(c), F.lit(CLASSES[c][1]), F.lit(CLASSES[c][2])), longs(keys))).otherwise(none).alias(f"b{c}") for c, keys in mine.items() if keys))
    found = []
    for name, text in templates.items():
        own = [x for x in parts if x[0] == name]
        whole = sorted({h for x in own for h in x[2]})
        retrieved = None
        for _, c, _, keys in own:
            hit = F.arrays_overlap(f"b{c}", longs(keys))
            retrieved = hit if retrieved is None else retrieved | hit
        share = F.when(retrieved, F.size(F.array_intersect("h", longs(whole))) / F.lit(float(len(whole)))).otherwise(F.lit(0.0))
        found.append(F.struct(F.lit(name).alias("template"), share.alias("containment")))
    return bands.select("doc_id", F.sort_array(F.filter(F.array(*found), lambda x: x["containment"] >= CONTAINMENT)).alias("matches"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.concat_ws(",", F.transform("matches", lambda x: x["template"])).alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)), 6).alias("best"))


def _sql() -> str:
    rows = ", ".join(f"('{n}', '{' '.join(x)}')" for n, t in TEMPLATES.items() for x in dict.fromkeys(shingles(t)))
    return f"""
WITH t(template, g) AS (VALUES {rows}),
size AS (SELECT template, count(*) AS n FROM t GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i : i + {K - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d WHERE len(w) >= {K})),
m AS (SELECT rid, template, count(*) / any_value(n) AS share FROM g JOIN t USING (g) JOIN size USING (template) GROUP BY rid, template HAVING count(*) / any_value(n) >= {CONTAINMENT})
SELECT any_value(doc_id) AS doc_id, count(template) AS n_licenses, coalesce(string_agg(template, ',' ORDER BY template), '') AS licenses, round(coalesce(max(share), 0), 6) AS best
FROM d LEFT JOIN m USING (rid) GROUP BY rid
"""


SQL = _sql()

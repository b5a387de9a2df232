"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A text is its runs of letters and digits, lower-cased, and every five words are a shingle, kept as a 64-bit hash. Windows
of w shingles overlap by half; w follows the templates' lengths (CLASSES). The minimum of a window under a hash function
is a band of one row; templates are cut into windows of their own, and a window is retrieved when any of its BANDS bands
equals a template's. With one row a band, windows of Jaccard similarity j meet with probability 1 - (1 - j)^BANDS (see
`collision_probability`): a template of 4 shingles or more, whole, has a Jaccard similarity of at least 0.5 with some
window wherever it begins, which makes it 0.996 (an edited shingle costs similarity: 0.47 and 0.994 at 8 of 9);
templates of up to 3 shingles are looked up shingle by shingle, which finds each that is there.

DataFrame functions only. Windows are built from pieces, so that each shingle's hash is looked at once a band. The bands of
the templates, a reference list and no part of the corpus, are constants of the scan, BATCH templates at a time: longer
lists take further scans. Texts aren't shuffled: what leaves a scan is a row for each verified hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT = 5, 0.8
#: (shingles in a window, step between windows, shingles of the templates that use them: at least, at most).
CLASSES = ((1, 1, 1, 3), (8, 4, 4, 8), (16, 8, 9, 16), (32, 16, 17, 1 << 30))
#: Shingles in a piece: windows of 8 are two pieces, windows of 16 two pairs of them, windows of 32 two runs of four.
PIECE = 4
#: Hashes are ordered after an exclusive-or with each of these; the first and the last in that order are bands.
FUNCTIONS = (0, -7046029254386353131, -4417276706812531889, 1609587929392839161)
BANDS = 2 * len(FUNCTIONS)
BATCH = 250

#: Notices and opening passages of common licenses, as their authors word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)


def collision_probability(jaccard: float, bands: int = BANDS) -> float:
    """That two windows of this similarity share a band."""
    return 1 - (1 - jaccard) ** bands


def _with_shingles(rows: DataFrame, text: str) -> DataFrame:
    """rows with h, the hashes of the text's shingles in order: of 1 to 4 words one, of all of them; without words none."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    shingle = lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(SHINGLE)))
    h = F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(0), last), shingle)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("words", words).withColumn("h", h).drop("words")


def _extremes(parts: list[list[Column]]) -> Column:
    """The bands' values over several parts, each of them a list of BANDS values: minima and maxima in turn; nulls are passed over."""
    return F.array(*((F.least, F.greatest)[n % 2](*values) for n, values in enumerate(zip(*parts, strict=True))))


def _with_windows(rows: DataFrame) -> DataFrame:
    """rows with w1, w8, w16 and w32: (at, wide, keys) of each window of each class over h; `at` is its first shingle, from 1."""
    rows = rows.withColumns({f"p{k}": F.transform("h", _ordered(c)) for k, c in enumerate(FUNCTIONS) if c})
    names = [f"p{k}" if c else "h" for k, c in enumerate(FUNCTIONS)]
    piece = lambda i: _extremes([[F.get(n, i + j) for n in names for _ in (0, 1)] for j in range(PIECE)])
    rows = rows.withColumn("pieces", F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(PIECE)), piece))
    value = lambda pieces, i: [F.get(F.get(pieces, i), F.lit(n)) for n in range(BANDS)]
    joined = lambda parts: lambda i: _extremes([value(parts, i), value(parts, i + 1)])
    for parts, name in (("pieces", "duos"), ("duos", "runs")):
        rows = rows.withColumn(name, F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), joined(parts)))

    def windows(pieces: str, step: int) -> Column:
        def window(_: Column, i: Column) -> Column:
            both = _extremes([value(pieces, i), value(pieces, i + 1)])
            keys = F.transform(both, lambda x, n: F.xxhash64(x, n, F.lit(2 * step)))
            return F.struct((i * step + 1).alias("at"), F.lit(2 * step).alias("wide"), keys.alias("keys"))

        return F.transform(pieces, window)

    single = F.transform("h", lambda x, i: F.struct((i + 1).alias("at"), F.lit(1).alias("wide"), F.array(F.xxhash64(x, F.lit(0), F.lit(1))).alias("keys")))
    return rows.withColumns({"w1": single, "w8": windows("pieces", PIECE), "w16": windows("duos", 2 * PIECE), "w32": windows("runs", 4 * PIECE)})


def _ordered(constant: int):
    return lambda x: x.bitwiseXOR(F.lit(constant))


def _hits(docs: DataFrame, templates: Sequence[tuple[int, str, str]], id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    known = spark.createDataFrame(templates, "template int, license string, t string")
    known = _with_windows(_with_shingles(known, "t").drop("t")).withColumn("own", F.array_distinct("h"))
    size = F.size("own")
    wide = F.lit(None).cast("int")
    for w, _, least, most in CLASSES:
        wide = F.when(size.between(least, most), F.lit(w)).otherwise(wide)
    bands = known.select("template", "license", "own", wide.alias("wide"), F.explode_outer(F.concat("w1", "w8", "w16", "w32")).alias("w")).where("w.wide = wide")
    keys = bands.select("template", "license", "own", "wide", F.explode_outer("w.keys").alias("key")).dropDuplicates(["template", "key"])
    # As many keys as a batch of templates has bands.
    wanted: dict[int, list[int]] = {w: [] for w, *_ in CLASSES}
    for r in keys.select("wide", "key").distinct().collect():
        wanted[r["wide"]].append(r["key"])

    read = _with_windows(_with_shingles(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t").drop("t"))
    some = lambda w: F.filter(f"w{w}", lambda x: F.exists(x["keys"], lambda k: k.isin(wanted[w])))
    kept = F.concat(*(some(w) for w in wanted if wanted[w])) if any(wanted.values()) else F.filter("w1", lambda _: F.lit(False))
    # Few documents have a window left, so that carrying h along with each costs little. A filter on what is left, also
    # one that a plain explode implies, would be pushed below the projections above and evaluate them again and again.
    met = read.select("id", "h", kept.alias("kept")).select("id", "h", F.explode_outer("kept").alias("w"))
    met = met.select("id", "h", F.col("w.at").alias("at"), F.explode_outer("w.keys").alias("key")).join(F.broadcast(keys), "key")
    # The template may begin before the window or end after it.
    begin = F.greatest(F.col("at") - size - F.col("wide"), F.lit(1))
    region = F.slice("h", begin, F.col("at") - begin + size + 2 * F.col("wide"))
    share = F.size(F.array_intersect("own", region)) / size
    first = begin + F.coalesce(F.array_min(F.filter(F.transform("own", lambda x: F.array_position(region, x)), lambda p: p > 0)), F.lit(1)).cast("int") - 1
    return met.select("id", "template", "license", share.alias("containment"), first.alias("at")).where(F.col("containment") >= CONTAINMENT)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and template that it contains: id_col, template, license, containment (double), at (int) and hits (long).

    templates: (license, text), numbered from 0. A template is contained where, around a retrieved window, at least
    CONTAINMENT of its distinct shingles occur; containment is the largest share found, `at` the first word (from 1) of
    the earliest region with that share, hits the number of bands that led there. Null and empty texts contain nothing;
    templates without words are never found. Rows that repeat an id count as one document. Other columns are dropped,
    whatever their names.
    """
    numbered = [(i, name, text) for i, (name, text) in enumerate(templates)]
    hits = None
    for a in range(0, max(1, len(numbered)), BATCH):
        part = _hits(docs, numbered[a : a + BATCH], id_col, text_col)
        hits = part if hits is None else hits.unionAll(part)
    best = hits.groupBy("id", "template", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("before"))).alias("best"), F.count(F.lit(1)).alias("hits"))
    return best.select(F.col("id").alias(id_col), "template", "license", F.col("best.containment").alias("containment"), (-F.col("best.before")).cast("int").alias("at"), "hits")

"""License scans with DataFrame functions only: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by size: one of P shingles or fewer (P a power of four, the least of WIDTHS that will do) is
looked for in windows of 2 P shingles that start every P, so any stretch of P shingles lies within one. Signatures
come from one permutation: the range of the hashes is cut into equal parts, the bands, and a band's value is the
smallest hash in its part. A window and a template meet if any band agrees; where both have hashes in a band it does
so with the chance of their Jaccard similarity.

A shared shingle stays silent only if a smaller hash of the window falls in its band, with a chance of 2 P / (2 B) at
most. Templates of up to 64 shingles may share one only, so their windows get B = 65,536 bands: 0.0003 for P = 16 and
0.001 for P = 64, where a window that holds 0.8 of a template has 14 in common. Larger templates share 0.8 * 65 at
least and need no more than B = 1,024: for P = 256 all of those stay silent with a chance under 0.25 ** 52.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, row_key, stored

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
WIDTHS = tuple(4**k for k in range(2, 16))
#: Bits of a hash that name its band, for windows of templates of up to 64 shingles, and for larger ones.
SMALL_BITS, LARGE_BITS = 16, 10
BREAK = r"[^\p{L}\p{N}]+"
#: Rows up to which tables of template bands and of candidates are sent to every executor; larger ones meet by shuffles.
BROADCAST_ROWS = 500_000
#: Parts that the windows of one band value are dealt to where they are shuffled.
SALTS = 16
#: Shingles of all templates up to which the bands that they use are listed in the plan.
LISTED_SHINGLES = 20_000

# License identifiers and the public wording of their notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
]


def shingles(text: Column) -> Column:
    """Hashes of each SHINGLE_WORDS words in a row; words are runs of letters and numbers, lower-cased."""
    ws = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")
    n = SHINGLE_WORDS
    return let(ws, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))


def signature(window: Column, bits: int) -> Column:
    """The smallest hash of each of 2 ** bits bands that a window has a hash in."""
    band = lambda x: _band(x, bits)
    # in the order of signed numbers the hashes of a band stand together, smallest first
    return let(F.sort_array(window), lambda w: F.filter(w, lambda x, i: (i == 0) | (band(x) != band(F.get(w, i - 1)))))


def _signature(window: Column, width: Column) -> Column:
    return F.when(width <= 64, signature(window, SMALL_BITS)).otherwise(signature(window, LARGE_BITS))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(template, license, width, own) of templates: a list of (license, text), numbered by place, or a DataFrame with
    the columns template, license and text. Templates under five words have no shingles and go."""
    df = templates if isinstance(templates, DataFrame) else spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    own = df.select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("own")).where(F.size("own") > 0)
    return own.withColumn("width", F.array_min(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w >= F.size("own"))))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from a folder of files, one license text each; the license is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt|\.md)?$", 1).alias("license"), F.col("value").alias("text"))
    return files.select(F.xxhash64("license", "text").alias("template"), "license", "text")


def _starts(n: Column, width: int) -> Column:
    """The windows of a text of n shingles; one at the end that lies in the window before is left out."""
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.struct(F.lit(width).alias("width"), (i * width).alias("start")))
    return F.filter(starts, lambda x: (n > 0) & (x["start"] >= 0) & ((x["start"] == 0) | (x["start"] + width < n)))


def _band(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def _used(table: DataFrame) -> dict[int, list[int]]:
    """The bands that templates have a value in, by their bits: LISTED_SHINGLES at most."""
    own = table.select(F.when(F.col("width") <= 64, SMALL_BITS).otherwise(LARGE_BITS).alias("bits"), F.explode("own").alias("x"))
    at = F.when(F.col("bits") == SMALL_BITS, _band(F.col("x"), SMALL_BITS)).otherwise(_band(F.col("x"), LARGE_BITS))
    out: dict[int, list[int]] = {}
    for r in own.select("bits", at.alias("band")).distinct().collect():
        out.setdefault(r.bits, []).append(r.band)
    return out


def candidates(docs: DataFrame, table: DataFrame, widths: Sequence[int], small: bool, used: dict[int, list[int]] | None = None) -> DataFrame:
    """(_k, _h, template, width, start): windows that share a band's value with a template; stored, each once.

    A window leaves its task as the values of its bands, a few numbers each. With small the templates' bands are sent
    to every executor and nothing else moves before the matches; else both are shuffled by value, and a value that
    very many windows hold is dealt to SALTS parts, each with the templates of that value. used lists the bands that
    templates have values in, if they are few: the others' smallest hashes meet nothing and are not looked for.
    """
    rows = docs.select(*row_key(), shingles(F.col("text")).alias("s"))
    if used is not None:
        in_use = lambda x: reduce(or_, [_band(x, bits).isin(bands) for bits, bands in used.items()])
        rows = rows.withColumn("s", F.transform("s", lambda x: F.when(in_use(x), x)))
    at = rows.select("*", F.explode(F.flatten(F.array(*[_starts(F.size("s"), w) for w in widths]))).alias("x")).select("_k", "_h", "x.width", "x.start", F.slice("s", F.col("x.start") + 1, 2 * F.col("x.width")).alias("part"))
    banded = at.select("_k", "_h", "width", "start", F.explode(_signature(F.array_compact("part"), F.col("width"))).alias("value"))
    bands = table.select("width", "template", F.explode(_signature(F.col("own"), F.col("width"))).alias("value"))
    if small:
        met = banded.join(F.broadcast(bands), ["width", "value"])  # BROADCAST_ROWS at most
    else:
        salt = F.pmod(F.xxhash64("_k", "_h", "start"), F.lit(SALTS)).cast("int")
        met = banded.withColumn("salt", salt).join(bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["width", "value", "salt"])
    return stored(met.select("_k", "_h", "template", "width", "start").distinct(), "license-candidates")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, template, containment): the templates that a window of a document holds MIN_CONTAINMENT of or more.

    template is its number; containment is the share of its shingles in the best window. Documents without a match
    have no row; null and empty texts, and those under five words, have none. Repeated rows are reported once. The
    widths that templates have are the one thing read to plan. Documents with candidate windows are read once more,
    and only those windows are held against their templates, shingle by shingle.
    """
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    counts = {r.width: r.s for r in table.groupBy("width").agg(F.sum(F.size("own")).alias("s")).collect()}  # a row for each width
    own = F.col(f"`{doc_id}`").alias("doc_id")
    if None in counts:
        raise ValueError(f"TemplateTooLong: over {WIDTHS[-1]} shingles")
    if not counts:
        return docs.select(own).where("false").select("doc_id", F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("containment"))
    small = sum(counts.values()) <= BROADCAST_ROWS
    texts = docs.select(own, F.col("text"))
    found = candidates(texts, table, sorted(counts), small, _used(table) if small and sum(counts.values()) <= LISTED_SHINGLES else None)
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    windows = found.groupBy("_k", "_h").agg(F.collect_list(F.struct("template", "width", "start")).alias("c"))
    again = texts.select("doc_id", *row_key(), "text").join(few(windows, found.count()), ["_k", "_h"])
    parts = let(shingles(F.col("text")), lambda s: F.transform("c", lambda c: F.struct(c["template"].alias("template"), F.array_distinct(F.slice(s, c["start"] + 1, 2 * c["width"])).alias("part"))))
    met = again.select("doc_id", "_k", "_h", F.explode(parts).alias("p")).select("doc_id", "_k", "_h", "p.*")
    listed = table.select("template", "license", "own")
    met = met.join(F.broadcast(listed) if small else listed, "template")
    matched = met.withColumn("containment", F.size(F.array_intersect("part", "own")) / F.size("own")).where(F.col("containment") >= MIN_CONTAINMENT)
    return matched.groupBy("doc_id", "_k", "_h", "license", "template").agg(F.max("containment").alias("containment")).select("doc_id", "license", "template", "containment")


def _sql() -> str:
    quoted = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
    words = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '{BREAK}'), lambda x: x <> '')"
    sh = "list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])"
    return f"""
WITH t0 AS (SELECT * FROM (VALUES {quoted}) AS v(template, license, text)),
t1 AS (SELECT template, license, {words("text")} AS w FROM t0),
t AS (SELECT template, license, list_distinct({sh}) AS own FROM t1),
p AS (SELECT *, greatest({WIDTHS[0]}, CAST(pow(4, ceil(log2(len(own)) / 2)) AS BIGINT)) AS width FROM t WHERE len(own) > 0),
d1 AS (SELECT doc_id, {words("text")} AS w FROM documents),
d AS (SELECT doc_id, {sh} AS s FROM d1 WHERE len(w) >= 5),
h AS (SELECT d.doc_id, d.s, p.* FROM d JOIN p ON list_has_any(d.s, p.own)),
x AS (SELECT doc_id, s, template, license, own, width, unnest(range(0, len(s), width)) AS start FROM h),
c AS (SELECT doc_id, template, license, len(list_intersect(list_distinct(s[start + 1 : start + 2 * width]), own)) / CAST(len(own) AS DOUBLE) AS containment FROM x)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, max(containment) AS containment FROM c
WHERE containment >= {MIN_CONTAINMENT} GROUP BY doc_id, template, license
"""


SQL = _sql()


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

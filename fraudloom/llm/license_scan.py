"""License scans: MinHash bands over overlapping windows, then exact containment. DataFrame functions only.

A template is cut into nothing; a document is cut, per template length L, into windows of
2L words that overlap by L, so every run of L + 1 words lies in one window whole.  Both
sides are sets of five-word shingles (a template under five words is one shingle, and the
windows it meets are cut into shingles of its own length).  Band j hashes a
template to its shingle of least hash under seed j.  A window collides with the template in
a band if it holds that shingle (the asymmetric form: the windows are longer than the
template, and it is containment that counts), so a window that contains a share C of the
template collides with probability 1 - (1 - C)^BANDS: over 0.999997 at C = 0.8, certain at
C = 1.  Every collision is verified: containment is computed on the shingles themselves.

Finding the windows that collide is one pass over the shingles of the text against the
table of band shingles, BANDS rows a template, which is broadcast after its size is checked.
Templates are the notices below and the full texts in the folder `licenses` (file name: id).
A text that holds most of another is found as both (BSD-3-Clause as BSD-2-Clause too).
Words are runs of 0-9, a-z (A-Z lowered) and non-ASCII characters; a null text has none.
"""
from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut
from .decontaminate import words

SHINGLE, BANDS = 5, 8

# Notices and standard headers of public licenses
NOTICES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
TEMPLATES = NOTICES | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license, text."""
    return spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")


def shingles(ws: str | Column, size: int | Column = SHINGLE) -> Column:
    """Distinct shingles of `size` words of an array of words; fewer words are one shingle, none has none."""
    ws = F.col(ws) if isinstance(ws, str) else ws
    n, size = F.size(ws), F.lit(size) if isinstance(size, int) else size
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, size), " "))
    return F.array_distinct(F.when(n > 0, each).otherwise(F.array().cast("array<string>")))


def scan(docs: DataFrame, licenses: DataFrame, containment: float = 0.8, bands: int = BANDS) -> DataFrame:
    """doc_id, license, n_windows, containment (the best), first_word: one row per document row and license found.

    A row that is repeated is found as often; a license id that is repeated is one entry per text.
    """
    known = licenses.select("license", words().alias("t")).filter(F.size("t") > 0).select(F.xxhash64("license", "t").alias("tid"), "license", F.size("t").alias("len"), shingles("t").alias("ts")).dropDuplicates(["tid"])
    known = cut(known)
    # band j of a template: its shingle of least hash under seed j; equal ones fall together
    least = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.array_min(F.transform("ts", lambda s: F.struct(F.xxhash64(j, s).alias("h"), s.alias("s"))))["s"])
    signs = cut(known.select("tid", "len", F.explode(F.array_distinct(least)).alias("shingle")))
    sizes = [r[0] for r in known.select(F.least("len", F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]  # 1 to SHINGLE
    src = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words().alias("ws"))
    at = src.select("doc_id", "row", "ws", F.posexplode("ws").alias("pos", "w"))
    if sizes == [SHINGLE]:
        at = at.withColumn("k", F.lit(SHINGLE))
    else:
        at = at.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes])))
    at = at.filter(F.col("pos") + F.col("k") <= F.size("ws"))
    met = at.select("doc_id", "row", "ws", "pos", F.array_join(F.slice("ws", F.col("pos") + 1, F.col("k")), " ").alias("shingle")).join(checked(signs), "shingle")
    # the windows of 2L words at multiples of L that hold the shingle
    last = F.floor(F.col("pos") / F.col("len")).cast("int")
    wins = met.withColumn("win", F.explode(F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0))))))
    wins = wins.select("doc_id", "row", "tid", "win", "len", F.slice("ws", F.col("win") * F.col("len") + 1, F.col("len") * 2).alias("window"))
    wins = wins.groupBy("row", "tid", "win", "len").agg(F.first("doc_id").alias("doc_id"), F.first("window").alias("window"))
    full = wins.join(checked(known.select("tid", "license", "ts")), "tid").withColumn("c", F.size(F.array_intersect(shingles("window", F.least("len", F.lit(SHINGLE))), "ts")) / F.size("ts"))
    found = full.filter(F.col("c") >= containment)
    return found.groupBy("row", "tid", "license").agg(
        F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_windows"), F.max("c").alias("containment"), F.min(F.col("win") * F.col("len")).cast("bigint").alias("first_word")
    ).select("doc_id", "license", "n_windows", "containment", "first_word")


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    ws = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    sh = "list_distinct(list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: array_to_string({0}[i:i + 4], ' ')))"
    return f"""
WITH t AS (SELECT license, {ws} AS w FROM (VALUES {rows}) AS v(license, text)),
ts AS (SELECT license, len(w) AS l, {sh.format('w')} AS s FROM t),
lens AS (SELECT DISTINCT l FROM ts),
d AS (SELECT row_number() OVER () AS r, doc_id, {ws} AS w FROM documents),
win AS (SELECT r, doc_id, l, k, w[k * l + 1:k * l + 2 * l] AS w FROM (SELECT r, doc_id, w, l, unnest(range(0, (len(w) - 1) // l + 1)) AS k FROM d, lens WHERE len(w) > 0)),
ws AS (SELECT r, doc_id, l, k, {sh.format('w')} AS s FROM win),
m AS (SELECT r, doc_id, license, k, ws.l, len(list_intersect(ws.s, ts.s)) / len(ts.s) AS c FROM ws JOIN ts USING (l))
SELECT doc_id, license, count(*) AS n_windows, max(c) AS containment, CAST(min(k * l) AS BIGINT) AS first_word
FROM m WHERE c >= 0.8 GROUP BY r, doc_id, license
"""


SQL = _sql()

"""Operator 2 [native]: license scans.

Templates are license statements of five words or more.  Both sides are sets of
five-word shingles.  Each template belongs to the length class S, the smallest of
1, 2, 3, 4, 6, 8, 12, ... that is at least its number of shingles; documents are
cut for that class into overlapping windows of 2 S shingles, S apart, so one
window holds any occurrence whole.  Such a window has a Jaccard of at least 1/4
with a template of which it holds four fifths; with ``BANDS`` bands of one row, it
collides with a probability of 1 - (3/4)^BANDS (0.999 for 24).

A window shares band i with a template only if it holds the template's smallest
shingle under hash i.  So signatures are computed only for windows, of that
template's class, around these shingles, without losing a collision.  They are found
by a hash table, so a document costs the same however many templates there are.
Colliding (window, template) pairs are then
verified on the shingles themselves: containment of 4/5 or more.

All of it is DataFrame functions; there is no Python on the executors.

Result: a row per doc_id and license: ``matched`` of ``total`` shingles in the best
window, and ``window_start``, the number of that window's first word (ties: the
first window).  Documents without a license have no row.  Null or empty text, or
fewer than five words: no row.  Rows that share a doc_id count as one document;
null is a doc_id like any other.  Very long texts are scanned whole.  Empty table, or
no template of five words: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallforge.llm import _io

SIZE = 5
BANDS = 24
#: Containment of a template that counts, as a fraction.
LEAST = (4, 5)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TEMPLATES = (
    ("mit-line", "Released under the MIT License."),
    ("apache-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)


def _classes(most: int) -> list[int]:
    out = [1]
    while out[-1] < most:
        n = out[-1]
        out.append(n + 1 if n < 4 else n * 3 // 2 if n & (n - 1) == 0 else n * 4 // 3)
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(w: Column) -> Column:
    """A hash for each shingle of a word array."""
    n = F.size(w) - (SIZE - 1)
    return F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(SIZE)]))


def _texts(w: Column) -> Column:
    """Each shingle of a word array as text."""
    n = F.size(w) - (SIZE - 1)
    return F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda _, i: F.concat_ws(" ", F.slice(w, i + 1, SIZE)))


def _minima(h: Column) -> Column:
    """Of each band, the shingle hash that its hash function puts first."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(h, lambda s: F.struct(F.xxhash64(s, b).alias("v"), s.alias("s")))))


def _keys(minima: Column, stride: Column) -> Column:
    return F.transform(minima, lambda m, i: F.xxhash64(stride, i, m["v"]))


def _templates(known: DataFrame) -> DataFrame:
    """license_id, stride, shingles, minima, keys: a row per statement of ``known``
    (license_id, statement) of SIZE words or more."""
    t = _io.held(known.select("license_id", "statement"), "w", words(F.col("statement"))).where(F.size("w") >= SIZE)
    t = _io.held(_io.held(t, "h", _hashes(F.col("w"))), "shingles", F.array_distinct(_texts(F.col("w"))))
    # the smallest class that is at least the number of shingles: 2^k or 3 * 2^(k - 1)
    n = F.size("shingles")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("int")
    between = (power / 4 * 3).cast("int")
    t = _io.held(t.withColumn("stride", F.when((power >= 4) & (between >= n), between).otherwise(power)), "minima", _minima(F.col("h")))
    return t.withColumn("keys", _keys(F.col("minima"), F.col("stride"))).select("license_id", "stride", "shingles", "minima", "keys")


def statements(spark: SparkSession, templates) -> DataFrame:
    """license_id, statement: (license_id, statement) pairs as a table."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in templates)
    return spark.sql(f"SELECT * FROM VALUES {rows or '(NULL, NULL)'} AS t(license_id, statement)").where("statement IS NOT NULL").select(F.col("license_id").cast("string").alias("license_id"), F.col("statement").cast("string").alias("statement"))


def _marks(spark: SparkSession, known: DataFrame) -> str | None:
    """The smallest shingles of all templates, each with the strides of its templates,
    as a hash table: the JSON text of an array of buckets.  Templates are a parameter,
    so this is bounded by them: BANDS numbers for each."""
    rows = known.select("stride", F.explode("minima").alias("m")).groupBy(F.col("m.s").alias("s")).agg(F.array_sort(F.collect_set("stride")).alias("strides")).collect()
    if not rows:
        return None
    size = 1 << max(4, (2 * len(rows)).bit_length())
    table: list[list[dict]] = [[] for _ in range(size)]
    for r in sorted(rows, key=lambda r: r.s):
        table[r.s % size].append({"s": r.s, "strides": r.strides})
    return json.dumps(table)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``templates``: (license_id, statement) pairs, or a DataFrame of them."""
    spark = docs.sparkSession
    known = _templates(templates if isinstance(templates, DataFrame) else statements(spark, templates))
    marks = _marks(spark, known)
    if marks is None:
        return spark.createDataFrame([], docs.select("doc_id").schema.add("license_id", "string").add("matched", "long").add("total", "long").add("window_start", "long"))
    table = F.from_json(F.lit(marks), "array<array<struct<s:long,strides:array<int>>>>")  # one constant
    size = F.size(table)
    found = lambda h: F.filter(F.get(table, F.pmod(h, size.cast("long")).cast("int")), lambda x: x["s"] == h)
    sets = _io.held(docs.select("doc_id", "text"), "w", words(F.col("text"))).select("doc_id", "w").where(F.size("w") >= SIZE)
    sets = _io.held(sets, "h", _hashes(F.col("w")))
    # the two windows of a class that may hold the place of a mark of that class
    at = lambda p, s: F.floor(p / s) * s
    pair = lambda p, s: F.array(*[F.struct(s.alias("stride"), a.cast("int").alias("start")) for a in (at(p, s), F.greatest(at(p, s) - s, F.lit(0)))])
    here = lambda h, p: F.flatten(F.transform(found(h), lambda x: F.flatten(F.transform(x["strides"], lambda s: pair(p, s)))))
    starts = F.array_distinct(F.flatten(F.filter(F.transform("h", here), lambda a: F.size(a) > 0)))

    windows = sets.select("doc_id", "w", "h", F.explode(starts).alias("at")).select(
        "doc_id",
        "at.*",
        F.slice("w", F.col("at.start") + 1, 2 * F.col("at.stride") + SIZE - 1).alias("w"),
        F.slice("h", F.col("at.start") + 1, 2 * F.col("at.stride")).alias("h"),
    )
    signed = _io.held(windows, "sig", _keys(_minima(F.col("h")), F.col("stride"))).drop("h")
    bands = signed.select("doc_id", "start", "w", "sig", F.posexplode("sig").alias("band", "key"))
    right = known.select("license_id", "shingles", "keys", F.posexplode("keys").alias("_band", "_key"))
    # of several shared bands the first counts; templates are few, so they are broadcast
    pairs = bands.join(F.broadcast(right), (F.col("key") == F.col("_key")) & (F.col("band") == F.col("_band")))
    pairs = pairs.where((F.col("band") == 0) | ~F.arrays_overlap(F.slice("sig", F.lit(1), F.greatest("band", F.lit(1))), F.slice("keys", F.lit(1), F.greatest("band", F.lit(1)))))
    checked = pairs.select("doc_id", "license_id", "start", F.size("shingles").cast("long").alias("total"), F.size(F.array_intersect("shingles", _texts(F.col("w")))).cast("long").alias("matched"))
    checked = checked.where(LEAST[1] * F.col("matched") >= LEAST[0] * F.col("total"))
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "total"))
    return checked.groupBy("doc_id", "license_id").agg(best.alias("b")).select("doc_id", "license_id", F.col("b.matched").alias("matched"), F.col("b.total").alias("total"), (-F.col("b.start")).cast("long").alias("window_start"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_io.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    """Containment in every window of every class, without the bands."""
    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in TEMPLATES)
    classes = ", ".join(map(str, _classes(256)))
    shingles = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]"
    return f"""
WITH t0 AS (SELECT license_id, regexp_extract_all(lower(s), '{WORD}') AS w FROM (VALUES {rows}) v(license_id, s)),
t AS (SELECT license_id, list_distinct({shingles}) AS sh FROM t0 WHERE len(w) >= 5),
t1 AS (SELECT license_id, sh, len(sh) AS total, (SELECT min(c) FROM (SELECT unnest([{classes}]) AS c) WHERE c >= len(sh)) AS stride FROM t),
ts AS (SELECT license_id, total, stride, unnest(sh) AS x FROM t1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
ds AS (SELECT doc_id, unnest(range(len(w) - 4)) AS p, unnest({shingles}) AS x FROM d WHERE len(w) >= 5),
hit AS (SELECT doc_id, p, license_id, total, stride, ds.x FROM ds JOIN ts USING (x)),
win AS (
  SELECT *, (p // stride) * stride AS s FROM hit
  UNION SELECT *, (p // stride) * stride - stride AS s FROM hit WHERE p >= stride),
c AS (SELECT doc_id, license_id, total, s, count(DISTINCT x) AS matched FROM win GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license_id ORDER BY matched DESC, s) AS r FROM c WHERE 5 * matched >= 4 * total)
SELECT doc_id, license_id, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, CAST(s AS BIGINT) AS window_start FROM b WHERE r = 1
"""


SQL = _sql()

"""License scan: MinHash bands over overlapping windows find candidate templates, exact shingle containment decides.

Only DataFrame functions are used. A window is ``WINDOW`` consecutive shingle hashes, one every ``STRIDE``; its i-th minimum is that of
the hashes under the i-th fixed bit mask. Templates are cut into windows at every shingle, so a text window that lies
inside a copy of a template equals one of the template's and shares all bands with it for certain. At most a fifth of a template's shingles
may be missing and a changed word costs ``WORDS`` of them, so some run of unchanged shingles is longer than a window and its stride. Templates
too short for that have windows of one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize

WORDS, CONTAINED = 5, 0.8

#: Shingles in a window and between windows. Two windows of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS.
WINDOW, STRIDE = 8, 4
BANDS, ROWS = 4, 2

#: Templates of fewer shingles are looked up by single shingles.
SHORT = 12

#: Templates may hold this many words together, which bounds what is broadcast.
MAX_TEMPLATE_WORDS = 1_000_000

#: Fixed texts: notices and permission texts as their licenses give them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Bit masks of the minima: multiples of a fixed odd number.
_MASKS = [((0x9E3779B97F4A7C15 * (i + 1)) % 2**64) - 2**63 for i in range(BANDS * ROWS)]


def _shingles(text: Column) -> Column:
    """Hashes of all ``WORDS`` consecutive words; a text of fewer words, but not none, has one of all its words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), "")
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), _hashes)[0]


def _hashes(words: Column) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WORDS)]))
    none = F.array().cast("array<bigint>")
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)
    return F.when(F.size(words) >= WORDS, many).otherwise(few)


def _bands(window: Column) -> list[Column]:
    """Keys of a window: its minima under all masks, ROWS to a band."""
    low = [F.least(*[F.get(window, F.lit(j)).bitwiseXOR(F.lit(m)) for j in range(WINDOW)]) for m in _MASKS]
    return [F.xxhash64(F.lit(b), *low[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]


def _template_keys(templates: DataFrame) -> DataFrame:
    """(key, license) of all windows of the long templates and all shingles of the short ones, and each template's shingles."""
    long = templates.where(F.size("want") >= SHORT).select("license", F.explode(F.transform(F.sequence(F.lit(1), F.size("want") - (WINDOW - 1)), lambda i: F.slice("want", i, WINDOW))).alias("w"))
    long = long.select("license", F.explode(F.array(*_bands(F.col("w")))).alias("key"))
    short = templates.where(F.size("want") < SHORT).select("license", F.explode("want").alias("key"))
    return long.unionByName(short).distinct()


def scan_licenses(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, contained: float = CONTAINED
) -> DataFrame:
    """(id, license, n_shingles, n_found, containment) of every text and template (license, text) that it contains.

    Words are runs of ASCII letters, digits and all non-ASCII characters, lower-cased; containment is the share of the template's distinct shingles that the text holds,
    and rows below ``contained`` are left out. A NULL or empty text contains nothing, a template without words is nowhere. Of rows
    that repeat id and text one result is returned for each license; rows that share an id are told apart by their text. Ties and
    overlapping templates are all reported. Other columns are not read.

    The one scan of all texts yields a row only for a shared key; nothing is grouped by template or by window, so a
    notice that a third of all texts carry is no hot key. Templates are broadcast, within ``MAX_TEMPLATE_WORDS``.
    """
    wanted = templates.select("license", F.col("text").alias("words")).where("license is not null")
    size = wanted.agg(F.coalesce(F.sum(F.size(F.split("words", r"\s+"))), F.lit(0))).first()[0]
    if size > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    wanted = materialize(wanted.select("license", F.array_distinct(_shingles(F.col("words"))).alias("want")).where(F.size("want") > 0))
    keys = F.broadcast(_template_keys(wanted))

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    every = F.transform(F.sequence(F.lit(1), F.size("s"), F.lit(STRIDE)), lambda i: F.slice("s", i, WINDOW))
    windows = rows.select("doc", "h", _shingles(F.col("text")).alias("s")).where(F.size("s") > 0).select("doc", "h", F.explode(every).alias("w"))
    own = [F.get("w", F.lit(j)) for j in range(STRIDE)]  # the shingles that no later window starts with
    found = windows.select("doc", "h", F.explode(F.array(*_bands(F.col("w")), *own)).alias("key")).join(keys, "key").select("doc", "h", "license").distinct()
    found = materialize(found.groupBy("doc", "h").agg(F.collect_set("license").alias("licenses")))  # of the templates, which are few

    mine = found.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    texts = rows.join(mine, (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc"))).dropDuplicates(["doc", "h"])
    texts = texts.select("doc", _shingles(F.col("text")).alias("s"), F.explode("licenses").alias("license"))
    have = texts.join(F.broadcast(wanted), "license").select("doc", "license", F.size("want").cast("long").alias("n_shingles"), F.size(F.array_intersect("want", "s")).cast("long").alias("n_found"))
    have = have.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= contained)
    return have.withColumnRenamed("doc", id_col)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")

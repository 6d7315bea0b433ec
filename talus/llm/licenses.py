"""License texts and notices found by MinHash bands over overlapping windows, verified by containment.

DataFrame functions only. A notice of m shingles (five words each) belongs to the scale L, the
least power of two from 1.25*m on, and texts are cut into windows of 2L shingles every L, so
that any stretch of up to L shingles lies whole in one window. A window that holds the share
CONTAINED of the notice has with it a Jaccard similarity of at least j = s/(2L+m-s), s =
ceil(CONTAINED*m); a scale has as many one-row bands b as make (1-j)^b <= MISS for each of its
notices. A band of a notice is the shingle that comes first under the band's hash: a window
shares it only if it holds that shingle, and no other comes before. So texts are looked
through for the bands' shingles (as many as bands, however long the notices), the windows that
hold one are banded and joined to the notices, and what shares a band is held against the
notice's whole shingle set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.quality import words_of
from talus.runtime import stage

WIDTH, CONTAINED, MISS = 5, 0.8, 1e-3
#: Marks that count as spaces; comment signs are among them, so that a header's line starts break no shingle.
MARKS = ".,;:!?()[]\"'`#/*-_<>|~=+\\"

# Common license notices as they are published.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "This work is marked with CC0 1.0 Universal.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def shingles_of(text: Column) -> Column:
    """The hashes of the WIDTH-word windows of a text, in order; marks count as spaces."""
    words = words_of(F.lower(F.translate(text, MARKS, " " * len(MARKS))))
    return words, lambda w: F.when(
        F.size(w) >= WIDTH,
        F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)])),
    ).otherwise(F.array().cast("array<long>"))


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    words, make = shingles_of(text)
    return df.withColumn("__w", words).withColumn("sh", make(F.col("__w"))).drop("__w")


def scale(m: int) -> int:
    return 1 << max(0, math.ceil(math.log2(1.25 * m)))


def bands_needed(m: int, size: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    s = math.ceil(contained * m)
    j = s / (2 * size + m - s)
    return math.ceil(math.log(miss) / math.log(1 - j)) if j < 1 else 1


def banded(df: DataFrame, sh: str, bands: int) -> DataFrame:
    """A row per band of each row, with the band's key: the least hash of the set under the band's own hash."""
    each = df.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    return each.withColumn("key", F.array_min(F.transform(sh, lambda x: F.xxhash64(x, F.col("band")))))


def band_shingles(table: DataFrame, bands: int) -> list[int]:
    """The shingles that are a band of a notice: the first of the notice under the band's hash."""
    each = table.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    first = F.array_min(F.transform("sh", lambda x: F.struct(F.xxhash64(x, F.col("band")).alias("key"), x.alias("shingle"))))
    return sorted(r["s"] for r in each.select(first["shingle"].alias("s")).distinct().collect())  # of the notices given, no data


def notice_table(spark: SparkSession, notices: dict[str, tuple[str, ...]]) -> DataFrame:
    """(license, notice, sh): the distinct shingles of each notice; as many rows as notices given."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(k).alias("notice"), F.lit(text).alias("text")) for name, texts in notices.items() for k, text in enumerate(texts)]
    given = F.array(*rows) if rows else F.array().cast("array<struct<license:string,notice:int,text:string>>")
    table = spark.range(1).select(F.explode(given).alias("n")).select("n.*")
    return with_shingles(table, F.col("text")).select("license", "notice", F.array_distinct("sh").alias("sh"))


def scan(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, start_shingle): the best match of each license in each row.

    Notices of one family that differ in a version only hold most of each other's shingles: such a
    text gives a row for each, and the greatest containment names the one that it is.

    Rows without a match are not returned; null, empty and short texts match nothing. Repeated
    rows give one match. Of a license's windows with equal containment the first counts. A null
    doc_id stays null. A notice needs five words. Other columns are ignored; texts are read
    whole, however long; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = stage(notice_table(spark, NOTICES if notices is None else notices).where(F.size("sh") > 0), "license-notices")
    by_scale: dict[int, list[int]] = {}
    for r in table.select(F.size("sh").alias("m")).distinct().collect():  # the notices given, no data
        by_scale.setdefault(scale(r["m"]), []).append(r["m"])
    bands = {size: max(bands_needed(m, size, contained) for m in sizes) for size, sizes in by_scale.items()}
    of_scale = {size: table.where(F.size("sh").isin(sizes)) for size, sizes in by_scale.items()}
    keys = {size: band_shingles(of_scale[size], bands[size]) for size in sorted(by_scale)}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    every = sorted({x for k in keys.values() for x in k})
    holds = F.exists("sh", lambda x: x.isin(every)) if every else F.lit(False)
    # the row number keeps the filter above the projection, where the shingles are computed once
    live = with_shingles(base, F.col("text")).select("doc_id", "row_key", "sh", F.monotonically_increasing_id().alias("__n"))
    live = stage(live.where((F.col("__n") >= 0) & holds).drop("__n"), "license-rows")
    found: DataFrame | None = None
    for size, wanted in of_scale.items():
        places = F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.get(F.col("sh"), i).isin(keys[size]))
        starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array((F.floor(i / size)).cast("int"), F.greatest(F.lit(0), F.floor(i / size).cast("int") - 1)))))
        windows = live.select("doc_id", "row_key", "sh", F.explode(starts).alias("w"))
        windows = windows.select("doc_id", "row_key", (F.col("w") * size).alias("start"), F.array_distinct(F.slice("sh", F.col("w") * size + 1, F.lit(2 * size))).alias("sh"))
        notice = banded(wanted.withColumnRenamed("sh", "notice_sh"), "notice_sh", bands[size])
        # as many rows as the given notices have bands
        pairs = banded(windows, "sh", bands[size]).join(F.broadcast(notice), ["band", "key"]).dropDuplicates(["doc_id", "row_key", "start", "license", "notice"])
        share = F.size(F.array_intersect("notice_sh", "sh")) / F.size("notice_sh")
        matches = pairs.select("doc_id", "row_key", "license", share.alias("containment"), "start").where(F.col("containment") >= contained)
        found = matches if found is None else found.unionByName(matches)
    if found is None:
        found = live.where("false").select("doc_id", "row_key", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start"))
    best = found.groupBy("doc_id", "row_key", "license").agg(F.max("containment").alias("containment"), F.min(F.struct(-F.col("containment"), F.col("start"))).alias("at"))
    return best.select("doc_id", "license", "containment", F.col("at.start").cast("long").alias("start_shingle"))

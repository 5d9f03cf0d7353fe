"""License scans with DataFrame functions only: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A file is looked at in units of two kinds: its lines, which hold titles and short notices, and its sentences, which may be wrapped over lines (they end at
. ; or : before white space and at blank lines), which hold header clauses and the clauses of licence bodies. A unit's licence is that of the template of
the highest cosine, if that is at least THRESHOLD and they share SHARED terms or all the template has. The file's licence is that of its best unit; ties go to the first name, and a notice of WEAK, which
stands beside other licences too, counts only where there is no other. Terms are runs of a-z and digits but for COMMON words; document frequencies are counted over the
templates, so weights don't change with the corpus. A unit can only reach the threshold with one of a template's anchors: without them, the norm of what it
may share is too small. That bound picks the units to score without losing any.

A file without a licence of its own takes that of the nearest ancestor directory with a licence file. Directories are equi-joined: each file gives one row
for each of its ancestors.

Defined cases: null and empty texts have no lines. Null paths neither give nor take a licence by inheritance. Of several licence files in a directory the
one of the highest cosine counts, then the first path. Repeated rows get equal results. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, text_of

#: Titles, notices and opening clauses of public licences, by SPDX name: fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Creative Commons Attribution 4.0 International",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL-3.0": (
        "GNU General Public License",
        "GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": ("All rights reserved",),
    "Unlicense": (
        "The Unlicense",
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
    ),
}
WEAK = ["Proprietary"]
#: Terms that a unit must share with a template at least, or all that it has: in some languages "mit" is a word like any other.
SHARED = 2
#: Where sentences end, in lowered text.
SENTENCES = r"(?<=[.;:])\s+|\n[ \t\r]*\n"
THRESHOLD = 0.8
#: Words too common in prose to tell anything, which are no terms.
COMMON = "a all and any are as at be by do for in into is it of on or other so that the this to under with without you".split()


#: Terms that are words in other languages, so they are looked for last.
LATE = ["mit", "cc"]


def _terms(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [t for t in out if t not in COMMON]


def weights(templates: dict[str, tuple[str, ...]]) -> tuple[dict[str, float], dict[tuple[str, int], dict[str, float]]]:
    """The inverse document frequency of each term, and each template's unit vector, by licence and number."""
    texts = {(name, k): text for name, variants in templates.items() for k, text in enumerate(variants)}
    n = len(texts)
    df = Counter(t for text in texts.values() for t in set(_terms(text)))
    idf = {t: 1 + math.log((1 + n) / (1 + k)) for t, k in df.items()}
    vectors = {}
    for key, text in texts.items():
        v = {t: k * idf[t] for t, k in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[key] = {t: x / norm for t, x in v.items()}
    return idf, vectors


def unknown_weight(templates: dict[str, tuple[str, ...]]) -> float:
    """The weight of terms that no template has."""
    return 1 + math.log(1 + sum(map(len, templates.values())))


def anchors(vectors: dict[tuple[str, int], dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a unit must hold one to reach the threshold with any template: those left out have a norm below it in each."""
    found: set[str] = set()
    for v in sorted(vectors.values(), key=len):
        if len(v) == SHARED:  # all its terms are needed, so one of them is enough to look for
            if not found & v.keys():
                found.add(max(v, key=lambda t: (t not in LATE, len(t) >= 5, v[t], t)))
            continue
        for t, _ in sorted(v.items(), key=lambda x: (x[0] in LATE, len(x[0]) < 5, -x[1], x[0])):
            if math.sqrt(sum(x * x for u, x in v.items() if u not in found)) < threshold - 1e-9:
                break
            found.add(t)
    return sorted(found)


def unit_matches(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file_key, licence, cosine): the best licence of each file (file_key, text) that has one."""
    spark = files.sparkSession
    idf, vectors = weights(templates)
    unknown = unknown_weight(templates)
    needed = anchors(vectors, threshold)
    short = "(^|[^a-z0-9])(" + "|".join(t for t in needed if len(t) < 5) + ")([^a-z0-9]|$)"
    some = lambda c: reduce(lambda a, b: a | b, [*[F.contains(c, F.lit(t)) for t in needed if len(t) >= 5], *([c.rlike(short)] if any(len(t) < 5 for t in needed) else [])])
    lines = files.select("file_key", F.lower(text_of()).alias("low")).where(some(F.col("low")))
    units = F.array_distinct(F.concat(F.split("low", "\n"), F.split("low", SENTENCES)))
    lines = lines.select("file_key", F.posexplode(units).alias("line", "content"))
    lines = lines.where(some(F.col("content"))).select("file_key", "line", F.filter(F.split("content", "[^a-z0-9]+"), lambda t: ~t.isin("", *COMMON)).alias("terms"))
    lines = lines.where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in needed])))
    counted = lines.select("file_key", "line", F.explode("terms").alias("term")).groupBy("file_key", "line", "term").agg(F.count("*").alias("n"))
    idf_rows = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    vector_rows = spark.createDataFrame([(t, name, k, x, len(v)) for (name, k), v in sorted(vectors.items()) for t, x in sorted(v.items())], "term string, licence string, variant int, weight double, terms int")
    valued = counted.join(F.broadcast(idf_rows), "term", "left").withColumn("value", F.col("n") * F.coalesce("idf", F.lit(unknown)))  # bounded by the templates
    valued = table(valued.select("file_key", "line", "term", "value"), "terms")
    norms = valued.groupBy("file_key", "line").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(F.broadcast(vector_rows), "term").groupBy("file_key", "line", "licence", "variant").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"), F.count("*").alias("shared"), F.max("terms").alias("terms"))
    dots = dots.where((F.col("shared") >= SHARED) | (F.col("shared") == F.col("terms")))
    both = dots.join(norms, ["file_key", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= threshold)
    best = both.groupBy("file_key").agg(F.min(F.struct(F.col("licence").isin(WEAK).alias("weak"), (-F.col("cosine")).alias("less"), F.col("licence").alias("name"))).alias("best"))
    return best.select("file_key", F.col("best.name").alias("licence"), (-F.col("best.less")).alias("cosine"))


def ancestors(path: Column) -> Column:
    """The directories of a path, the nearest first; the root is the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, is_licence_file: Column, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """licence, cosine, licence_source (own, inherited or null) and inherited_from for every row of files (file_key, path, text, others).

    file_key must tell texts apart; is_licence_file says of a row whether its licence holds for its directory. Columns of files that are named like
    those given are replaced.
    """
    files = files.drop("licence", "cosine", "licence_source", "inherited_from", "near_path", "near_licence", "near_cosine", "own_key")
    own = table(unit_matches(files, templates, threshold).withColumnRenamed("file_key", "own_key"), "licences")
    rows = files.join(maybe_broadcast(own), F.col("file_key").eqNullSafe(F.col("own_key")), "left").drop("own_key")
    has = F.col("licence").isNotNull()
    given = rows.where(has & is_licence_file & F.col("path").isNotNull()).select(F.element_at(ancestors(F.col("path")), 1).alias("dir"), F.struct((-F.col("cosine")).alias("less"), F.col("path").alias("from"), F.col("licence").alias("of")).alias("g"))
    given = maybe_broadcast(table(given.groupBy("dir").agg(F.min("g").alias("g")), "directories"))
    needy = rows.where(~has & F.col("path").isNotNull()).select("path").distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    near = needy.join(given, "dir").groupBy("path").agg(F.min(F.struct("up", "g")).alias("near"))
    near = near.select(F.col("path").alias("near_path"), F.col("near.g.of").alias("near_licence"), (-F.col("near.g.less")).alias("near_cosine"), F.col("near.g.from").alias("inherited_from"))
    near = table(near, "inherited")
    out = rows.join(maybe_broadcast(near), ~has & (F.col("path") == F.col("near_path")), "left")
    source = F.when(has, "own").when(F.col("near_licence").isNotNull(), "inherited")
    return out.select(*[c for c in files.columns if c != "text"], F.coalesce("licence", "near_licence").alias("licence"), F.coalesce("cosine", "near_cosine").alias("cosine"), source.alias("licence_source"), "inherited_from")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, cosine, licence_source and inherited_from of documents, laid out as source/hundreds/doc_id.

    A document that holds a licence line and little else (512 characters at most) counts as its directory's licence file.
    """
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("file_key"), "text", (F.char_length(text_of()) <= 512).alias("short"))
    return scan(files, F.col("short")).drop("file_key", "short")


def templates_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, text) for name, texts in sorted(TEMPLATES.items()) for text in texts], "licence string, text string")

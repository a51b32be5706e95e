"""Licence scan: TF-IDF cosine of every line to licence templates, then the nearest ancestor folder's licence."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, lower_ascii, small, written

# Licence names and the sentences by which files declare them.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE 2.0"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3 Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.6


def terms_of(line: Column) -> Column:
    return F.filter(F.split(lower_ascii(line), "[^a-z0-9]+"), lambda w: w != "")


def _python_terms(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _vectors(templates: tuple, idf: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for _, text in templates:
        raw = {t: n * idf[t] for t, n in Counter(_python_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append({t: x / norm for t, x in raw.items()})
    return out


def _anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a line must hold one to reach the threshold with any template.

    Without the heaviest terms of a template, what is left of its unit vector is shorter than the
    threshold, and so is every product with it.
    """
    found = set()
    for vector in vectors:
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda tw: (-tw[1], tw[0])):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            found.add(term)
            rest -= w * w
    return sorted(found)


def declared(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, the columns to ``keep``, ``text_hash``, ``license`` and ``cosine`` of its best line (NULL below the threshold).

    Every line of the whole text is a unit. Weights are counts times ``ln((lines + 1) / (df + 1)) + 1``,
    df over all lines of all documents; a word of no template counts as unseen. Only the frequencies of
    template words are gathered, a fixed number. Equal cosines (to six places) give the later name.
    NULL and empty texts, and lines without words, match nothing; repeated rows get equal results.
    """
    check_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    vocabulary = sorted({t for _, text in templates for t in _python_terms(text)})
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("_id"), *kept, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    lines = rows.select("_id", "_text", F.posexplode(F.split("_t", "\n")).alias("_no", "_line")).select("_id", "_text", "_no", terms_of(F.col("_line")).alias("_w"))
    words = F.array(*[F.lit(t) for t in vocabulary])
    # the empty word stands for the line itself
    counts = {
        r["w"]: r["n"] for r in lines.where(F.size("_w") > 0).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("_w", words))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row a template word
    }
    total = counts.get("", 0)
    idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}
    vectors = _vectors(templates, idf)
    weights = spark.createDataFrame([(t, idf[t], [v.get(t, 0.0) for v in vectors]) for t in vocabulary], "term string, idf double, vector array<double>")
    anchors = F.array(*[F.lit(t) for t in _anchors(vectors, threshold)])
    unseen = math.log(total + 1) + 1
    candidates = (
        lines.where(F.arrays_overlap("_w", anchors)).select("_id", "_text", "_no", F.explode("_w").alias("term"))
        .groupBy("_id", "_text", "_no", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(F.broadcast(weights), "term", "left")  # one row a template word
        .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    )
    scored = candidates.groupBy("_id", "_text", "_no").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.sum(F.when(F.col("vector").isNotNull(), F.col("w") * F.get("vector", F.lit(i))).otherwise(0.0)).alias(f"d{i}") for i in range(len(templates))],
    )
    best = F.array_max(F.array(*[
        F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("cosine"), F.lit(name).alias("license")) for i, (name, _) in enumerate(templates)
    ]))
    found = scored.select("_id", "_text", best.alias("b")).where(F.col("b.cosine") >= threshold).groupBy("_id", "_text").agg(F.max("b").alias("b"))
    found = written(found.select(F.col("_id").alias("_fid"), F.col("_text").alias("_ft"), "b.license", "b.cosine"))
    return rows.drop("_t").join(
        small(found), F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ft")), "left"
    ).select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text_hash"), "license", "cosine")


def folder_of(path: Column) -> Column:
    """Folder of a path; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, path_col: str = "path", licence_file_col: str = "is_license_file") -> DataFrame:
    """``files`` (with ``license``, ``cosine``) plus ``effective`` and ``inherited_from``.

    A file's own licence stands; a file without one takes that of the nearest folder above it,
    its own folder first, in which a licence file declares one. Of several licence files of a
    folder the one with the highest cosine counts, then the later name. Paths are opened into
    their folders, as many as they are deep, and joined by folder; the folder table has one row
    a folder. NULL paths inherit nothing; repeated paths get equal results.
    """
    check_columns(files, path_col, licence_file_col, "license", "cosine")
    folders = written(
        files.where(F.col(licence_file_col) & F.col("license").isNotNull() & F.col(path_col).isNotNull())
        .groupBy(folder_of(F.col(path_col)).alias("folder")).agg(F.max(F.struct("cosine", "license")).alias("best")).select("folder", F.col("best.license").alias("given"))
    )
    parts = F.split(folder_of(F.col("_path")), "/")
    above = F.concat(
        F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("folder"))),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("folder"))),
    )
    wanting = files.where(F.col("license").isNull() & F.col(path_col).isNotNull()).select(F.col(path_col).alias("_path")).distinct()
    nearest = (
        wanting.select("_path", F.explode(above).alias("a")).select("_path", "a.depth", "a.folder").join(small(folders), "folder")
        .groupBy("_path").agg(F.max(F.struct("depth", "folder", "given")).alias("n")).select("_path", F.col("n.folder").alias("inherited_from"), F.col("n.given").alias("_given"))
    )
    f = files.alias("f")
    return f.join(nearest, (F.col(f"f.`{path_col}`") == F.col("_path")) & F.col("f.license").isNull(), "left").select(
        "f.*", F.coalesce("f.license", "_given").alias("effective"), "inherited_from"
    )

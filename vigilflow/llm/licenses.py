"""Licence scan: TF-IDF cosine of licence passages to templates, then inheritance from the nearest directory.

Passages are the lines of a file that hold a licence cue and, of a licence file,
its whole text.  Their sparse TF-IDF vectors are compared with those of the
templates.  A file without licence of its own takes that of the nearest
directory above it that has a licence file, found by joins of path prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilflow.llm.common import lookup
from vigilflow.session import settle

#: Licence notices by SPDX identifier; texts as their licences ask to have them put into files.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: A line is a licence passage only if it holds one of these.
CUE = r"(?i)licen[cs]|copyright|permission is hereby|redistribut|spdx"
#: Names of licence files, without extension.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Least cosine of a passage to a template.
COSINE = 0.7


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, i, t) for k, ts in templates.items() for i, t in enumerate(ts)], "license string, variant int, text string")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def match_passages(passages: DataFrame, templates: DataFrame, least: float = COSINE) -> DataFrame:
    """``h1, h2, license, cosine`` of the passages ``(h1, h2, text, n)`` whose best template reaches ``least``.

    Term weights are counts times ln((1 + N) / (1 + df)) + 1 with N and df over
    all passages, repeats (``n``) included.  Of equally near licences the first by name.
    """
    counted = settle(
        passages.select("h1", "h2", "n", F.explode(terms(F.col("text"))).alias("term")).groupBy("h1", "h2", "n", "term").agg(F.count(F.lit(1)).alias("tf")),
        "terms",
    )
    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    model = templates.select("license", "variant", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "variant", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = settle(counted.groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    idf = lambda df: F.log((1 + F.col("total")) / (1 + F.coalesce(df, F.lit(0)))) + 1
    # the one-row total goes to every task
    frequencies = frequency.join(F.broadcast(total)).select("term", idf(F.col("df")).alias("idf"))
    weighted = counted.join(lookup(frequencies), "term").select("h1", "h2", "term", (F.col("tf") * F.col("idf")).alias("w"))
    weighted = settle(weighted, "weights")
    # templates are given texts, so their terms are few
    sides = model.join(frequency, "term", "left").join(F.broadcast(total)).select("license", "variant", "term", (F.col("tf") * idf(F.col("df"))).alias("v"))
    sides = settle(sides, "templates")
    lengths = sides.groupBy("license", "variant").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    norms = weighted.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        weighted.join(lookup(sides), "term")
        .groupBy("h1", "h2", "license", "variant").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        .join(lookup(lengths), ["license", "variant"])
    )
    near = dots.join(norms, ["h1", "h2"]).select("h1", "h2", "license", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6).alias("cosine"))
    best = near.filter(F.col("cosine") >= least).groupBy("h1", "h2").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license", "cosine")).alias("best"))
    return best.select("h1", "h2", "best.license", "best.cosine")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """``directory, license, license_directory`` of the nearest of each directory and those above it that is in ``licensed``."""
    parts = F.split("directory", "/")
    prefix = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = directories.distinct().select("directory", F.posexplode(prefix).alias("depth", "license_directory"))
    found = above.join(lookup(licensed.withColumnRenamed("directory", "license_directory")), "license_directory")
    nearest = found.groupBy("directory").agg(F.max(F.struct("depth", "license", "license_directory")).alias("near"))
    return nearest.select("directory", "near.license", "near.license_directory")


def scan(
    files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = COSINE,
) -> DataFrame:
    """``doc_id, path, own_license, own_cosine, license, license_directory`` for every row.

    ``own_license`` is that of the file's nearest passage; ``license`` is it or else
    the inherited one, whose directory is named.  Of several licence files in a
    directory the one with the highest cosine counts, then the smallest id.

    Null and empty texts have no passage.  Rows without path inherit nothing.
    Rows with a null or repeated id are treated each for itself.  Texts of any length
    are read whole; equal passages are compared once.  Other columns are not
    read.  No rows: no rows.
    """
    spark = files.sparkSession
    rows = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(path_column).cast("string").alias("path"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    is_file = F.coalesce(F.regexp(_name(F.col("path")), F.lit(FILE_NAME)), F.lit(False))
    cued = F.when(F.regexp("text", F.lit(CUE)), F.filter(F.transform(F.split("text", "\n"), F.trim), lambda s: F.regexp(s, F.lit(CUE)))).otherwise(F.array().cast("array<string>"))
    whole = F.when(is_file & (F.trim("text") != ""), F.array(F.trim("text"))).otherwise(F.array().cast("array<string>"))
    base = settle(
        rows.select("row", "doc_id", "path", _directory(F.col("path")).alias("directory"), is_file.alias("is_file"), F.array_distinct(F.concat(cued, whole)).alias("passages")),
        "files",
    )
    key = (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    places = base.select("row", F.explode("passages").alias("text")).select("row", "text", *key)
    passages = settle(places.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "passages")
    matched = settle(match_passages(passages, template_rows(spark, templates), least), "matched")
    own = places.select("row", "h1", "h2").join(lookup(matched), ["h1", "h2"]).groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license", "cosine")).alias("own"))
    judged = settle(
        base.drop("passages").join(own, "row", "left").select("row", "doc_id", "path", "directory", "is_file", F.col("own.license").alias("own_license"), F.col("own.cosine").alias("own_cosine")),
        "judged",
    )
    licensed = judged.filter("is_file and own_license is not null").groupBy("directory").agg(
        F.min(F.struct((-F.col("own_cosine")).alias("order"), "doc_id", "own_license")).alias("best")
    ).select("directory", F.col("best.own_license").alias("license"))
    near = settle(inherited(judged.filter("directory is not null").select("directory"), licensed), "inherited")
    given = judged.join(lookup(near), "directory", "left")
    return given.select(
        "doc_id", "path", "own_license", "own_cosine",
        F.coalesce("own_license", "license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("license_directory")).alias("license_directory"),
    )

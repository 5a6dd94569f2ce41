"""License scan by sparse TF-IDF cosine, in DataFrame functions only.

Sentences and lines of a file are compared with sentences of licence templates.  Files of which
the licence takes a large part are licence files of their directory; a file without a licence of
its own inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, written

#: Sentences that state a licence in headers and licence files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of the SQL statement, which looks at sentences with one of them only; ``license_scan`` looks at all.
ANCHORS = ("license", "licensed", "licence", "licenced", "released", "permission", "redistribution", "redistribute", "domain", "mozilla", "apache", "gnu", "bsd", "mit", "cc", "cc0")
_BREAK = r"[.!?]\s+|\n+"
_APART = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _APART), lambda w: w != "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def template_rows(templates: Sequence[tuple[str, str]]) -> tuple[list[tuple[int, str, str, int]], list[str]]:
    """(template, license, term, tf) rows and the vocabulary."""
    rows, vocabulary = [], set()
    for k, (name, text) in enumerate(templates):
        own = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        vocabulary |= set(own)
        rows += [(k, name, w, own.count(w)) for w in sorted(set(own))]
    return rows, sorted(vocabulary)


def _template_terms(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """The rows as a table of constants, and the vocabulary."""
    rows, vocabulary = template_rows(templates)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t(template, license, term, tf)"), vocabulary


def license_scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.6, file_share: float = 0.25) -> DataFrame:
    """``keep``, path, own_license, cosine, license and inherited_from of every row.

    Weights are tf * (ln((1 + N) / (1 + df)) + 1) with N and df counted over all rows; words that
    no template has count with df 0.  A row's own licence is the template's with the largest
    cosine over its sentences (equal cosines: the name that sorts last), if that reaches
    ``least``.  A row is a licence file if its name says so or at least ``file_share`` of its
    words stand in matched sentences; rows without an own licence take that of the nearest
    directory on their path, their own included, with a licence file (of several the best match).
    Null texts are empty, null paths inherit nothing, repeated rows are judged one by one.  One
    pass reads the texts.  Only words of sentences that can reach ``least`` are shuffled: a cosine is at
    most the length of that part of a template's unit vector whose words the sentence has, so none is lost.  An empty table
    gives none.  ``keep`` must not name a column that is added (ValueError); other columns are not
    looked at, whatever their names.
    """
    clear_of(keep, "path", "own_license", "cosine", "license", "inherited_from")
    spark = files.sparkSession
    template, vocabulary = _template_terms(spark, templates)
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = files.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(path).alias("path"), body.alias("body"), tokens(body).alias("words"))
    scanned = scanned.withColumn("present", F.array_intersect(_strings(vocabulary), "words"))
    scanned = scanned.select(*(f"k{i}" for i in range(len(keep))), "path", F.size("words").alias("n_words"), "present", F.when(F.size("present") > 0, F.col("body")).alias("body"), F.monotonically_increasing_id().alias("row"))
    scanned = written(scanned, "license-scan")

    total = scanned.agg(F.count("*").alias("n"))
    df = scanned.select(F.explode("present").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # one row for a template's term: bounded by the templates
    weigh = lambda d: F.log((F.col("n") + 1) / (d + 1)) + 1
    terms = template.join(F.broadcast(df), "term", "left").crossJoin(F.broadcast(total)).withColumn("idf", weigh(F.coalesce("df", F.lit(0))))
    idf = terms.select("term", "idf").distinct()
    weights = terms.withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weights = weights.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("w") / F.col("t_norm")).alias("t_w"))

    # one row of squared weights: of each term in the template where it weighs most, and of each template
    square = F.col("t_w") * F.col("t_w")
    as_map = lambda v: F.map_from_entries(F.collect_list(F.struct("term", v)))
    most = weights.groupBy("term").agg(F.max(square).alias("most")).agg(as_map(F.col("most")).alias("__most"))
    each = weights.groupBy("template").agg(as_map(square).alias("m")).agg(F.collect_list("m").alias("__each"))
    bounds = F.broadcast(most.crossJoin(each))
    enough = max(least - 1e-6, 0.0) ** 2 - 1e-9
    reach = lambda terms, held: F.aggregate(terms, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(held, w), F.lit(0.0))) >= enough
    able = scanned.where("body is not null").crossJoin(bounds).where(reach(F.col("present"), F.col("__most")))
    sentence = able.select("row", F.posexplode(F.split("body", _BREAK)).alias("at", "s"), "__most", "__each").select("row", "at", tokens(F.col("s")).alias("words"), "__most", "__each")
    sentence = sentence.withColumn("own", F.array_intersect(_strings(vocabulary), "words")).where(F.size("own") > 0).where(reach(F.col("own"), F.col("__most")))
    sentence = sentence.where(F.exists("__each", lambda m: reach(F.col("own"), m))).select("row", "at", "words")
    counted = sentence.select("row", "at", F.explode("words").alias("term")).groupBy("row", "at", "term").agg(F.count("*").alias("tf"))
    counted = counted.join(F.broadcast(idf), "term", "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * F.coalesce("idf", weigh(F.lit(0))))
    size = counted.groupBy("row", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n"))
    dots = counted.join(F.broadcast(weights), "term").groupBy("row", "at", "template", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    best = dots.join(size, ["row", "at"]).groupBy("row", "at").agg(F.max(F.struct(F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), F.col("license").alias("license"))).alias("b"), F.first("n").alias("n"))
    best = best.where(F.col("b.cosine") >= least).groupBy("row").agg(F.max("b").alias("b"), F.sum("n").alias("n_matched"))

    judged = scanned.drop("body", "present").join(best, "row", "left").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    named = F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike("^(licen[cs]e|copying|unlicense)")
    of_dir = judged.where(F.col("b").isNotNull() & F.col("path").isNotNull() & (named | (F.col("n_matched") >= file_share * F.col("n_words")))).groupBy("dir").agg(F.max("b.cosine").alias("c"), F.max("b").alias("b"))
    of_dir = of_dir.select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license"))
    dirs = judged.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("a")).select("dir", "a.*")
    near = above.join(of_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("near"))
    out = judged.join(near, "dir", "left")
    own = F.col("b.license")
    return out.select(
        *(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)),
        "path",
        own.alias("own_license"),
        F.col("b.cosine").alias("cosine"),
        F.coalesce(own, F.when(F.col("path").isNotNull(), F.col("near.dir_license"))).alias("license"),
        F.when(own.isNull() & F.col("path").isNotNull(), F.col("near.above")).alias("inherited_from"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: below source and language, ids not divisible by 4 one directory deeper by the hundred."""
    hundred = F.when(F.col("doc_id") % 4 != 0, F.floor(F.col("doc_id") / 100).cast("string"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), hundred, name).alias("path"))

"""License scans: TF-IDF cosine of licence lines to templates, then inheritance from the nearest ancestor directory.

Every line of every whole text that has a cue word is a candidate; so is the
whole text of a file with a licence's name.  Candidates and templates are sparse
TF-IDF vectors (a row for each word); document frequencies are counted over all
candidates.  A file's own licence is its best candidate's template, if the cosine
reaches ``LEAST``.

A file is a licence file of its directory if it is named so, or if licence lines
make up half of its words.  Files without a licence of their own take that of
the nearest directory above them that has one, by a join on directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

LEAST = 0.5
BROADCAST_ROWS = 100_000
TOP, SALTS = 3, 64
CUE = r"(?i)licen[sc]|copyright|spdx|permission|warrant|redistribut|public domain|released under"
NAMED = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)[^/]*$"
#: Statements by which licences are commonly declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}.]*[\p{L}\p{N}]"), F.lit(0))


def candidates(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, named, n, line, text) of each candidate; n counts the file's words."""
    text = F.coalesce("text", F.lit(""))
    named = F.coalesce(F.col(key).cast("string").rlike(NAMED), F.lit(False))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE))
    both = F.when(named, F.concat(F.array(text), lines)).otherwise(lines)
    cut = files.where(text.rlike(CUE) | named).select(key, named.alias("named"), both.alias("lines"), F.size(_words(text)).alias("n"))
    return cut.select(key, "named", "n", F.posexplode("lines").alias("line", "text")).where("length(text) > 0")


def own_licenses(files: DataFrame, key: str = "path", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(key, license, cosine, of_dir) of the files with a licence of their own."""
    spark = files.sparkSession
    lines = stored(candidates(files, key), "lines")
    words = lines.select(key, "line", F.explode(_words(F.col("text"))).alias("w")).groupBy(key, "line", "w").agg(F.count("*").alias("tf"))
    words = stored(words, "words")
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    n = lines.count()
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    shapes = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, body string")
    parts = shapes.select("t", "license", F.explode(_words(F.col("body"))).alias("w")).groupBy("t", "license", "w").agg(F.count("*").alias("tf"))
    parts = stored(parts.join(df, "w", "left").select("t", "license", "w", (F.col("tf") * idf).alias("tw")), "templates")
    norms = parts.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    parts = F.broadcast(parts.join(norms, "t"))  # as long as the templates
    weights = words.join(df, "w").withColumn("x", F.col("tf") * idf)
    size = weights.groupBy(key, "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("ln"))
    dots = weights.join(parts, "w").groupBy(key, "line", "t", "license", "tn").agg(F.sum(F.col("x") * F.col("tw")).alias("dot"))
    near = dots.join(size, [key, "line"]).withColumn("cosine", F.round(F.col("dot") / (F.col("tn") * F.col("ln")), 6)).where(F.col("cosine") >= least)
    best = near.groupBy(key, "line").agg(F.max(F.struct("cosine", F.col("license"))).alias("b")).select(key, "line", "b.cosine", "b.license")
    best = best.join(lines.select(key, "line", "named", "n", F.size(_words(F.col("text"))).alias("len")), [key, "line"])
    return best.groupBy(key).agg(F.max(F.struct("cosine", "license")).alias("b"), F.max("named").alias("named"), F.sum("len").alias("len"), F.max("n").alias("n")).select(key, "b.license", "b.cosine", (F.col("named") | (2 * F.col("len") >= F.col("n"))).alias("of_dir"))


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, own, cosine, license, from_dir) for every file (path, text).

    ``license`` is the file's own or the nearest ancestor directory's, else null;
    ``from_dir`` names that directory ("" is the root).  Two licence files in one
    directory: the higher cosine holds, then the later name.  A null path has no
    ancestors; null and empty texts have no licence of their own; files that
    share a path share the best own licence.  An empty table gives an empty one.
    """
    own = stored(own_licenses(files.select(path, "text"), path, templates, least), "own")
    dirs = own.where("of_dir").withColumn("dir", _dir(F.col(path))).groupBy("dir").agg(F.max(F.struct("cosine", "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    put = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    dirs = stored(dirs, "dirs")
    files = files.select(path).withColumn("d", _dir(F.col(path)))
    steps = F.split("d", "/")
    above = files.select("d").where("d is not null").distinct().withColumn("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))))
    above = above.distinct()
    small = dirs.count() <= BROADCAST_ROWS
    if small:
        near = above.join(F.broadcast(dirs), "dir")
    else:  # the root and directories below it stand above most others: their rows are dealt out
        salt = F.when(F.size(F.split("dir", "/")) <= TOP, F.pmod(F.xxhash64("d"), F.lit(SALTS))).otherwise(0).cast("int")
        salts = F.when(F.size(F.split("dir", "/")) <= TOP, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        near = above.withColumn("salt", salt).join(dirs.withColumn("salt", F.explode(salts)), ["dir", "salt"]).drop("salt")
    nearest = stored(near.groupBy("d").agg(F.max(F.struct(F.length("dir"), "dir", "dir_license")).alias("b")).select("d", F.col("b.dir").alias("dir"), "b.dir_license"), "nearest")
    out = files.join(put(own.withColumnRenamed("license", "own").drop("of_dir")), path, "left").join(put(nearest), "d", "left")
    return out.select(path, "own", "cosine", F.coalesce("own", "dir_license").alias("license"), F.when(F.col("own").isNull(), F.col("dir")).alias("from_dir"))

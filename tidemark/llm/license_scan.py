"""Licences of files, wholly in DataFrame and SQL functions.

Headers are the lines that speak of licences; a licence file (by its name) is also taken as a whole.  Each
becomes a sparse TF-IDF vector over its words, and so does each template; inverse document frequencies are
those of the templates, and words of no template weigh as the rarest do.  The cosine needs only the words
that both hold, so header words join the templates' words (a table of fixed size, broadcast).  A header has
the licence of the most similar template if the cosine reaches ``SIMILAR``; a file has those of its headers,
the most similar one first.

A licence file, by name or because licence headers make up at least half of its words, speaks for its
directory.  A file without a licence of its own inherits from the nearest ancestor directory that has one:
distinct directories are spelled out into their ancestors and joined with the directories that have a licence;
files then join their own directory's answer.  Files are never compared with files.

Defined results: null and empty texts have no licence of their own and may inherit; a null path has no
directory and inherits nothing; rows that repeat are judged each; of equal similarities the licence name
first in order wins; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.staging import stage

SIMILAR = 0.6
TRIGGER = r"(?i)licen[sc]|copyright|copyleft|public domain|spdx|all rights reserved|permission is hereby|redistribution and use"
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice|copyright)([._-][^/]*)?$"

#: Statements by which works name their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("MPL-2.0", "Licensed under the Mozilla Public License 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"), ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"), ("ISC", "Licensed under the ISC License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"), ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("Proprietary", "Copyright. All rights reserved."),
]


def words(text):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_words(spark) -> DataFrame:
    """(template, licence, word, weight) with unit vectors, and idf per word."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, text string")
    tf = rows.select("template", "licence", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "licence", "word").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("word").agg((F.log(F.lit(len(TEMPLATES)) / F.count("*")) + 1).alias("idf"))
    raw = tf.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "template").select("template", "licence", "word", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def header_licences(files: DataFrame) -> DataFrame:
    """(file, licence, score, n_words) per header of ``files`` (file, path, text) that matches a template."""
    rare = math.log(len(TEMPLATES)) + 1
    known = stage(template_words(files.sparkSession), "templates")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(TRIGGER))
    lines = F.when(F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), F.concat(lines, F.array("text"))).otherwise(lines)
    headers = files.filter(F.col("text").rlike(TRIGGER)).select("file", F.posexplode(lines).alias("line", "header"))
    tf = headers.select("file", "line", F.explode(words(F.col("header"))).alias("word")).groupBy("file", "line", "word").agg(F.count("*").alias("tf"))
    idf = F.broadcast(known.select("word", "idf").distinct())
    vector = stage(tf.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare))).select("file", "line", "word", "tf", "w"), "vectors")
    norm = vector.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_words"))
    dot = vector.join(F.broadcast(known), "word").groupBy("file", "line", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    score = dot.join(norm, ["file", "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = score.groupBy("file", "line", "n_words").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("b"))
    return best.filter(F.col("b.score") >= SIMILAR).select("file", "b.licence", "b.score", "n_words")


def directory_licences(own: DataFrame, directories: DataFrame) -> DataFrame:
    """(dir, inherited): for each of ``directories`` the licence of its nearest ancestor, itself included."""
    parts = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))).alias("a")).select("dir", "a.depth", "a.ancestor")
    return above.join(own.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by("licence", "depth").alias("inherited"))


def scan_licences(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, licence, how (own or inherited),
    score of the own licence, licences (all own, sorted) and n_headers."""
    file = F.xxhash64("path", "text")
    base = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = base.filter(F.col("text").rlike(TRIGGER)).select(file.alias("file"), "path", "text").dropDuplicates(["file"])
    found = stage(header_licences(distinct), "headers")
    own = found.groupBy("file").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("b"), F.sort_array(F.collect_set("licence")).alias("licences"),
                                    F.count("*").alias("n_headers"), F.sum("n_words").alias("said"))
    folder = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    slim = stage(base.select("doc_id", "path", file.alias("file"), folder.alias("dir"), F.size(words(F.when(F.col("text").rlike(TRIGGER), F.col("text")).otherwise(""))).alias("n_words")), "files")
    judged = stage(slim.join(own, "file", "left"), "judged")
    speaks = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)) | (2 * F.col("said") >= F.col("n_words"))
    named = judged.filter(F.col("b").isNotNull() & F.col("dir").isNotNull() & speaks).groupBy("dir").agg(
        F.min_by("b.licence", F.struct((~F.col("path").rlike(LICENSE_FILE)).alias("other"), -F.col("b.score"), F.col("b.licence"))).alias("licence"))
    answers = directory_licences(stage(named, "named"), judged.filter("dir IS NOT NULL").select("dir").distinct())
    whole = judged.join(answers, "dir", "left")
    return whole.select("doc_id", "path", F.coalesce("b.licence", "inherited").alias("licence"),
                        F.when(F.col("b").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("how"), F.col("b.score").alias("score"),
                        F.coalesce("licences", F.array().cast(T.ArrayType(T.StringType()))).alias("licences"), F.coalesce("n_headers", F.lit(0).cast("long")).alias("n_headers"))

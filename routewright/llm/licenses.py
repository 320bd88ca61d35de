"""Licence notices in texts, in DataFrame operations only.

Every line of a text is a segment. Segments and notice templates are normalised to lower-case words and compared by the
Dice coefficient of their sets of word bigrams. A template can reach the limit only if the set sizes are within fixed
bounds of each other and if enough of the segment's bigrams are in templates at all; both prune before any comparison.

Result: one row for each document and licence that it names, with the number of different segments and the best
coefficient. A segment names the licence of its best template; ties go to the smaller licence id. Null and empty texts
have no segments. Rows that repeat a doc_id are one document; rows without a doc_id are one document without a name.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence ids and the names that notices use for them.
LICENSE_NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "isc": ["ISC License"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "mit": ["MIT License", "MIT license (MIT)"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "unlicense": ["Unlicense"],
}
#: How notices begin.
LEADS = ["Licensed under", "Released under", "Distributed under the terms of", "This work is licensed under",
         "This program is free software licensed under"]
#: Sentences of longer notices.
SENTENCES = {
    "apache-2.0": ["you may not use this file except in compliance with the License"],
    "gpl-3.0": ["either version 3 of the License, or (at your option) any later version"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Least Dice coefficient of a match.
LEAST_DICE = 0.75


def notices() -> list[tuple[str, str]]:
    """(licence id, notice) of all templates: every lead with every name, and the sentences."""
    out = [(key, f"{lead} {article}{name}") for key, names in LICENSE_NAMES.items() for name in names for lead in LEADS
           for article in (["", "the "] if name[:2] != "CC" else [""])]
    return out + [(key, text) for key, texts in SENTENCES.items() for text in texts]


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(transform(slice({words}, 1, size({words}) - 1), (w, i) -> xxhash64(w, get({words}, i + 1))))")


def templates(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """``template, license, t_size, bigram``: a row for each bigram of each notice."""
    each = [F.struct(F.lit(n).alias("template"), F.lit(k).alias("license"), F.lit(t).alias("notice")) for n, (k, t) in enumerate(pairs)]
    rows = spark.range(1).select(F.inline(F.array(*each)))
    rows = rows.select("template", "license", F.split(_normalised(F.col("notice")), " ").alias("words")).where("size(words) > 1")
    rows = rows.withColumn("bigrams", _bigrams("words"))
    return rows.select("template", "license", F.size("bigrams").alias("t_size"), F.explode("bigrams").alias("bigram"))


def scan(docs: DataFrame, pairs: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """``doc_id, license, n_segments, best_dice``."""
    spark = docs.sparkSession
    known = templates(spark, pairs or notices())
    # the templates are constants of this module or an argument of the call: their size does not follow the data
    reach = known.agg(F.min("t_size").alias("low"), F.max("t_size").alias("high")).first()
    low, high = (reach["low"] or 0) * least / (2 - least), (reach["high"] or 0) * (2 - least) / least
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    words = lines.select("doc_id", F.split(_normalised(F.col("line")), " ").alias("words"))
    segments = words.select("doc_id", F.xxhash64("words").alias("segment"), _bigrams("words").alias("bigrams"))
    segments = segments.withColumn("size", F.size("bigrams"))
    # a filter on the sizes, or one that explode() implies, would move below and split the line again for every word
    fitting = F.when(F.col("size").between(low, high), F.col("bigrams"))
    each = segments.select("doc_id", "segment", "size", F.explode_outer(fitting).alias("bigram"))
    in_some = each.join(F.broadcast(known.select("bigram").distinct()), "bigram", "left_semi")
    hits = in_some.groupBy("doc_id", "segment", "size").agg(F.collect_set("bigram").alias("bigrams"))
    hits = hits.where(F.size("bigrams") * (2 - least) >= least * F.col("size"))
    shared = (
        hits.select("doc_id", "segment", "size", F.explode("bigrams").alias("bigram")).join(F.broadcast(known), "bigram")
        .groupBy("doc_id", "segment", "size", "license", "template", "t_size").agg(F.count("*").alias("shared"))
        .withColumn("dice", 2.0 * F.col("shared") / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= least))
    best = shared.groupBy("doc_id", "segment").agg(F.max(F.struct("dice", F.col("template") * -1)).alias("best"))
    ids = known.select((F.col("template") * -1).alias("t"), "license").distinct()
    named = best.select("doc_id", "segment", F.col("best.dice").alias("dice"), F.col("best.col2").alias("t")).join(F.broadcast(ids), "t")
    return named.groupBy("doc_id", "license").agg(F.count("*").alias("n_segments"), F.round(F.max("dice"), 6).alias("best_dice"))

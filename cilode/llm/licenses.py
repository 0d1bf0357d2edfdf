"""License notices in texts, by diagonal voting.

All rolling K-word hashes of every text are joined with the positions of the same hashes in
license templates. A text that quotes a template gives matches of one offset (place in the
text less place in the template), a diagonal; a word too many or too few moves them to a
neighbouring one. Votes are counted per diagonal and neighbouring diagonals are merged. What
they cover is verified place by place: a place of the template counts once, and so does one
of the text, however often a run of words is repeated in either; enough of the template has
to be there, and densely enough. Of templates that share most of their words, as those of one
family of licenses, only the best covered one of a place in the text is kept.

The templates are a small table of known size and are broadcast while they stay below
TEMPLATE_WORDS; no text moves. Only matches are shuffled, after they were counted per text,
template and diagonal.

NULL counts as an empty text, which has no words. Repeated rows give repeated results. All
places count words, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cilode.llm.common import PLAIN_WORD, let, stored, words

K = 4
# Diagonals this close are one quotation.
NEIGHBOURS = 3
# A quotation covers at least this share of a template, and of its own words.
COVERED, DENSE = 0.6, 0.6
TEMPLATE_WORDS = 100_000

# The base phrases.
PHRASES = {
    ("mit", "license"): "mit",
    ("apache", "license"): "apache",
    ("general", "public", "license"): "gpl",
}

# Notices of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.",
    ),
    (
        "boost",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at",
    ),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "cc0",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
        "and related or neighboring rights to this work.",
    ),
]


def _words(text: Column) -> Column:
    """Words in lower case. Of all letters beyond ASCII only the Kelvin sign becomes an ASCII one,
    and no base phrase has a k: for them this is the same as lowering A-Z, at a tenth of the cost."""
    return words(F.lower(F.coalesce(text, F.lit(""))), PLAIN_WORD)


def _grams(held: Column) -> Column:
    """Hashes of all runs of K words."""
    return F.when(
        F.size(held) >= K,
        F.transform(F.sequence(F.lit(0), F.size(held) - K), lambda i: F.xxhash64(*[F.get(held, i + k) for k in range(K)])),
    )


def template_grams(spark: SparkSession, templates=tuple(TEMPLATES)) -> DataFrame:
    """gram, template, label, place in the template, and number of grams of the template."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, text string").coalesce(1)
    grams = table.select("template", "label", let(_words(F.col("text")), _grams).alias("grams"))
    exploded = grams.select(
        "template", "label", F.size("grams").alias("template_grams"), F.posexplode("grams").alias("template_at", "gram")
    )
    small = sum(len(text.split()) for _, text in templates) <= TEMPLATE_WORDS
    return F.broadcast(exploded) if small else exploded


def quotations(docs: DataFrame, templates=tuple(TEMPLATES)) -> DataFrame:
    """Verified quotations: doc_id, text_hash, label, score (share of the template covered),
    and first and last word in the text."""
    hashed = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.posexplode(let(_words(F.col("text")), _grams)).alias("at", "gram"),
    )
    row = ["doc_id", "text_hash", "template", "label", "template_grams"]
    matches = hashed.join(template_grams(docs.sparkSession, templates), "gram")
    # A repeated row votes once. Matches are few, and stored, so that texts are cut into words once for them.
    matches = stored(matches.select(*row, "at", "template_at").distinct(), "matches")
    votes = matches.groupBy(*row, (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    ordered = Window.partitionBy(*row).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(ordered) > NEIGHBOURS
    runs = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Each match in its run of diagonals. Matches are few next to the texts.
    placed = matches.withColumn("diagonal", F.col("at") - F.col("template_at")).join(
        runs.select(*row, "diagonal", "run"), [*row, "diagonal"]
    )
    merged = placed.groupBy(*row, "run").agg(
        F.count_distinct("template_at").alias("template_places"),
        F.count_distinct("at").alias("places"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    covered = F.least("template_places", "places")
    score = covered / F.col("template_grams")
    verified = merged.where((score >= COVERED) & (covered >= DENSE * (F.col("last") - F.col("first") + 1)))
    best = Window.partitionBy("doc_id", "text_hash", "first").orderBy(F.desc("score"), F.desc("template_grams"), "template")
    found = verified.select(*row, score.alias("score"), "first", (F.col("last") + K - 1).alias("last"))
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(
        "doc_id", "text_hash", "label", "score", "first", "last"
    )


def _places(held: Column, phrase: tuple[str, ...], label: str) -> Column:
    def here(i: Column) -> Column:
        same = F.get(held, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            same = same & F.coalesce(F.get(held, i + k) == word, F.lit(False))
        return same

    starts = F.filter(F.sequence(F.lit(0), F.size(held) - 1), here)
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def _base(held: Column) -> Column:
    """Number of words, and the places of the base phrases."""
    places = F.concat(*[_places(held, phrase, label) for phrase, label in PHRASES.items()])
    any_ = F.array_contains(held, "license")
    return F.struct(
        F.size(held).cast("long").alias("n_words"),
        F.when(any_, places).otherwise(F.array().cast("array<struct<at:long,label:string>>")).alias("places"),
    )


def report(docs: DataFrame, templates=tuple(TEMPLATES)) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row
    of `docs`. The score is the largest covered share of a verified template, 0 without one."""
    best = quotations(docs, templates).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("quoted"), F.max("score").alias("score")  # as many as there are licenses
    )
    base = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        let(_words(F.col("text")), _base).alias("base"),
    )
    best = best.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "quoted", "score")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    joined = base.join(best, same, "left")
    places = F.col("base.places")
    at = F.transform(places, lambda p: p["at"])
    names = F.array_distinct(F.transform(places, lambda p: p["label"]))
    every = F.array_union(names, F.coalesce("quoted", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        F.col("base.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

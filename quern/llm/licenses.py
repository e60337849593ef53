"""License scans with DataFrame operations alone: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory by joins over paths.

Units of a text are its lines, its paragraphs (between blank lines) and the whole; each is compared with the templates.
Terms weigh tf * idf, with idf = ln((1 + N) / (1 + df)) + 1 counted over all N texts; df is
counted for the templates' terms, any other term counts as one of a single text. A text whose line or paragraph reaches
the threshold has that header's licence; a text that reaches it as a whole is a licence file and stands for its folder.
Wholes that have a term of a template beyond idle ones (see below) are also compared with full licence texts (licence_texts),
terms weighing (1 + ln tf) * idf with idf counted over these wholes, so that neither common words nor length decide; one that reaches FULL is that licence's
file, whatever headers it quotes. A line that reserves all rights counts only where nothing else reaches the threshold.
A text without a licence of its own takes that of the nearest folder above it that has a licence file.

No match is lost by looking at fewer units: a unit that holds none of a template's terms but some idle ones has at most
the cosine sqrt(c), c being the part that these have in the template's squared length. Once idf is known, terms are made idle,
the most frequent first, as long as c stays below the threshold's square for all templates; units of idle terms alone are
left out. Texts whose only terms are COMMON ones aren't even written; if these can't all be idle, texts are scanned again.

Only the templates' terms (fixed, a few hundred) are broadcast. Texts are scanned once, and each one's terms found once. The
texts that may match are dealt by file, so their terms are counted, weighed and summed without another shuffle.
Inheritance is resolved for distinct folders, so a folder of any number of files is one row.

Defined results: null and empty texts have no licence of their own, but inherit. Null parts of a path count as "_". Of
equal matches the template of the smaller name wins, of several licence files in a folder the best, then that of the
smaller licence name. Repeated rows are separate files. Extra columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded, materialize, settled

#: Licences and the texts that announce them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Terms of the templates that nearly all prose has, in one of the corpora's languages.
COMMON = frozenset("a and are as at be by in is it mit of or that the this to with".split())
TERM = r"[a-z0-9]+(\.[0-9]+)*"
THRESHOLD = 0.6
#: The cosine from which a whole text is a copy of a full licence; other versions of a licence stay below, other holders above.
FULL = 0.85


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def full_texts() -> list[tuple[str, str]]:
    """Licences and their full texts, by name."""
    files = (f for f in resources.files("quern.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files)


def _templates(spark, texts: tuple | list = TEMPLATES) -> DataFrame:
    """template, license, term, tf."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def vocabulary(texts: tuple | list = TEMPLATES) -> list[str]:
    """The templates' terms."""
    return sorted({m[0] for _, text in texts for m in re.finditer(TERM, text.lower())})


def _any_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def term_weights(held: DataFrame, templates: DataFrame) -> tuple[DataFrame, float]:
    """idf of the templates' terms (term, idf), counted over all rows of held (held: the vocabulary's terms of a text), and
    that of any other term."""
    # one marker a text counts the texts
    counts = materialize(held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = counts.where("term = ''").agg(F.max("df")).collect()[0][0] or 0
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    return materialize(templates.select("term").distinct().join(counts, "term", "left").select("term", idf.alias("idf"))), math.log((n + 1) / 2) + 1


def _parts(templates: DataFrame, known: DataFrame) -> DataFrame:
    """term, idf, parts: the templates that have the term, their licences, and its part of the template's unit vector."""
    weighted = templates.join(F.broadcast(known), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    weighted = weighted.join(F.broadcast(norms), "template").select("template", "license", "term", "idf", (F.col("weight") / F.col("norm")).alias("part"))
    return weighted.groupBy("term", "idf").agg(F.collect_list(F.struct("template", "license", "part")).alias("parts"))


def idle_terms(parts: DataFrame, threshold: float, first: frozenset[str] = frozenset()) -> frozenset[str]:
    """Terms that can't make a match by themselves: as many as there can be, first ones first, then by idf."""
    rows = parts.select("term", "idf", F.explode("parts").alias("p")).select("term", "idf", "p.template", "p.part").collect()  # as many as TEMPLATES have
    shares: dict[int, float] = defaultdict(float)
    has: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for r in rows:
        has[r["term"]].append((r["template"], r["part"] ** 2))
    idf = {r["term"]: r["idf"] for r in rows}
    idle = set()
    for term in sorted(has, key=lambda t: (t not in first, idf[t], t)):
        if all(shares[t] + c < threshold * threshold - 1e-9 for t, c in has[term]):
            idle.add(term)
            for t, c in has[term]:
                shares[t] += c
    return frozenset(idle)


def units(held: DataFrame, anchors: list[str]) -> DataFrame:
    """file, kind, place, terms: of the lines, paragraphs and wholes of held (file, text) that have an anchor."""
    lines = held.select("file", F.lit("line").alias("kind"), F.posexplode(F.split("text", "\n")).alias("place", "unit"))
    paragraphs = held.select("file", F.lit("paragraph").alias("kind"), F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("place", "unit"))
    whole = held.select("file", F.lit("whole").alias("kind"), F.lit(0).alias("place"), F.col("text").alias("unit"))
    bags = [u.select("file", "kind", "place", terms(F.col("unit")).alias("terms")) for u in (lines, paragraphs, whole)]
    return bags[0].unionByName(bags[1]).unionByName(bags[2]).where(F.arrays_overlap("terms", _any_of(anchors)))


def _best(weights: DataFrame, unit: list[str], threshold: float) -> DataFrame:
    """unit, license, cosine: the best template of each unit that reaches the threshold; weights has a row for each term
    of a unit: weight, and parts or null. The length counts as one more template, whose parts are the unit's own weights."""
    own = F.array(F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), F.col("weight").alias("part")))
    none = F.array().cast("array<struct<template:int,license:string,part:double>>")
    dots = weights.select(*unit, "weight", F.explode(F.concat(F.coalesce("parts", none), own)).alias("p"))
    dots = dots.groupBy(*unit, F.col("p.template").alias("template"), F.col("p.license").alias("license")).agg(F.sum(F.col("weight") * F.col("p.part")).alias("dot"))
    of = lambda c: F.when(F.col("template") >= 0, c)
    best = dots.groupBy(*unit).agg(
        F.sqrt(F.max(F.when(F.col("template") < 0, F.col("dot")))).alias("size"), F.max(of(F.col("dot"))).alias("dot"),
        F.min_by(of(F.col("license")), of(F.struct(-F.round("dot", 9), "license"))).alias("license"),
    )
    return best.select(*unit, "license", F.least(F.col("dot") / F.col("size"), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= threshold)


def matches(held: DataFrame, parts: DataFrame, other: float, anchors: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """file, kind, license, cosine: the best template of each unit of held (file, text) that reaches the threshold; other is
    the idf of terms that parts lacks."""
    unit = ["file", "kind", "place"]
    bags = units(held.repartition("file"), anchors).select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    heavy = bags.join(F.broadcast(parts), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(other)))
    return _best(heavy, unit, threshold).drop("place")


def full_matches(held: DataFrame, threshold: float = FULL) -> DataFrame:
    """file, kind, license, cosine: the best full licence text of each whole of held (file, text) that reaches the threshold."""
    damped = lambda df: df.withColumn("tf", 1 + F.log("tf"))
    texts = full_texts()
    templates = materialize(damped(_templates(held.sparkSession, texts)))
    found = materialize(held.select("file", "text", F.array_intersect(terms(F.col("text")), _any_of(vocabulary(texts))).alias("held")))
    known, other = term_weights(found, templates)
    parts = materialize(_parts(templates, known))
    bags = damped(found.select("file", "text").repartition("file").select("file", F.explode(terms(F.col("text"))).alias("term")).groupBy("file", "term").agg(F.count("*").alias("tf")))
    heavy = bags.join(F.broadcast(parts), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(other)))
    return _best(heavy, ["file"], threshold).withColumn("kind", F.lit("full"))


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the nearest first; the root is ''."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file, path, own_license, own_cosine, license, inherited_from, license_file of every row of files (path, text).

    path has folders and a name, parted by /; file is a number of the row, given here."""
    return settled(lambda: _scan(files, threshold), files.sparkSession)


def _named(files: DataFrame, words: list[str], anchors: list[str]) -> DataFrame:
    """path, file (a number), held (the text's terms among words) and the text, if it has an anchor; written."""
    found = files.select(F.coalesce("path", F.lit("_")).alias("path"), "text", F.array_intersect(terms(F.coalesce("text", F.lit(""))), _any_of(words)).alias("held"))
    text = F.when(F.arrays_overlap("held", _any_of(anchors)), F.col("text")).alias("text")
    return materialize(found.select("path", "held", text).withColumn("file", F.monotonically_increasing_id()))


def _scan(files: DataFrame, threshold: float) -> DataFrame:
    templates, words = materialize(_templates(files.sparkSession)), vocabulary()
    named = _named(files, words, [w for w in words if w not in COMMON])
    known, other = term_weights(named, templates)
    parts = materialize(_parts(templates, known))
    idle = idle_terms(parts, threshold, COMMON)
    anchors = [w for w in words if w not in idle]
    if not idle >= COMMON & set(words):  # common terms alone might do
        named = _named(files, words, anchors)
    held = named.where(F.col("text").isNotNull() & F.arrays_overlap("held", _any_of(anchors))).select("file", "text")
    found = materialize(matches(held, parts, other, anchors, threshold).unionByName(full_matches(held)))
    rank = F.struct(F.col("kind") != "full", F.col("license") == "Proprietary", -F.round("cosine", 9), "license")
    pick = lambda kinds: found.where(F.col("kind").isin(*kinds)).groupBy("file").agg(F.min_by("cosine", rank).alias("cosine"), F.min_by("license", rank).alias("license"))
    own = pick(("line", "paragraph", "whole", "full")).select("file", F.col("license").alias("own_license"), F.col("cosine").alias("own_cosine"))
    whole = pick(("whole", "full")).select("file", F.col("license").alias("file_license"), F.col("cosine").alias("file_cosine"))
    rows = named.select("file", "path").withColumn("folder", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")))
    rows = materialize(rows.join(own, "file", "left").join(whole, "file", "left"))
    order = F.struct(-F.round("file_cosine", 9), "file_license")
    stands = rows.where("file_license is not null").groupBy("folder").agg(F.min_by("file_license", order).alias("folder_license")).select(F.col("folder").alias("above"), "folder_license")
    folders = rows.where("own_license is null").select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("far", "above"))
    stands = materialize(stands)
    near = folders.join(bounded(stands), "above").groupBy("folder").agg(F.min_by(F.struct("above", "folder_license"), "far").alias("near"))
    near = near.select("folder", F.col("near.above").alias("near_above"), F.col("near.folder_license").alias("near_license"))
    out = rows.join(bounded(materialize(near)), "folder", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        "file", "path", "own_license", "own_cosine", F.coalesce("own_license", "near_license").alias("license"),
        F.when(inherits, F.col("near_above")).alias("inherited_from"), F.col("file_license").isNotNull().alias("license_file"),
    )


def corpus_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.select(F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with the columns of scan(), of every row of docs (doc_id, source, lang, text)."""
    found = scan(corpus_paths(docs), threshold)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return found.select(F.when(name != "_", name).cast("long").alias("doc_id"), "own_license", F.round("own_cosine", 6).alias("own_cosine"), "license", "inherited_from", "license_file")

"""License scans: MinHash bands over text windows, exact containment.

A template is cut into sentences (and at empty lines; a line break alone is
white space), these into words (lower case, letters and digits) and 5-word
shingles; a shorter sentence is one shingle.  A text is one sequence of words
whatever its lines and sentences, so a notice that is wrapped or stands inside
a longer sentence is found like any other.  The sequence is covered by windows
of ``WINDOW`` shingles that overlap by half; a template's sentence has its
windows at every start.  A window's MinHash is the least of its shingle hashes
under ``BANDS`` random masks; each mask is a band of one row, so a window that
shares a share ``s`` of its shingles with a template's window meets it with
probability ``1 - (1 - s) ** BANDS`` (0.9998 at 0.75, 1 for an intact window).
A sentence of ``LONG`` shingles or more that a text holds intact has an intact
window there; shingles of shorter sentences are looked up in the text directly.
Templates met are verified by the exact share of their shingles found in the
whole text: at least ``MIN_SHARE``.

DataFrame functions only.  A text's windows never leave its row: bands are
compared with the templates' as an array of constants, and only texts with a
band or a short sentence's shingle in common go on to the join with the template table (a fixed list of
some tens of windows, broadcast).

Defined cases: null and empty texts match nothing; texts of any length are
read whole; repeated rows are reported one by one, a template named at most
once a row; templates without words match nothing; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

SHINGLE = 5
WINDOW = 12
LONG = WINDOW + WINDOW // 2 - 1    # a run of so many shingles holds a whole window of the text
BANDS = 6
MIN_SHARE = 0.75

# fixed values: notices of public licenses, name and text
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                        "or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                        "or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_RNG = random.Random(20240311)
MASKS = [_RNG.getrandbits(63) - (1 << 62) for _ in range(BANDS)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of ``k`` words."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, many).otherwise(F.array().cast("array<bigint>"))


def template_sentences(body: Column) -> Column:
    """Array of sentences, arrays of words."""
    sentences = F.split(body, r"\n\s*\n|(?<=[.;:!?])\s+")
    return F.filter(F.transform(sentences, words), lambda w: F.size(w) > 0)


def sentence_shingles(w: Column) -> Column:
    out = grams(w)
    for k in range(1, SHINGLE):
        out = F.when(F.size(w) == k, grams(w, k)).otherwise(out)
    return out


def _bands(windows: Column) -> Column:
    """All bands of an array of windows."""
    return F.flatten(F.transform(windows, lambda w: F.array(*[
        F.xxhash64(F.lit(j), F.array_min(F.transform(w, lambda x, m=m: x.bitwiseXOR(F.lit(m))))) for j, m in enumerate(MASKS)])))


def _windows(sentence: Column, step: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(sentence) - WINDOW + step, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda a: F.slice(sentence, a, WINDOW))


def text_bands(shingles: Column) -> Column:
    return _bands(F.flatten(F.transform(shingles, lambda s: _windows(s, WINDOW // 2))))


def template_table(spark, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``license, t, bands, short, sizes``: the distinct shingles, the bands of
    every window, the shingles of short sentences and the numbers of words of
    sentences without a whole shingle, of each template."""
    named = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in templates.items()])
    sh = (spark.range(1).select(F.explode(named).alias("r")).select("r.license", template_sentences(F.col("r.body")).alias("w"))
          .select("license", "w", F.transform("w", sentence_shingles).alias("sh")))
    windows = F.flatten(F.transform("sh", lambda s: _windows(s, 1)))
    return (sh.filter(F.size("sh") > 0)
            .select("license", F.array_distinct(F.flatten("sh")).alias("t"), F.array_distinct(_bands(windows)).alias("bands"),
                    F.array_distinct(F.flatten(F.filter("sh", lambda s: F.size(s) < LONG))).alias("short"),
                    F.array_distinct(F.filter(F.transform("w", F.size), lambda n: n < SHINGLE)).alias("sizes")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license, n_shared, n_template, share`` of the matches."""
    # the templates are a fixed list: a few hundred numbers become constants of the plan
    known = template_table(docs.sparkSession, templates).collect()
    longs = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<bigint>")
    every = longs(sorted({b for r in known for b in r["bands"]}))
    short = longs(sorted({b for r in known for b in r["short"]}))
    sizes = sorted({n for r in known for n in r["sizes"]})
    table = F.array(*[F.struct(F.lit(r["license"]).alias("license"), longs(r["t"]).alias("t"), longs(r["bands"]).alias("bands"),
                               longs(r["short"]).alias("short")) for r in known])
    # a list of one sequence of words: lambdas bind it, so no rule of the optimizer computes it once a word
    sh = texts(docs).filter(F.length("text") > 0).select("doc_id", F.transform(F.array(words(F.col("text"))), lambda w: F.struct(
        grams(w).alias("sh"), F.concat(*[grams(w, k) for k in (SHINGLE, *sizes)]).alias("all"))).alias("g"))
    sh = sh.select("doc_id", F.transform("g", lambda g: g["sh"]).alias("sh"), F.flatten(F.transform("g", lambda g: g["all"])).alias("all"))
    met = (sh.select("doc_id", "all", F.array_intersect(text_bands(F.col("sh")), every).alias("met"), F.array_intersect("all", short).alias("near"))
           .filter((F.size("met") > 0) | (F.size("near") > 0))
           .select("doc_id", F.array_distinct("all").alias("d"), "met", "near"))
    meets = lambda r: F.arrays_overlap(r["bands"], F.col("met")) | F.arrays_overlap(r["short"], F.col("near"))
    hit = (met.select("doc_id", "d", F.explode(F.filter(table, meets)).alias("r"))
           .select("doc_id", F.col("r.license").alias("license"), F.size("r.t").cast("long").alias("n_template"),
                   F.size(F.array_intersect("r.t", "d")).cast("long").alias("n_shared")))
    return (hit.withColumn("share", F.col("n_shared") / F.col("n_template")).filter(F.col("share") >= MIN_SHARE)
            .select("doc_id", "license", "n_shared", "n_template", "share"))

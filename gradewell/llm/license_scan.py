"""License scans in Spark expressions only.

Texts and templates become five-word shingles. Overlapping windows, twice as
long as the templates of a size class and half overlapping, hold every
occurrence of a template whole. A window's minima under BANDS hash functions,
one a band, retrieve templates by an equi-join; then the share of a
template's shingles that the window holds is counted exactly.

A class is a template's number of words up to 16, and at most an eighth more beyond. Templates of one or two
shingles are retrieved by these themselves, so none is missed. A window of twice the class that holds at least
0.8 of a template of more shingles is at least 4/15 similar to it (least at nine words: 4 of 5 shingles
in 14): no band of 64 meets with a probability of (11/15)^64, below 3e-9.
Only windows with some shingle of a template of their class are formed, since all others contain no part of one.

Edge cases: a null or empty text matches nothing; texts and templates of fewer
words than a shingle match nothing; a template that repeats another is reported
under each name; rows that repeat a doc_id are reported together; an empty table gives no rows;
columns other than the two named are ignored. Templates are a registry of bounded size: beyond
MOST_SHINGLES of them the filter is a join in place of a list in the plan, and
templates are broadcast only while their shingles, repeats included, are no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._licenses import WHOLE
from gradewell.llm._store import store, table

SHINGLE, BANDS, CONTAINED = 5, 64, 0.8
EXACT = SHINGLE + 1  # words of the largest class whose shingles are the keys
MOST_SHINGLES = 20_000

#: Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License. See the LICENSE file.",
    "mit-short": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Notices and whole texts.
ALL = TEMPLATES | WHOLE

#: ASCII signs part words, capitals A to Z are lowered.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "".join(chr(i) for i in [*range(1, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def shingled(df: DataFrame, text: str) -> DataFrame:
    """df and _shingles: hashes of five consecutive words."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _SIGNS, _UPPER.lower() + " " * len(_SIGNS))
    out = df.withColumn("_words", F.filter(F.split(plain, " ", -1), lambda w: w != ""))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get("_hashes", i + j)
    n = F.size("_hashes")
    shingles = F.when(
        n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, j) for j in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("_shingles", shingles).drop("_words", "_hashes")


def _keys(shingles: Column, size: Column) -> Column:
    """What windows and templates of a class meet by: the shingles themselves (band 0) up to EXACT words, else minima by band."""
    minima = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))).alias("least")))
    return F.when(size <= EXACT, F.transform(shingles, lambda h: F.struct(F.lit(0).alias("band"), h.alias("least")))).otherwise(minima)


def _once(column: str) -> Column:
    """A column beside a row number that is asked for: a filter that is inferred from it stays above, so it is computed once."""
    return F.when(F.col("_row") >= 0, F.col(column))


def registry_of(notices: DataFrame, license_id: str = "license_id", notice: str = "notice") -> DataFrame:
    """license_id, shingles (distinct), class of a table of templates of any length: its words, beyond 16 rounded up to an eighth of the power of two below.

    Templates of fewer words than a shingle match nothing and are left out; of texts under one name each is a template.
    """
    out = shingled(notices.select(F.col(f"`{license_id}`").alias("license_id"), F.col(f"`{notice}`").alias("notice")), "notice").where(F.size("_shingles") > 0)
    words = F.size("_shingles") + SHINGLE - 1
    step = F.pow(F.lit(2), F.greatest(F.floor(F.log2(words - 1)) - 3, F.lit(0)))
    size = (F.ceil(words / step) * step).cast("int")
    return store(out.select("license_id", F.array_distinct("_shingles").alias("shingles"), size.alias("class")), "licenses")


def registry(spark: SparkSession, templates: dict[str, str] = ALL) -> DataFrame:
    """registry_of() a list that the caller holds."""
    return registry_of(spark.createDataFrame(list(templates.items()), "license_id string, notice string"))


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """doc_id, license_id, containment (the most of a window), n_windows, first_word (of the first such window)."""
    known = templates.select(F.explode("shingles").alias("h"), "class").distinct()
    total = templates.agg(F.sum(F.size("shingles"))).first()[0] or 0
    # a template has a shingle at least, so this bounds the templates and their bands too
    near = F.broadcast if total <= MOST_SHINGLES else lambda df: df
    listed = known.limit(MOST_SHINGLES + 1).collect()
    base = shingled(docs.select(doc_id, text), text).drop(text)
    if len(listed) <= MOST_SHINGLES:
        of_class: dict[int, list[int]] = {}
        for r in listed:
            of_class.setdefault(r["class"], []).append(r["h"])
        some = sorted({r["h"] for r in listed})
        places = F.filter(F.transform("_shingles", lambda h, i: F.when(h.isin(some), i)), lambda i: i.isNotNull()) if some else F.array().cast("array<int>")
        # beside a row number, which is not deterministic, the list is computed once: filters do not repeat it below
        placed = base.select("*", places.alias("_places"), F.monotonically_increasing_id().alias("_row")).where((F.size("_places") > 0) & (F.col("_row") >= 0)).drop("_row")
        own = lambda c: F.transform(F.filter("_places", lambda i: F.get("_shingles", i).isin(of_class[c])), lambda i: F.struct(F.lit(c).alias("class"), i.alias("i")))
        hits = F.flatten(F.array(*map(own, sorted(of_class)))) if of_class else F.array().cast("array<struct<class:int,i:int>>")
        held = placed.select("*", hits.alias("_hits")).drop("_places")
    else:
        keyed = base.withColumn("_row", F.monotonically_increasing_id())
        hits = keyed.select("_row", F.posexplode("_shingles").alias("i", "h")).join(known, "h").groupBy("_row").agg(F.collect_list(F.struct("class", "i")).alias("_hits"))
        held = keyed.join(hits, "_row").drop("_row")

    # window k of a class c has the words from k * c on, twice c of them
    def numbers(x: Column) -> Column:
        k = F.floor(x["i"] / x["class"])
        return F.array(*[F.struct(x["class"].alias("class"), n.alias("k")) for n in (F.greatest(F.lit(0).cast("long"), k - 1), k)])

    def window(w: Column) -> Column:
        first = w["k"] * w["class"]
        own = F.array_distinct(F.slice("_shingles", (first + 1).cast("int"), w["class"] * 2 - SHINGLE + 1))
        return F.struct(w["class"].alias("class"), first.alias("first_word"), own.alias("own"))

    windows = F.transform(F.array_distinct(F.flatten(F.transform("_hits", numbers))), window)
    listed_windows = held.select(doc_id, windows.alias("_windows"), F.monotonically_increasing_id().alias("_row"))
    opened = listed_windows.select(doc_id, F.explode(_once("_windows")).alias("w")).select(doc_id, "w.class", "w.first_word", "w.own")
    least = opened.select("*", _keys(F.col("own"), F.col("class")).alias("minima"), F.monotonically_increasing_id().alias("_row"))
    banded = least.select(doc_id, "class", "first_word", "own", F.explode(_once("minima")).alias("m")).select(doc_id, "class", "first_word", "own", "m.band", "m.least")
    keys = templates.select("license_id", "class", F.explode(_keys(F.col("shingles"), F.col("class"))).alias("m")).select("license_id", "class", "m.band", "m.least")
    found = banded.join(near(keys), ["class", "band", "least"]).groupBy(doc_id, "class", "first_word", "license_id").agg(F.any_value("own").alias("own"))
    common = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    checked = found.join(near(templates.select("license_id", "shingles")), "license_id").withColumn("containment", common).where(F.col("containment") >= contained)
    return checked.groupBy(doc_id, "license_id").agg(
        F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").alias("first_word")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), registry(spark))

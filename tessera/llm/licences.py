"""License scans with DataFrame functions only: MinHash bands over overlapping windows.

Words are runs of letters and digits, in lower case; a shingle is ``SHINGLE`` words. A
template of L words belongs to the tier of the least power of two >= max(L, 8). Texts are
read in windows of twice the tier, half overlapping, so every occurrence of a template lies
wholly in some window, and its shingles make up over a fifth of that window's. ``BANDS``
bands of one minimum each then agree at least once with a probability over
1 - (1 - 3 / 14) ** 32 = 0.9995. A window whose minimum equals a template's holds that very
shingle; so windows without any shingle of the templates can't collide, and are passed over
before any minimum is taken. Retrieved pairs are verified exactly: the share of the
template's shingles that the window holds must reach ``CONTAINMENT``.

The templates are a parameter. They are few; their band table is broadcast only if
``MOST_BROADCAST`` rows bound it, and joined by shuffle beyond that.

Defined cases: null, empty and short texts have no windows and give no rows; a template
with fewer words than a shingle never matches; rows that repeat an id are scanned
together; of several matching windows the best (then the first) is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise

SHINGLE, BANDS, CONTAINMENT, SMALLEST = 3, 32, 0.8, 8
MOST_BROADCAST = 100_000
#: fixed values: short notices as their licences word them
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the shingles at each word; the last ones, which are cut short, are null."""
    n = F.size(words)
    return F.transform(words, lambda w, i: F.when(i <= n - SHINGLE, F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE)))))


def _minima(hashes: Column) -> Column:
    """One minimum for each band: hashing again with the band makes an order that is independent of the others'."""
    again = lambda b: lambda h: F.xxhash64(h, F.lit(b))
    return F.array(*(F.array_min(F.transform(hashes, again(b))) for b in range(BANDS)))


def _table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, list[int]]:
    rows = spark.createDataFrame(list(templates), "template string, notice string")
    rows = rows.withColumn("w_", _words(F.col("notice"))).withColumn("t_", F.array_distinct(F.filter(_shingles(F.col("w_")), lambda h: h.isNotNull())))
    rows = rows.where(F.size("t_") > 0).withColumn("tier", F.greatest(F.lit(SMALLEST), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("w_")))).cast("int")))
    known = rows.select("template", "tier", "t_").collect()  # the parameter, hashed
    table = spark.createDataFrame([(r.template, r.tier, r.t_) for r in known], "template string, tier int, t_ array<long>") if known else rows.select("template", "tier", "t_")
    return table, sorted({h for r in known for h in r.t_})


def scan_licences(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(``id_col``, template, containment, first_word): the licences that a text carries; first_word is the start of the best window."""
    table, known = _table(spark, templates)
    tiers = sorted({r.tier for r in table.select("tier").distinct().collect()})
    if not tiers:
        return docs.select(F.col(id_col).cast("long").alias(id_col)).where("false").select(id_col, F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"))
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), _words(F.col(text_col)).alias("w_")).select("id", _shingles(F.col("w_")).alias("h_"))
    hits = F.filter(F.transform("h_", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
    found = hashed.withColumn("hits_", hits)
    place = lambda t, back: lambda i: F.struct(F.lit(t).alias("tier"), (F.floor(i / F.lit(t)) - back).cast("int").alias("k"))
    at = [F.transform("hits_", place(t, back)) for t in tiers for back in (0, 1)]
    # an outer generator: of an inner one Spark infers a filter, and would push it, with all it is made of, into the scan
    windows = found.select("id", "h_", F.explode_outer(F.array_distinct(F.concat(*at))).alias("at_")).select("id", "h_", F.col("at_.tier").alias("tier"), F.col("at_.k").alias("k_")).where("k_ >= 0")
    own = F.expr(f"array_distinct(filter(slice(h_, k_ * tier + 1, 2 * tier - {SHINGLE - 1}), h -> h is not null))")
    windows = windows.select("id", "tier", (F.col("k_") * F.col("tier")).cast("int").alias("first_word"), own.alias("s_"))
    windows = materialise(spark, windows, "windows")
    bands = windows.select("*", F.posexplode(_minima(F.col("s_"))).alias("band", "low"))
    asked = table.select("template", "tier", "t_", F.posexplode(_minima(F.col("t_"))).alias("band", "low"))
    pairs = bands.join(F.broadcast(asked) if len(templates) * BANDS <= MOST_BROADCAST else asked, ["tier", "band", "low"])
    share = F.size(F.array_intersect("t_", "s_")) / F.size("t_")
    checked = pairs.select("id", "template", "first_word", share.alias("containment")).where(F.col("containment") >= containment)
    top = F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("top_")
    return checked.groupBy("id", "template").agg(top).select(F.col("id").alias(id_col), "template", F.col("top_.containment").alias("containment"), (-F.col("top_.back")).alias("first_word"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of each document that has any."""
    return scan_licences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    quoted = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in templates)
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t0(template, notice) AS (VALUES {quoted}),
t1 AS (SELECT template, {words.format("notice")} AS w FROM t0),
t2 AS (SELECT template, greatest({SMALLEST}, pow(2, ceil(log2(len(w))))::INT) AS tier, list_distinct([w[i:i+2]::VARCHAR FOR i IN range(1, len(w) - 1)]) AS t FROM t1 WHERE len(w) >= {SHINGLE}),
tt AS (SELECT template, tier, len(t) AS size, unnest(t) AS s FROM t2),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, i, w[i+1:i+3]::VARCHAR AS s FROM d, unnest(range(0, len(w) - 2)) u(i)),
h AS (SELECT doc_id, i, template, tier, size, s FROM p JOIN tt USING (s)),
k AS (SELECT doc_id, template, tier, size, s, (i // tier - x) * tier AS first_word, i FROM h, (VALUES (0), (1)) v(x)),
c AS (SELECT doc_id, template, first_word, count(DISTINCT s)::DOUBLE / any_value(size) AS containment FROM k
  WHERE first_word >= 0 AND i >= first_word AND i < first_word + 2 * tier - 2 GROUP BY ALL)
SELECT doc_id, template, max(containment) AS containment, arg_max(first_word, (containment, -first_word))::INTEGER AS first_word FROM c WHERE containment >= {CONTAINMENT} GROUP BY ALL
"""


OP3_SQL = _sql()

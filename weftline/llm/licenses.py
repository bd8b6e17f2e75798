"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Templates are short license notices. Words are runs of lower-case letters and digits; a shingle is five words; a text with
fewer words has none. Templates are put into classes by their number of shingles, and texts into windows by class: a class
for templates of up to T shingles has windows of ``length`` shingles that start every ``step``, where step <= length - T + 1,
so that any stretch of T shingles lies whole in a window. Classes double up to any length, so whole license texts can be given.

1. A window is looked at if it holds a shingle of some template (a window without has containment 0).
2. Each of ``bands`` MinHash values of a window is a band of one row. A template that shares a band is retrieved. A window
   that holds a template whole is to three eighths made of it, so it is retrieved with probability 1 - (5/8)^bands, above
   0.9999 by default; one that holds the least accepted share of it, ``containment``, with at least 0.999.
3. The share of the template's shingles that the window holds is computed exactly, and kept if at least ``containment``.

The result has a row for each document and license: the best containment and the number of windows that reached the
threshold. Rows are exploded only for windows with a template's shingle. Templates are a fixed table or a DataFrame of any size:
their bands are broadcast in parts of at most ``part_shingles`` shingles, one pass over the documents each; what is shuffled are
windows that hold a template.

Edge cases: NULL and empty texts and texts under five words hold nothing; templates under five words are passed over;
repeated rows of a document count as one document with all their windows; rows with a NULL id are reported under NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import read

#: License notices as they stand in files (license, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: Classes of templates: most shingles of a template, shingles of a window, step between windows.
CLASSES = [(1, 1, 1), (3, 4, 2), (6, 8, 3), (12, 16, 5), (24, 32, 9), (48, 64, 17), (96, 128, 33)]
#: The same doubled on, for texts that a caller gives: longer than any array of words.
LONG_CLASSES = [*CLASSES, *((96 << i, 128 << i, (32 << i) + 1) for i in range(1, 24))]


@dataclass(frozen=True)
class Settings:
    words: int = 5
    bands: int = 24
    containment: float = 0.8
    part_shingles: int = 50_000


def fixed(column: Column) -> Column:
    """The column as a generator of one row: the optimizer doesn't copy it into the expressions that use it."""
    return F.explode(F.array(column))


def words_of(text: Column) -> Column:
    """Array of the lower-case words of a text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column, n: int, gram: str = "hash") -> Column:
    """Array of the n-word shingles: their 64-bit hashes, or the texts with ``gram='text'``."""
    one = (lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])) if gram == "hash" else (lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), one)).otherwise(F.array())


def minhashes(shingles: Column, bands: int) -> Column:
    """Array of structs (band, value): the least hash under each of ``bands`` seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))).alias("value")))


def windows_over(hits: Column, length: int, step: int) -> Column:
    """Array of structs (length, at): the windows of a class that hold one of the shingles at ``hits``."""

    def first(x: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((x - F.lit(length - 1)) / F.lit(float(step))).cast("int"))

    covering = F.transform(hits, lambda x: F.sequence(first(x), F.greatest(first(x), F.floor(x / F.lit(float(step))).cast("int"))))
    return F.transform(F.array_distinct(F.flatten(covering)), lambda k: F.struct(F.lit(length).alias("length"), (k * F.lit(step)).alias("at")))


def template_table(templates: DataFrame, s: Settings) -> DataFrame:
    """``templates (license, notice)`` with their shingles, and the class of each: (t_id, license, grams, hashes, length, step)."""
    t = templates.select("license", "notice").distinct().withColumn("w", words_of(F.col("notice"))).where(F.size("w") >= s.words)
    t = t.withColumn("grams", F.array_distinct(shingles_of(F.col("w"), s.words, "text"))).withColumn("hashes", F.array_distinct(shingles_of(F.col("w"), s.words)))
    n, length, step = F.size("w") - s.words + 1, F.lit(None).cast("int"), F.lit(None).cast("int")
    for most, long, every in reversed(LONG_CLASSES):
        length, step = F.when(n <= most, long).otherwise(length), F.when(n <= most, every).otherwise(step)
    return t.select(F.xxhash64("license", "notice").alias("t_id"), "license", "grams", "hashes", length.alias("length"), step.alias("step"))


def template_parts(table: DataFrame, s: Settings) -> list[list[Row]]:
    """The templates in lists of at most ``part_shingles`` shingles each (or of one template)."""
    out: list[list[Row]] = [[]]
    room = s.part_shingles
    for r in table.orderBy("t_id").toLocalIterator():
        if r["length"] is None:
            raise ValueError("a template is longer than the longest class")
        if len(r["hashes"]) > room and out[-1]:
            out.append([])
            room = s.part_shingles
        out[-1].append(r)
        room -= len(r["hashes"])
    return [x for x in out if x]


def scan(docs: DataFrame, templates: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, license, containment, n_windows)`` for ``docs (doc_id, text)``; any number of templates, one pass a part of them."""
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, notice string")
    table = template_table(templates, s)
    windows = None
    for rows in template_parts(table, s):
        part = scan_part(docs, spark.createDataFrame(rows, table.schema), rows, s)
        windows = part if windows is None else windows.union(part)
    if windows is None:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long")
    return windows.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.count("*").alias("n_windows"))


def scan_part(docs: DataFrame, known: DataFrame, rows: list[Row], s: Settings) -> DataFrame:
    """``(doc_id, license, t_id, at, length, c)``: the windows of documents that hold one of some templates."""
    wanted = sorted({h for r in rows for h in r["hashes"]})
    classes = sorted({(r["length"], r["step"]) for r in rows})
    # each expression over a whole text is fixed in a generated column, so that it is computed once and not where it is used
    d = docs.select("doc_id", fixed(words_of(F.col("text"))).alias("w")).where(F.size("w") >= s.words)
    d = d.select("doc_id", "w", fixed(shingles_of(F.col("w"), s.words)).alias("h"))
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", "w", "h", fixed(hits).alias("hits")).where(F.size("hits") > 0)
    each = [windows_over(F.col("hits"), length, step) for length, step in classes]
    d = d.select("doc_id", "w", "h", F.explode(F.concat(*each)).alias("x"))
    d = d.select("doc_id", F.col("x.length").alias("length"), F.col("x.at").alias("at"), F.slice("h", F.col("x.at") + 1, F.col("x.length")).alias("h"), F.slice("w", F.col("x.at") + 1, F.col("x.length") + F.lit(s.words - 1)).alias("w"))
    d = d.select("doc_id", "length", "at", "w", F.explode(minhashes(F.col("h"), s.bands)).alias("m"))
    keys = known.select("t_id", "length", F.explode(minhashes(F.col("hashes"), s.bands)).alias("m"))
    keys = keys.select("t_id", "length", F.col("m.band").alias("band"), F.col("m.value").alias("value"))
    d = d.select("doc_id", "length", "at", "w", F.col("m.band").alias("band"), F.col("m.value").alias("value"))
    # a pair that shares several bands is verified for each and counted once, below
    found = d.join(F.broadcast(keys), ["length", "band", "value"]).join(F.broadcast(known.select("t_id", "license", "grams")), "t_id")
    found = found.withColumn("c", F.size(F.array_intersect("grams", shingles_of(F.col("w"), s.words, "text"))) / F.size("grams")).where(F.col("c") >= s.containment)
    return found.groupBy("doc_id", "license", "t_id", "at", "length").agg(F.max("c").alias("c"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses whose notices documents hold."""
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle(s: Settings = Settings()) -> str:
    """The same windows and exact containments by SQL over all positions, without hashing."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    classes = ", ".join(map(str, CLASSES))
    n = s.words
    return f"""
WITH t0(license, notice) AS (VALUES {values}), c(most, len, step) AS (VALUES {classes}),
t1 AS (SELECT license, notice, list_filter(regexp_split_to_array(lower(notice), '[^a-z0-9]+'), lambda x: x <> '') w FROM t0),
t AS (SELECT license, notice, list_distinct(list_transform(range(0, len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' '))) grams,
      len(w) - {n - 1} n FROM t1 WHERE len(w) >= {n}),
t2 AS (SELECT t.license, notice, grams, c.len, c.step FROM t JOIN c ON n <= most QUALIFY row_number() OVER (PARTITION BY license, notice ORDER BY most) = 1),
g AS (SELECT DISTINCT license, notice, len, step, len(grams) n, unnest(grams) gram FROM t2),
d AS (SELECT row_number() OVER () r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i + 1:i + {n}], ' ') gram FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - {n - 1})) i FROM d WHERE len(w) >= {n})),
hit AS (SELECT s.r, s.doc_id, s.i, g.* FROM s JOIN g USING (gram)),
win AS (SELECT *, unnest(range(greatest(0, CAST(ceil((i - len + 1) / step) AS BIGINT)), i // step + 1)) k FROM hit),
ok AS (SELECT doc_id, license, notice, k, count(DISTINCT gram) / any_value(n) c FROM (SELECT doc_id, license, notice, k, gram, n, r FROM win) GROUP BY doc_id, license, notice, k, r)
SELECT doc_id, license, max(c) containment, count(DISTINCT notice || '#' || k) n_windows FROM ok WHERE c >= {s.containment} GROUP BY doc_id, license"""


ORACLE = _oracle()

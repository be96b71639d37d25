"""License scans [native]: TF-IDF cosines of notices and licence files to templates, then inheritance from directories.

Units are the notice lines of every file (lines with a cue) and the whole texts of licence files, by their names. They are found in
one pass over the texts and written. Equal units are one
row with a number from the first shuffle on, so that a notice which a third of all files carry is compared once. Terms,
document frequencies and dot products are grouped sums. Templates are a short list of notices, and for licence files whole licences too.
A file without a notice of its own inherits from its nearest ancestor directory with a licence: distinct directories are
exploded into their ancestors and joined by path. Where rows meet their unit or directory, both are dealt into parts.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import NOT_WORD, SALTS, stored

#: Names and usual notices of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
CUES = r"licen[cs]e|copyright|spdx|permission is hereby|redistribut|all rights reserved|public domain"
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
#: Least cosine of a match with a notice and with a whole licence; a file of whose words a notice has this share is a licence file too.
COSINE, TEXT_COSINE, FILE_SHARE = 0.75, 0.85, 0.3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), "")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """Names and whole texts of public licences: license_texts/README.md tells where they are from."""
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _units(files: DataFrame) -> DataFrame:
    """doc_id, path, n (words of the file), named (a licence file), unit, size (words of the unit) and key, its digest."""
    named = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1).rlike(LICENSE_NAMES)
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, _UPPER, _LOWER).rlike(CUES))
    # most texts have no cue at all: one search over the whole text comes before any line is looked at
    cued = F.translate("_t", _UPPER, _LOWER).rlike(CUES)
    units = F.when(F.col("named"), F.array("_t")).when(cued, lines).otherwise(F.array().cast("array<string>"))
    words = lambda c: F.size(F.array_remove(F.split(c, NOT_WORD), ""))
    base = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("_t"), named.alias("named")).select("doc_id", "path", "named", units.alias("units"), "_t")
    held = base.where(F.size("units") > 0).select("doc_id", "path", "named", words("_t").alias("n"), F.explode("units").alias("unit"))
    return held.select("*", words("unit").alias("size"), F.md5("unit").alias("key"), _part("doc_id", "path").alias("part"))


def scan_licenses(
    files: DataFrame, templates=TEMPLATES, texts: tuple[tuple[str, str], ...] | None = None, cosine: float = COSINE, text_cosine: float = TEXT_COSINE, file_share: float = FILE_SHARE
) -> DataFrame:
    """One row per row of `files` (doc_id, path, text): own_license and score (of its best notice), license and inherited_from.

    Null and empty texts have no notice and may inherit; a null path has no directory and inherits nothing. Ties: the higher score,
    then the name that sorts first; of a directory's licence files the licence that most have, then the name. Repeated rows are judged alike,
    rows of one doc_id and path by the notices of all of them; texts of any length are read as a whole; other columns are ignored; an
    empty table gives an empty one.
    """
    spark = files.sparkSession
    found = stored(_units(files), "units")
    # a unit's rows are counted by parts first, and it comes back to each part that has some
    distinct = found.groupBy("key", "named", "part").agg(F.any_value("unit").alias("unit"), F.count("*").alias("times"))
    distinct = distinct.groupBy("key", "named").agg(F.any_value("unit").alias("unit"), F.sum("times").alias("times"), F.collect_set("part").alias("parts"))
    distinct = stored(distinct, "distinct")
    frequency = lambda c: 1 + F.log(c)
    terms = distinct.select("key", "named", "times", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "named", "times", "term").agg(frequency(F.count("*")).alias("tf"))
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("total"))
    listed = [(name, body, False) for name, body in templates] + [(name, body, True) for name, body in (whole_texts() if texts is None else texts)]
    wanted = spark.createDataFrame([(k, *row) for k, row in enumerate(listed)], "t int, name string, body string, whole boolean")
    wanted = wanted.select("t", "name", "whole", F.explode(_terms(F.col("body"))).alias("term")).groupBy("t", "name", "whole", "term").agg(frequency(F.count("*")).alias("ttf"))
    df = terms.groupBy("term").agg(F.sum("times").alias("df"))
    idf = lambda d: F.log((1 + F.col("total")) / (1 + F.coalesce(d, F.lit(0)))) + 1
    one = F.broadcast(total)  # one row
    weighted = wanted.join(df, "term", "left").crossJoin(one).select("t", "name", "whole", "term", (F.col("ttf") * idf(F.col("df"))).alias("tw"))
    lengths = weighted.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    query_terms = terms.join(df, "term").crossJoin(one).select("key", "named", "term", (F.col("tf") * idf(F.col("df"))).alias("w"))
    norms = query_terms.groupBy("key", "named").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    # the templates are as many as the caller gives; whole licences are for licence files alone
    dots = query_terms.join(F.broadcast(weighted), "term").where("named OR NOT whole").groupBy("key", "named", "t", "name", "whole").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("n") * F.col("tn")), 6)
    scored = dots.join(norms, ["key", "named"]).join(F.broadcast(lengths), "t").select("key", "named", "name", "whole", score.alias("score"))
    best = scored.where(F.col("score") >= F.when(F.col("whole"), text_cosine).otherwise(cosine)).groupBy("key", "named").agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("best"))
    best = best.join(distinct.select("key", "named", "parts"), ["key", "named"]).select("key", "named", "best", F.explode("parts").alias("part"))
    own = found.join(best, ["key", "named", "part"]).groupBy("doc_id", "path").agg(
        F.min("best").alias("best"), F.max(F.col("named") | (F.col("size") >= file_share * F.col("n"))).alias("declares")
    )
    own = stored(own, "own")
    directory = own.where(F.col("declares") & F.col("path").isNotNull()).groupBy(_directory(F.col("path")).alias("dir"), F.col("best.name").alias("name")).count()
    licensed = directory.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("minus"), "name")).alias("l")).select(F.col("dir").alias("up"), F.col("l.name").alias("name"))
    rows = files.select("doc_id", "path", _directory(F.col("path")).alias("dir"), _part("doc_id", "path").alias("part"))
    folders = rows.where("path IS NOT NULL").select("dir", "part").distinct().groupBy("dir").agg(F.collect_set("part").alias("parts"))
    names = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    near = (
        folders.select("dir", "parts", F.explode(F.array_distinct(ups)).alias("up"))
        .join(licensed, "up")
        .groupBy("dir")
        .agg(F.max_by(F.struct("up", "name"), F.length("up")).alias("near"), F.any_value("parts").alias("parts"))
        .select("dir", "near", F.explode("parts").alias("part"))
    )
    mine = own.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), "best")
    out = rows.join(mine, rows["doc_id"].eqNullSafe(mine["_d"]) & rows["path"].eqNullSafe(mine["_p"]), "left").join(near, ["dir", "part"], "left")
    return out.select(
        "doc_id",
        "path",
        F.col("best.name").alias("own_license"),
        (-F.col("best.minus")).alias("score"),
        F.coalesce("best.name", "near.name").alias("license"),
        F.when(F.col("best").isNull(), F.col("near.up")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source, language and id make the path."""
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    """The table's paths name no licence files, so the whole licences have no part in it."""
    quoted = ", ".join("({}, '{}', '{}')".format(k, n, b.replace("'", "''")) for k, (n, b) in enumerate(TEMPLATES))
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') path, coalesce(text, '') t FROM documents),
tp(t, name, body) AS (VALUES {quoted}),
l AS (SELECT doc_id, path, len(regexp_extract_all(t, '{word}')) n, unnest(string_split(t, chr(10))) unit FROM f),
u AS (SELECT * FROM l WHERE regexp_matches({low.format("unit")}, '{CUES}')),
d AS (SELECT unit, count(*) times FROM u GROUP BY unit),
q0 AS (SELECT unit, times, unnest(regexp_extract_all({low.format("unit")}, '[a-z0-9]+')) term FROM d),
q AS (SELECT unit, times, term, 1 + ln(count(*)) tf FROM q0 GROUP BY ALL),
w0 AS (SELECT t, name, unnest(regexp_extract_all({low.format("body")}, '[a-z0-9]+')) term FROM tp),
w AS (SELECT t, name, term, 1 + ln(count(*)) ttf FROM w0 GROUP BY ALL),
df AS (SELECT term, sum(times) df FROM q GROUP BY term),
n AS (SELECT coalesce(sum(times), 0) total FROM d),
tw AS (SELECT t, name, term, ttf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) tw FROM w LEFT JOIN df USING (term), n),
tn AS (SELECT t, sqrt(sum(tw * tw)) tn FROM tw GROUP BY t),
qw AS (SELECT unit, term, tf * (ln((1 + total) / (1 + df)) + 1) w FROM q JOIN df USING (term), n),
qn AS (SELECT unit, sqrt(sum(w * w)) qn FROM qw GROUP BY unit),
dots AS (SELECT unit, t, name, sum(w * tw) dot FROM qw JOIN tw USING (term) GROUP BY ALL),
s AS (SELECT unit, name, round(dot / (qn * tn), 6) score FROM dots JOIN qn USING (unit) JOIN tn USING (t)),
b AS (SELECT unit, min({{'minus': -score, 'name': name}}) best FROM s WHERE score >= {COSINE} GROUP BY unit),
o AS (SELECT doc_id, path, min(best) best, max(len(regexp_extract_all(unit, '{word}')) >= {FILE_SHARE} * n) declares FROM u JOIN b USING (unit) GROUP BY ALL),
g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) dir, best.name name, count(*) c FROM o WHERE declares GROUP BY ALL),
lic AS (SELECT dir up, (min({{'minus': -c, 'name': name}})).name name FROM g GROUP BY dir),
r AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) dir FROM f),
near AS (SELECT dir, arg_max(up, length(up)) up, arg_max(name, length(up)) name
  FROM (SELECT DISTINCT dir FROM r) JOIN lic ON dir = up OR starts_with(dir, up || '/') OR up = '' GROUP BY dir)
SELECT doc_id, path, best.name own_license, -best.minus score, coalesce(best.name, near.name) license,
  CASE WHEN best IS NULL THEN near.up END inherited_from
FROM r LEFT JOIN o USING (doc_id, path) LEFT JOIN near USING (dir)"""


ORACLE = _oracle()

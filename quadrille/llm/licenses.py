"""Licence scans: normalised text against templates by the Dice coefficient over word bigrams.

A text's units are its lines and, if it has several, the whole of it. A unit is lower-cased, what is neither
letter nor digit becomes a space, and its distinct word bigrams are compared with each template's. With
threshold t, a template of B bigrams can only match units of t/(2-t) B to (2-t)/t B bigrams, which prunes
the candidates before bigrams are compared. It must also share t/(2-t) B of them, so it holds one of a few words
that most of the template's bigrams have (`keys`); texts and units without any are passed over before they are
normalised, and lose no match. DataFrame functions only, row by row: nothing is shuffled but the matches.

Null or empty text matches nothing. Of the templates that match a unit the best counts, ties going to the
first name. Repeated rows of one id count their lines together. Rows without an id keep null as id. Column
names of the input other than the text and id don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Notices by which works name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
#: Words that texts of any kind hold.
FUNCTION_WORDS = frozenset("a and are any by for has in is of or that the this to under with without".split())


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def keys(sets: list[list[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every match holds one. A match shares at least t/(2-t) B of a template's B bigrams, so once
    fewer of them lack all chosen words, it must share one that has such a word. Long words, being rare, first;
    function words last."""
    chosen: list[str] = []
    for held in sets:
        need = math.ceil(threshold / (2 - threshold) * len(held) - 1e-9)
        for word in sorted({w for b in held for w in b.split()}, key=lambda w: (w in FUNCTION_WORDS, -len(w), w)):
            if sum(not set(b.split()) & set(chosen) for b in held) < need:
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (the best), n_units (units that match it), first_line (0-based; null: only the
    whole text matches)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = {name: b for name, t in sorted(templates.items()) if (b := bigrams(t))}
    if not sets:
        return docs.select(F.col(doc_id).alias("doc_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("license", "string"), ("dice", "double"), ("n_units", "long"), ("first_line", "long"))]).limit(0)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    largest, least = max(map(len, sets.values())), min(map(len, sets.values()))
    key = "(?:" + "|".join(keys(list(sets.values()), threshold)) + r")(?![\p{L}\p{N}])"
    # A matching unit holds a key word, and so does its text.
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.lower("text").rlike(key))
    cleaned = held.select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ").alias("cleaned"))
    lines = F.split("cleaned", "\n")
    units = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.translate("cleaned", "\n", " ").alias("unit")))
    every = F.filter(F.when(F.size(lines) > 1, F.concat(units, whole)).otherwise(units), lambda u: u["unit"].rlike(key))
    # One transform after the other, so that each value is computed once and used by name.
    worded = F.transform(every, lambda u: F.struct(u["line"].alias("line"), F.split(F.trim(F.regexp_replace(u["unit"], " +", " ")), " ").alias("words")))
    worded = F.filter(worded, lambda u: F.size(u["words"]) - 1 >= low * least - 1e-9)

    def paired(u: Column) -> Column:
        n = F.size(u["words"])
        pairs = F.zip_with(F.slice(u["words"], 1, n - 1), F.slice(u["words"], 2, n), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(u["line"].alias("line"), F.array_distinct(pairs).alias("pairs"))

    sized = cleaned.select("doc_id", F.inline(F.transform(worded, paired))).withColumn("n", F.size("pairs"))
    sized = sized.filter((F.col("n") <= high * largest + 1e-9) & (F.col("n") >= low * least - 1e-9))
    scores = []
    for name, b in sets.items():
        fits = (F.col("n") <= high * len(b) + 1e-9) & (F.col("n") >= low * len(b) - 1e-9)
        shared = F.size(F.array_intersect("pairs", F.array(*map(F.lit, b))))
        scores.append(F.when(fits, F.struct((2.0 * shared / (F.col("n") + len(b))).alias("dice"), F.lit(name).alias("license"))))
    best = F.aggregate(F.array(*scores), F.lit(None).cast("struct<dice:double,license:string>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    matched = sized.select("doc_id", "line", best.alias("best")).filter(F.col("best.dice") >= threshold)
    return matched.groupBy("doc_id", F.col("best.license").alias("license")).agg(
        F.max("best.dice").alias("dice"), F.count("*").alias("n_units"), F.min("line").cast("long").alias("first_line")
    )


def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """df's columns `keep` and the columns made, which come from a generator: a filter above it isn't pushed below, so it
    can't have them computed again for each place where it names them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def window_matches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, line of the runs of words, across line ends, that are as long as a template and match it. Of
    runs that overlap the best counts, ties going to the first name. A run shares t/(2-t) B bigrams, so its text does."""
    sets = {name: b for name, t in sorted(templates.items()) if (b := bigrams(t))}
    if not sets:
        return docs.select(F.col(doc_id).alias("doc_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("license", "string"), ("dice", "double"), ("line", "long"))]).limit(0)
    needs = {name: math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) for name, b in sets.items()}
    lengths = {name: len(re.sub(r"[\W_]+", " ", templates[name].lower()).split()) for name in sets}
    literal = {name: F.array(*map(F.lit, b)) for name, b in sets.items()}
    every = F.array(*map(F.lit, dict.fromkeys(b for held in sets.values() for b in held)))
    key = "(?:" + "|".join(keys(list(sets.values()), threshold)) + r")(?![\p{L}\p{N}])"
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.lower("text").rlike(key))

    def joined(words: Column) -> Column:
        n = F.size(words)
        return F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    own = once(held, ["doc_id"], cleaned=F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " "))
    own = once(own, ["doc_id", "cleaned"], whole=F.split(F.trim(F.regexp_replace("cleaned", "[ \n]+", " ")), " "))
    own = once(own, ["doc_id", "cleaned"], shared=F.array_intersect(joined(F.col("whole")), every)).filter(F.size("shared") >= min(needs.values()))
    enough = [F.when(F.size(F.array_intersect("shared", literal[name])) >= needs[name], F.lit(name)) for name in sets]
    left = once(own, ["doc_id", "cleaned"], may=F.array_compact(F.array(*enough))).filter(F.size("may") > 0)
    placed = F.flatten(F.transform(F.split("cleaned", "\n"), lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word")))))
    left = once(left, ["doc_id", "may"], placed=placed)
    left = once(left, ["doc_id", "may", "placed"], words=F.col("placed.word"))
    left = once(left, ["doc_id", "may", "placed"], pairs=joined(F.col("words")))
    runs = []
    for name, b in sets.items():
        size = lengths[name]

        def scored(start: Column) -> Column:
            # One transform in the other, so that the run's bigrams are made once.
            own = F.array_distinct(F.slice("pairs", start + 1, size - 1))
            dice = F.transform(F.array(own), lambda p: 2.0 * F.size(F.array_intersect(p, literal[name])) / (F.size(p) + len(b)))[0]
            return F.struct((-dice).alias("minus"), F.lit(name).alias("license"), start.alias("start"), (start + size).alias("end"))

        hits = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(literal[name], p), i)), lambda i: i.isNotNull())
        # Lambdas are called at once, with this template.
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(i - (size - 2), F.lit(0)), i))))
        good = F.filter(F.transform(starts, scored), lambda r: r["minus"] <= -threshold)
        runs.append(F.when(F.array_contains("may", name), good).otherwise(F.slice(good, 1, 0)))
    best = once(left, ["doc_id", "placed"], runs=F.array_sort(F.concat(*runs))).filter(F.size("runs") > 0)
    taken = F.aggregate("runs", F.slice("runs", 1, 0), lambda got, r: F.when(F.exists(got, lambda g: (g["start"] < r["end"]) & (r["start"] < g["end"])), got).otherwise(F.concat(got, F.array(r))))
    out = best.select("doc_id", "placed", F.explode(taken).alias("r"))
    return out.select("doc_id", F.col("r.license").alias("license"), (-F.col("r.minus")).alias("dice"), F.col("placed")[F.col("r.start")]["line"].cast("long").alias("line"))


def scan_all(docs: DataFrame, **more: object) -> DataFrame:
    """scan(), and the licences that only a run of words within or across lines names: with n_units 0, and as first_line
    the line where the first such run begins."""
    units = scan(docs, **more).select("doc_id", "license", "dice", "n_units", "first_line")
    runs = window_matches(docs, **more).select("doc_id", "license", "dice", F.lit(0).cast("long").alias("n_units"), F.col("line").alias("first_line"))
    unit = F.col("n_units") > 0
    both = units.unionByName(runs).groupBy("doc_id", "license").agg(
        F.coalesce(F.max(F.when(unit, F.col("dice"))), F.max("dice")).alias("dice"), F.sum("n_units").alias("n_units"),
        F.when(F.max(unit), F.min(F.when(unit, F.col("first_line")))).otherwise(F.min("first_line")).alias("first_line"),
    )
    return both


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_all(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams(t))}])" for name, t in sorted(TEMPLATES.items()))
    return f"""
    WITH t(license, held) AS (VALUES {rows}),
    l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
    u AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS unit FROM l
          UNION ALL SELECT doc_id, NULL, text FROM l WHERE len(ls) > 1),
    w AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM u),
    p AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ps FROM w WHERE len(ws) > 1),
    s AS (SELECT doc_id, line, license, 2.0 * len(list_intersect(ps, held)) / (len(ps) + len(held)) AS dice FROM p, t
          WHERE len(ps) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(held) - 1e-9 AND {(2 - THRESHOLD) / THRESHOLD} * len(held) + 1e-9),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS r FROM s WHERE dice >= {THRESHOLD})
    SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units, min(line)::BIGINT AS first_line FROM b WHERE r = 1 GROUP BY doc_id, license"""


SQL = _sql()

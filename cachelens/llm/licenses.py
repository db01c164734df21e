"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

Each line of a text, and the text as a whole, is normalised (lower case, everything but letters and digits to
one space) and compared with licence templates. With a bigrams here and b in the template, the coefficient is
at most 2 min(a, b) / (a + b), which rules out most templates by their sizes alone. Notices across line breaks or
inside longer lines are found as windows of consecutive words, in the texts that have words of some template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import text_or_empty

# The customary notices of public licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "ISC": ("Released under the ISC License.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
}
#: Openings and telling clauses of full texts and of file headers, for windows only.
PASSAGES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
}
#: A unit has a template's licence from this coefficient on.
LEAST_DICE = 0.85


def normalised(text: str) -> list[str]:
    return "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates: dict) -> list[tuple[str, list[str]]]:
    return [(name, bigrams(normalised(text))) for name, texts in templates.items() for text in texts]


def telling_words(grams: list[str], least: float) -> list[str]:
    """Words of which every window that reaches ``least`` has one: too few bigrams are without them."""
    chosen, left = [], grams
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if len(left) >= least * len(grams) / (2 - least):
            chosen.append(word)
            left = [g for g in left if word not in g.split()]
    return chosen


def computed(df: DataFrame, keep: list[str], name: str, value: Column, where: Column) -> DataFrame:
    """The rows ``where`` holds, with ``value``.

    As a generator's output the value is computed once a row: the optimizer would put the expression of a plain
    column in place of its name, also within the functions that run for each element of an array.
    """
    return df.select(*keep, F.explode(F.when(where, F.array(value))).alias(name))


def words_in(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def may_have(text: str, rows: list[tuple[str, list[str]]], least: float) -> Column:
    """Whether a text has a word that one of the templates can't do without."""
    telling = sorted({w for _, grams in rows for w in telling_words(grams, least)})
    return F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(telling)})(?![a-z0-9])")


def size_bounds(rows: list[tuple[str, list[str]]], least: float) -> tuple[float, float]:
    """How many bigrams a unit has at least and at most that reaches ``least`` with some template."""
    sizes = [len(grams) for _, grams in rows]
    return min(sizes) * least / (2 - least) - 1e-9, max(sizes) * (2 - least) / least + 1e-9


def embedded(documents: DataFrame, rows: list[tuple[str, list[str]]], units: list[tuple[str, list[str]]], least: float) -> DataFrame:
    """(doc_id, line, license, dice) of the best windows of each text that don't overlap, by their first word's line.

    A window begins and ends at bigrams of a template and has up to (2 - least) / least times as many. One that
    touches a line which as a unit reaches ``least`` with a template of ``units``, or of a text that does, is left
    out. The windows of all templates are then taken by coefficient, length, place and name; only those of a run
    that hangs together are compared, so a text with many notices takes time in proportion to them.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(may_have("text", rows, least))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    keep = ["doc_id", "row", "lines"]
    docs = computed(docs, ["doc_id", "row"], "lines", F.transform(F.split("text", "\n", -1), words_in), F.lit(True))
    words = F.flatten(F.transform("lines", lambda ws, k: F.transform(ws, lambda w: F.struct((k + 1).alias("line"), w.alias("word")))))
    docs = computed(docs, keep, "words", words, F.lit(True))
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat(F.get("words", i)["word"], F.lit(" "), F.get("words", i + 1)["word"]))
    docs = computed(docs, [*keep, "words"], "grams", pairs, F.size("words") >= 2)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(g) for g in grams]).alias("theirs"), F.lit(int(len(grams) * (2 - least) / least + 1e-9)).alias("most"), F.lit(len(grams) * least / (2 - least) - 1e-9).alias("fewest")) for name, grams in rows])
    docs = computed(docs, [*keep, "words", "grams"], "able", F.filter(known, lambda t: F.size(F.array_intersect("grams", t["theirs"])) >= t["fewest"]), F.lit(True)).filter(F.size("able") > 0)
    theirs = F.array(*[F.array(*[F.lit(g) for g in grams]) for _, grams in units])
    fewest, largest = size_bounds(units, least)

    def is_unit(grams: Column) -> Column:
        return F.exists(theirs, lambda t: F.round(2.0 * F.size(F.array_intersect(grams, t)) / (F.size(grams) + F.size(t)), 9) >= least)

    docs = computed(docs, [*keep, "words", "grams", "able"], "whole", F.array_distinct("grams"), F.lit(True))
    docs = docs.filter(~(F.size("whole").between(fewest, largest) & is_unit(F.col("whole"))))
    # Of each line, its bigrams if it may be a notice by itself; then, whether it is one.
    telling = F.array(*[F.lit(w) for w in sorted({w for _, grams in units for w in telling_words(grams, least)})])
    bigrams_of = F.transform("lines", lambda ws: F.when((F.size(ws) >= 2) & F.arrays_overlap(ws, telling), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat(F.get(ws, i), F.lit(" "), F.get(ws, i + 1))))))
    docs = computed(docs, ["doc_id", "row", "words", "grams", "able"], "by_line", bigrams_of, F.lit(True))
    noted = F.transform("by_line", lambda gs: F.when(F.size(gs).between(fewest, largest), is_unit(gs)).otherwise(F.lit(False)))
    docs = computed(docs, ["doc_id", "row", "words", "grams", "able"], "noted", noted, F.lit(True))
    # Where a template's bigrams are; then, from each of these places on, those within the longest window.
    places = F.transform("able", lambda t: t.withField("places", F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(t["theirs"], F.get("grams", i)))))
    docs = computed(docs, ["doc_id", "row", "words", "grams", "noted"], "placed", places, F.lit(True))

    def window(t: Column, p: Column, q: Column) -> Column:
        own = F.array_distinct(F.slice("grams", p + 1, q - p + 1))
        dice = F.round(2.0 * F.size(F.array_intersect(own, t["theirs"])) / (F.size(own) + F.size(t["theirs"])), 9)
        return F.struct((-dice).alias("order"), (p - q).alias("short"), p.alias("p"), t["name"].alias("name"), q.alias("q"), F.get("words", p)["line"].alias("line"))

    def windows(t: Column) -> Column:
        near = F.transform(t["places"], lambda p, k: F.filter(F.slice(t["places"], k + 1, t["most"]), lambda q: q < p + t["most"]))
        near = F.filter(near, lambda qs: F.size(qs) >= t["fewest"])
        return F.filter(F.flatten(F.transform(near, lambda qs: F.transform(qs, lambda q: window(t, F.get(qs, F.lit(0)), q)))), lambda x: x["order"] <= -least)

    def touches(x: Column) -> Column:
        return F.exists(F.slice("words", x["p"] + 1, x["q"] - x["p"] + 2), lambda w: F.get("noted", w["line"] - 1))

    docs = computed(docs, ["doc_id", "row", "words", "noted"], "found", F.flatten(F.transform("placed", windows)), F.lit(True))
    found = docs.select("doc_id", "row", F.explode(F.filter("found", lambda x: ~touches(x))).alias("x"))
    by_place = Window.partitionBy("row").orderBy("x.p", "x.q", "x.name")
    found = found.withColumn("upto", F.max("x.q").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("run", F.sum(F.when(F.col("x.p") > F.col("upto") + 1, 1).otherwise(0)).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("x")).alias("found"))
    none = F.array().cast("array<struct<order:double,short:int,p:int,name:string,q:int,line:int>>")
    taken = F.aggregate("found", none, lambda held, x: F.when(F.exists(held, lambda y: (x["p"] <= y["q"] + 1) & (y["p"] <= x["q"] + 1)), held).otherwise(F.concat(held, F.array(x))))
    return found.select("doc_id", F.explode(taken).alias("x")).select("doc_id", F.col("x.line").cast("int").alias("line"), F.col("x.name").alias("license"), (-F.col("x.order")).alias("dice"))


def scan_licenses(documents: DataFrame, templates: dict | None = None, least: float = LEAST_DICE) -> DataFrame:
    """(doc_id, line, license, dice) of every line, of the whole text as line 0, and of other parts that are licence notices.

    Lines are separated by line feeds and counted from 1; a text of one line is compared as that line only.
    A unit gets the template with the largest coefficient (rounded to 9 digits; ties to the last name) if it
    reaches ``least``. Only ASCII letters and digits make words. A null or empty text, or a unit under two
    words, has no bigrams and no licence. A unit without any word that some template can't do without isn't compared.
    Notices across lines or inside a longer line: see embedded. Texts of any length are compared as a whole, by one
    task each. Rows with the same doc_id each give their own rows. Other columns are ignored. An empty table gives an empty result. The templates are literals of the plan, whose size
    doesn't depend on the data.
    """
    rows = template_rows(TEMPLATES if templates is None else templates)
    parts = embedded(documents, rows + (template_rows(PASSAGES) if templates is None else []), rows, least)
    sizes = [len(grams) for _, grams in rows]
    fewest, largest = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(g) for g in grams]).alias("grams"), F.lit(len(grams)).alias("size")) for name, grams in rows])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(may_have("text", rows, least))
    lines = F.split("text", "\n", -1)
    units = F.concat(F.array(F.when(F.size(lines) > 1, F.col("text")).otherwise(F.lit(""))), lines)
    found = docs.select("doc_id", F.posexplode(units).alias("line", "unit")).filter(may_have("unit", rows, least))
    # A word takes two characters with its separator.
    found = found.filter(F.length("unit") >= 2 * int(fewest))
    found = computed(found, ["doc_id", "line"], "words", words_in(F.col("unit")), F.lit(True))
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat(F.get("words", i), F.lit(" "), F.get("words", i + 1)))
    found = computed(found, ["doc_id", "line"], "grams", F.array_distinct(pairs), (F.size("words") >= 2) & (F.size("words") - 1 >= fewest))

    def dice(t: Column) -> Column:
        return F.round(2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.size("grams") + t["size"]), 9)

    able = F.filter(known, lambda t: 2.0 * F.least(t["size"], F.size("grams")) >= least * (t["size"] + F.size("grams")))
    best = F.array_max(F.transform(able, lambda t: F.struct(dice(t).alias("dice"), t["name"].alias("name"))))
    found = computed(found, ["doc_id", "line"], "best", best, F.size("grams").between(fewest, largest))
    found = found.filter(F.col("best.dice") >= least).select("doc_id", "line", F.col("best.name").alias("license"), F.col("best.dice").alias("dice"))
    return found.unionByName(parts)


def scan_sql(table: str = "documents", least: float = LEAST_DICE) -> str:
    """The same in DuckDB SQL, without the size bounds."""
    known = " UNION ALL ".join(f"SELECT '{name}' AS license, [{', '.join(repr(g) for g in grams)}] AS theirs" for name, grams in template_rows(TEMPLATES))
    return f"""
    WITH known AS ({known}),
    lines AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM {table}),
    units AS (
        SELECT doc_id, row_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS unit FROM lines
        UNION ALL SELECT doc_id, row_id, 0, text FROM lines WHERE len(parts) > 1),
    worded AS (SELECT doc_id, row_id, line, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units),
    gramed AS (SELECT doc_id, row_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded WHERE len(w) >= 2),
    scored AS (SELECT doc_id, row_id, line, license, round(2.0::DOUBLE * len(list_intersect(grams, theirs)) / (len(grams) + len(theirs)), 9) AS dice FROM gramed, known)
    SELECT doc_id, line::INT AS line, max_by(license, (dice, license)) AS license, max(dice) AS dice FROM scored WHERE dice >= {least} GROUP BY doc_id, row_id, line"""

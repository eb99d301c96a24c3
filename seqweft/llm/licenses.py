"""License scans with DataFrame functions only: Dice coefficient over word bigrams between lines and licence templates.

Every line of a text, and a text of several lines as a whole, is a unit. A unit's set of word bigrams is compared only
with templates whose size allows the least Dice coefficient. Notices within a longer line or wrapped over lines are found by
windows: of a text's words, line breaks or not, as many as a template has, from every place where one of its bigrams
stands. Only templates of which the text holds enough bigrams at all are looked for. All of it happens within the row,
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Notices and short texts of public licences, as their owners publish them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def bigrams(text: str) -> list[str]:
    """The sorted word bigrams of a template."""
    import re

    words = re.sub(_BETWEEN, " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach the coefficient with one of n elements."""
    import math

    return math.ceil(round(least * n / (2 - least), 9)), math.floor(round((2 - least) * n / least, 9))


def n_bigrams(text: str) -> int:
    """Word bigrams of a template with repeats: the places of its window."""
    import re

    return max(0, len(re.sub(_BETWEEN, " ", text.lower()).split()) - 1)


def needed(n: int, least: float) -> int:
    """Elements of a set of n that any other set must hold to reach the coefficient."""
    import math

    return math.ceil(round(least * n / (2 - least), 9))


def _table(templates: list[tuple[str, str]], least: float) -> Column:
    rows = []
    for name, text in templates:
        own = bigrams(text)
        low, high = bounds(len(own), least)
        numbers = {"n": len(own), "low": low, "high": high, "places": n_bigrams(text), "need": needed(len(own), least)}
        rows.append(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own"), *[F.lit(v).alias(k) for k, v in numbers.items()]))
    return F.array(*rows)


def _windows(least: float) -> Column:
    """The best window of each likely template in the array `grams` (the text's bigrams by place), as an array of (dice, name,
    start, end); of equal ones the first. A window's set counts repeated strange bigrams each, so its coefficient is never
    too large."""

    def best(t: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains(t["own"], F.element_at(F.col("grams"), i)))

        def at(j: Column, hits: Column) -> Column:
            start = F.element_at(hits, j)
            own = F.filter(F.slice(hits, j, t["places"]), lambda i: i < start + t["places"])
            distinct = F.size(F.array_distinct(F.transform(own, lambda i: F.element_at(F.col("grams"), i))))
            dice = 2.0 * distinct / (t["places"] - F.size(own) + distinct + t["n"])
            return F.struct(dice.alias("dice"), (-start).alias("before"))

        # a window that holds enough places holds the one that is `need` - 1 places after its first
        dense = lambda h: F.filter(F.sequence(F.lit(1), F.size(h) - t["need"] + 1), lambda j: F.element_at(h, j + t["need"] - 1) < F.element_at(h, j) + t["places"])
        found = lambda h: F.when(F.size(h) >= t["need"], F.array_max(F.transform(dense(h), lambda j: at(j, h))))
        top = F.element_at(F.transform(F.array(hits), found), 1)
        return F.transform(F.array(top), lambda x: F.struct(x["dice"].alias("dice"), t["name"].alias("name"), (-x["before"]).alias("start"), (t["places"] - x["before"]).alias("end")))[0]

    return F.filter(F.transform(F.col("likely"), best), lambda x: x["dice"] >= least)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Per row: id and matches, an array of (dice, name): the best template of every unit that reaches `least`, and then,
    for each name that no unit has, the best window.

    A template's window counts if no window of another template that overlaps it is better (by dice, then name); of one
    template the best window is looked at, the first of equal ones. Null and empty texts, and units of fewer than two
    words, match nothing. Of templates with equal coefficients the last name counts. Templates of fewer than two words
    match nothing. Repeated rows are scanned one by one; other columns are left out.
    """
    templates = [t for t in (TEMPLATES if templates is None else templates) if n_bigrams(t[1])]
    table = _table(templates, least)
    sizes = [bounds(len(bigrams(t)), least) for _, t in templates]
    low, high = min(a for a, _ in sizes), max(b for _, b in sizes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # lower() is the quicker one, and the same where all characters are ASCII
    clean = F.regexp_replace(F.when(F.length("text") == F.octet_length("text"), F.lower("text")).otherwise(F.translate("text", _UPPER, _LOWER)), _BETWEEN, " ")
    words = lambda unit: F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1
    lines = F.transform(F.split("clean", "\n"), lambda u: F.trim(u))
    units = F.when(F.instr("clean", "\n") > 0, F.concat(lines, F.array(F.trim(F.regexp_replace("clean", "[ \n]+", " "))))).otherwise(lines)
    # repeated bigrams shrink a set, so only the least number of words bounds it from below; the set itself is checked next
    fitting = F.filter(units, lambda u: words(u) >= low + 1)
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    sets = F.filter(F.transform(fitting, lambda u: pairs(F.split(u, " "))), lambda s: (F.size(s) >= low) & (F.size(s) <= high))
    dice = lambda s, t: 2.0 * F.size(F.array_intersect(s, t["own"])) / (F.size(s) + t["n"])
    best = lambda s: F.array_max(F.transform(F.filter(F.col("likely"), lambda t: (F.size(s) >= t["low"]) & (F.size(s) <= t["high"])), lambda t: F.struct(dice(s, t).alias("dice"), t["name"].alias("name"))))
    found = F.filter(F.transform("sets", best), lambda m: m.isNotNull() & (m["dice"] >= least))
    whole = F.split(F.trim(F.regexp_replace("clean", "[ \n]+", " ")), " ")
    grams = F.zip_with(F.slice("whole", 1, F.size("whole") - 1), F.slice("whole", 2, F.size("whole") - 1), lambda a, b: F.concat_ws(" ", a, b))
    known = F.array(*map(F.lit, sorted({g for _, t in templates for g in bigrams(t)})))
    worse = lambda x: F.exists("windows", lambda y: (F.struct(y["dice"], y["name"]) > F.struct(x["dice"], x["name"])) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    own = F.filter("windows", lambda x: ~worse(x))
    plain = lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name"))
    more = F.filter(F.transform("own", plain), lambda x: ~F.exists("found", lambda y: y["name"] == x["name"]))
    one = F.filter("more", lambda x: ~F.exists("more", lambda y: (y["name"] == x["name"]) & (y["dice"] > x["dice"])))
    # a unit or window that reaches `least` holds `need` bigrams of its template, and so does the text; most texts hold too
    # few of any, and are done then
    holds = F.filter(F.col("templates"), lambda t: F.size(F.array_intersect(t["own"], F.col("shared"))) >= t["need"])
    fewest = min(needed(len(bigrams(t)), least) for _, t in templates)
    likely = F.when(F.size("shared") >= fewest, holds).otherwise(F.slice("templates", 1, 0))
    if_any = lambda c, kind: F.when(F.size("likely") > 0, c).otherwise(F.array().cast(kind))
    cleaned = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", clean.alias("clean"))
    worded = cleaned.select("id", "clean", whole.alias("whole"), table.alias("templates")).withColumn("grams", grams)
    seen = worded.withColumn("shared", F.array_intersect("grams", known)).withColumn("likely", likely).withColumn("sets", if_any(sets, "array<array<string>>"))
    seen = seen.withColumns({"found": if_any(found, "array<struct<dice:double,name:string>>"), "windows": if_any(_windows(least), "array<struct<dice:double,name:string,start:int,end:int>>")})
    return seen.withColumn("own", own).withColumn("more", more).select(F.col("id").alias(id_col), F.concat("found", F.array_distinct(one)).alias("matches"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    top = F.array_max("matches")
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"]))), ",").alias("licenses"),
        top["name"].alias("best"), F.round(top["dice"], 6).alias("best_dice"),
    )


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES)
    clean = lambda c: f"regexp_replace(translate({c}, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
    sets = lambda c: f"list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"
    return f"""
WITH raw_templates(name, body) AS (VALUES {rows}),
templates AS (SELECT name, {sets('w')} AS own FROM (SELECT name, string_split(trim({clean('body')}), ' ') AS w FROM raw_templates)),
cleaned AS (SELECT doc_id, {clean("coalesce(text, '')")} AS c FROM documents),
units AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, trim(unnest(l)) AS u FROM (SELECT doc_id, string_split(c, chr(10)) AS l FROM cleaned)
  UNION ALL SELECT doc_id, 0, trim(regexp_replace(c, '[ \\n]+', ' ', 'g')) FROM cleaned WHERE contains(c, chr(10))),
sets AS (SELECT doc_id, k, {sets('w')} AS s FROM (SELECT doc_id, k, string_split(u, ' ') AS w FROM units)),
dice AS (
  SELECT doc_id, k, name, 2.0 * len(list_intersect(s, own)) / (len(s) + len(own)) AS dice
  FROM sets, templates WHERE len(s) >= ceil(round({LEAST} * len(own) / {2 - LEAST}, 9)) AND len(s) <= floor(round({2 - LEAST} * len(own) / {LEAST}, 9)) AND len(s) > 0),
best AS (SELECT doc_id, k, max({{'dice': dice, 'name': name}}) AS m FROM dice WHERE dice >= {LEAST} GROUP BY doc_id, k),
wholes AS (SELECT doc_id, string_split(trim(regexp_replace(c, '[ \\n]+', ' ', 'g')), ' ') AS w FROM cleaned),
grams AS (SELECT doc_id, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM wholes),
known AS (SELECT row_number() OVER () AS t, name, len(own) AS n, len(string_split(trim({clean('body')}), ' ')) - 1 AS places, own FROM (SELECT name, body, {sets('w')} AS own FROM (SELECT name, body, string_split(trim({clean('body')}), ' ') AS w FROM raw_templates))),
hits AS (SELECT doc_id, t, n, places, p, g FROM grams JOIN (SELECT t, n, places, unnest(own) AS g FROM known) USING (g)),
spans AS (
  SELECT a.doc_id, a.t, a.p, 2.0 * count(DISTINCT b.g) / (a.places - count(*) + count(DISTINCT b.g) + a.n) AS dice
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.t = b.t AND b.p >= a.p AND b.p < a.p + a.places GROUP BY a.doc_id, a.t, a.p, a.places, a.n),
windows AS (SELECT doc_id, t, max(dice) AS dice, arg_max(p, {{'dice': dice, 'before': -p}}) AS p FROM spans WHERE dice >= {LEAST} GROUP BY doc_id, t),
placed AS (SELECT doc_id, t, name, dice, p, p + places AS e FROM windows JOIN known USING (t)),
inside AS (
  SELECT doc_id, name, max(dice) AS dice FROM placed x
  WHERE NOT EXISTS (SELECT 1 FROM placed y WHERE y.doc_id = x.doc_id AND (y.dice > x.dice OR (y.dice = x.dice AND y.name > x.name)) AND y.p < x.e AND x.p < y.e)
    AND NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = x.doc_id AND b.m.name = x.name)
  GROUP BY doc_id, name),
merged AS (SELECT doc_id, m FROM best UNION ALL SELECT doc_id, {{'dice': dice, 'name': name}} FROM inside),
found AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(list(m.name))) AS names, max(m) AS top FROM merged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(array_to_string(names, ','), '') AS licenses, top.name AS best, round(top.dice::DOUBLE, 6) AS best_dice
FROM documents d LEFT JOIN found USING (doc_id)
"""

"""Licence scan: normalised text against licence templates by the Dice
coefficient over word bigrams, in DataFrame functions only.

A text is looked at in units: every line, every paragraph (lines up to a blank
one) and the whole text.  A unit is lower-cased and cut into its runs of ASCII
letters and digits; its set of word bigrams is compared with each template's:

    dice = 2 * shared / (bigrams of the unit + bigrams of the template)

Size bounds prune first: dice can only reach ``t`` if the smaller set has at
least ``t / (2 - t)`` times the bigrams of the larger, so a unit outside the range
of every template is dropped, and each template is only compared with units of
its own range.  Before that, a unit must have one of the words that no match can
lack, which follow from the same bounds.  The templates are a bounded list in
the plan; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = (80, 100)  # dice of at least this
MAX_TEMPLATES = 200
#: Customary licence notices and short statements, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
WORDS = "[a-z0-9]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(WORDS, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole of a text."""
    return F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1), F.array(text)))


def _needed_words(known: list[tuple[str, list[str]]], num: int, den: int) -> list[str]:
    """Words of which every matching unit has at least one.  A match lacks at most
    ``b - shared`` bigrams of its template, so it has one of any set of one more;
    the longest words are chosen, as the rarest."""
    out = set()
    for _, bigrams in known:
        b = len(bigrams)
        least = -(-num * b // (2 * den - num))
        shared = -(-num * (least + b) // (2 * den))
        longest = sorted((max(x.split(" "), key=len) for x in bigrams), key=lambda w: (-len(w), w))
        out.update(longest[: b - shared + 1])
    return sorted(out)


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, license, dice, licenses``.

    ``license`` is the name of the best unit and template (largest dice, ties to
    the smaller name), ``dice`` its coefficient, ``licenses`` all names found, in
    order; null, 0 and empty where none reaches the threshold.  Null and empty
    texts have none; units of fewer than two words have no bigrams and match
    nothing; repeated rows get equal results; an empty table gives an empty
    result; other columns are ignored.
    """
    num, den = threshold
    known = [(name, template_bigrams(text)) for name, text in templates]
    known = [(n, b) for n, b in known if b]
    if not 0 < len(known) <= MAX_TEMPLATES:
        raise ValueError(f"between 1 and {MAX_TEMPLATES} templates of two words or more are needed")
    # a set of b bigrams can match sizes from num * b / (2 den - num) to b * (2 den - num) / num
    bounds = [(-(-num * len(b) // (2 * den - num)), len(b) * (2 * den - num) // num) for _, b in known]
    low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
    hint = f"(?i)(?<![a-z0-9])(?:{'|'.join(_needed_words(known, num, den))})(?![a-z0-9])"

    def words(unit: Column) -> Column:
        return F.regexp_extract_all(_ascii_lower(unit), F.lit(f"({WORDS})"), F.lit(1))

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))

    def matches(b: Column) -> Column:
        n, found = F.size(b), []
        for (name, known_b), (lo, hi) in zip(known, bounds):
            # the size bounds come first: no set is built for a template out of range
            shared = F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in known_b])))
            found.append(F.when((n >= lo) & (n <= hi), F.struct(
                (-(F.lit(2.0) * shared / (n + len(known_b)))).alias("d"), F.lit(name).alias("name"))))
        return F.filter(F.array(*found), lambda x: x["d"] * -den >= num)

    text = F.col("text")
    hinted = F.filter(units(text), lambda u: u.rlike(hint))
    sets = F.transform(F.filter(F.transform(hinted, words), lambda w: F.size(w) >= 2), bigrams)
    sized = F.filter(sets, lambda b: (F.size(b) >= low) & (F.size(b) <= high))
    found = F.array_sort(F.flatten(F.transform(sized, matches)))
    none = F.expr("CAST(array() AS array<struct<d: double, name: string>>)")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", F.coalesce(F.when(text.rlike(hint), found), none).alias("m"))
    best = F.get("m", F.lit(0))
    return out.select(
        "doc_id", best["name"].alias("license"), F.coalesce(-best["d"], F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["name"]))), ",").alias("licenses"))


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    num, den = THRESHOLD
    rows = ", ".join(
        "('{}', [{}])".format(n, ", ".join(f"'{x}'" for x in template_bigrams(t))) for n, t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) AS t(name, b)),
units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)),
    regexp_split_to_array(text, '\n[ \t\r]*\n'), [text]))) AS unit FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, regexp_extract_all(translate(unit, '{upper}', '{lower}'), '{WORDS}') AS w FROM units
    WHERE regexp_matches(unit, '(?i)[a-z]')),
sets AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS s FROM words
    WHERE len(w) >= 2),
dices AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(s, b)) / (len(s) + len(b)) AS dice FROM sets, templates
    WHERE len(s) * {2 * den - num} >= len(b) * {num} AND len(b) * {2 * den - num} >= len(s) * {num}),
found AS (SELECT doc_id, name, max(dice) AS dice FROM dices WHERE dice * {den} >= {num} GROUP BY ALL),
best AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice,
    string_agg(name, ',' ORDER BY name) AS licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, b.license, coalesce(b.dice, 0.0)::DOUBLE AS dice, coalesce(b.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id"""

"""License scans: normalised text compared to license templates by the Dice coefficient of word bigrams.

Units of a document are its whole text, its paragraphs and its lines. A unit is lower-cased, everything but letters and
digits becomes one space, and its set is the distinct pairs of neighbouring words. A unit matches a template if
``2 * |A and B| / (|A| + |B|)`` is at least 0.8; the best template per unit counts.

What no matching unit covers is searched by word windows, across lines and paragraphs, so a notice inside a line or
wrapped over some lines counts too. A window starts and ends with a bigram of its template and has as many bigrams as a
matching set may have. Of overlapping windows the best one counts: the highest Dice, then the most shared bigrams, the
first place, the first name. Windows of the same words and template count once, as equal units do.

Three bounds prune without losing a match. A set of another size than ``[t / (2 - t), (2 - t) / t]`` times the
template's cannot reach the threshold ``t``; a unit with fewer words than the smallest such set is dropped before its
bigrams are made. And each template has key words, its longest ones, so many that too few of its bigrams to match hold
none of them: a unit without any key word matches nothing.

Everything is a DataFrame expression over one document at a time: nothing is shuffled and nothing is joined, since the
templates are literals of the plan. Defined results: a null or empty text, or one without a match, has no matches;
repeated rows give equal rows; equal Dice values go to the first template by name. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Short notices and the opening or only paragraphs of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, t: float = THRESHOLD) -> tuple[int, int]:
    """Sizes that a set must have to reach ``t`` with a set of ``n``; in fractions, since a rounded product loses sizes."""
    exact = Fraction(str(t))
    return math.ceil(n * exact / (2 - exact)), math.floor(n * (2 - exact) / exact)


def key_words(templates: Mapping[str, str], t: float = THRESHOLD) -> list[str]:
    """Words of which every matching unit holds at least one; among words of a length those of few templates come first."""
    chosen: set[str] = set()
    spread = Counter(w for text in templates.values() for w in set(words_of(text)))
    for text in templates.values():
        grams = bigrams_of(text)
        needed = size_bounds(len(grams), t)[0]  # the smallest set that matches shares all of itself
        for word in sorted(set(words_of(text)), key=lambda w: (-len(w), spread[w], w)):
            if sum(not chosen & set(g.split()) for g in grams) < needed:
                break
            chosen.add(word)
    return sorted(chosen)


def normalised(unit: Column) -> Column:
    """Words of a unit, of A-Z, a-z and 0-9 only, in lower case."""
    letters = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(letters, "[^a-z0-9]+", " ")), " ")


def license_scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_matches, best (license of the highest Dice), dice, licenses (distinct, sorted) of every document."""
    least = min(size_bounds(len(bigrams_of(x)))[0] for x in templates.values())
    keys = key_words(templates)
    pattern = "(?i)" + "|".join(keys)
    # in-row: units -> candidate units -> best match of each
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[\x20\t\r]*\n"), F.split(text, "\n")))
    rows = documents.select("doc_id", "text").withColumn(
        "_units",
        F.when(F.col("text").rlike(pattern), F.filter(units, lambda u: u.rlike(pattern))).otherwise(F.array().cast("array<string>")),
    )
    # the units stay beside their words: those that match are left out of the search by windows
    split = F.transform("_units", lambda u: F.struct(u.alias("unit"), normalised(u).alias("words")))
    split = F.filter(split, lambda u: (F.size(u.words) > least) & F.arrays_overlap(u.words, F.array(*map(F.lit, keys))))
    rows = rows.select("doc_id", text.alias("_text"), F.col("text").rlike(pattern).alias("_any"), split.alias("_split"))
    best = F.transform("_split", lambda u: F.struct(u.unit.alias("unit"), _best(u.words, templates).alias("best")))
    rows = rows.select("doc_id", "_text", "_any", F.filter(best, lambda u: u.best.isNotNull()).alias("_whole"))
    matched = F.transform("_whole", lambda u: u.unit)
    inside = F.when(F.col("_any") & ~F.array_contains(matched, F.col("_text")), _uncovered(F.col("_text"), matched))
    rows = rows.select("doc_id", F.transform("_whole", lambda u: u.best).alias("_best"), inside.alias("_rest"))
    stretches = F.filter("_rest", lambda w: (F.size(w) > least) & F.arrays_overlap(w, F.array(*map(F.lit, keys))))
    rows = rows.select("doc_id", "_best", F.flatten(F.transform(stretches, lambda w: _windows(w, templates))).alias("_inside"))
    windows = F.transform(F.array_distinct("_inside"), lambda m: F.struct(m.dice.alias("dice"), m.license.alias("license")))
    rows = rows.select("doc_id", F.concat("_best", F.coalesce(windows, F.array().cast(MATCHES))).alias("_found"))
    order = F.array_sort(F.transform("_found", lambda m: F.struct((-m.dice).alias("d"), m.license.alias("license"))))
    return rows.select(
        "doc_id",
        F.size("_found").cast("long").alias("n_matches"),
        F.get(order, F.lit(0)).license.alias("best"),
        (-F.get(order, F.lit(0)).d).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda m: m.license))), ",").alias("licenses"),
    )


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pairs_of(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat_ws(" ", F.get(words, k - 1), F.get(words, k)))


def _table(templates: Mapping[str, str], t: float) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams_of(templates[name]))).alias("grams"),
                 *(F.lit(b).alias(k) for b, k in zip(size_bounds(len(bigrams_of(templates[name])), t), ("low", "high"), strict=True)))
        for name in sorted(templates)
    ])


def _uncovered(text: Column, matched: Column) -> Column:
    """Words of the stretches between matching paragraphs and lines."""
    left = lambda unit, words: F.when(F.array_contains(matched, unit), F.lit("|")).otherwise(words)
    letters = lambda unit: F.array_join(normalised(unit), " ")
    lines = lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda u: left(u, letters(u))), " ")
    rest = F.array_join(F.transform(F.split(text, r"\n[\x20\t\r]*\n"), lambda p: left(p, lines(p))), " ")
    rest = F.when(F.size(matched) == 0, letters(text)).otherwise(rest)
    return F.transform(F.split(rest, r"\|"), lambda s: F.split(F.trim(F.regexp_replace(s, " +", " ")), " "))


MATCHES = "array<struct<dice:double,license:string>>"
PLACES = "array<struct<d:double,shared:int,first:int,license:string,last:int>>"


def _windows(words: Column, templates: Mapping[str, str], t: float = THRESHOLD) -> Column:
    """The best (dice, license, text) of each group of overlapping windows."""
    table = _table(templates, t)

    def ends(grams: Column, m: Column, first: Column) -> Column:
        """Windows from a place on, as places to be sorted best first."""
        last = F.sequence(first + m.low - 1, F.least(first + m.high, F.size(grams)) - 1)
        last = F.filter(last, lambda k: F.array_contains(m.grams, F.get(grams, k)))

        def place(k: Column) -> Column:
            def scored(part: Column) -> Column:
                shared = F.size(F.array_intersect(part, m.grams))
                dice = 2.0 * shared / (F.size(part) + F.size(m.grams))
                return F.struct((-dice).alias("d"), (-shared).alias("shared"), first.alias("first"), m.license.alias("license"), k.alias("last"))

            return once(F.array_distinct(F.slice(grams, first + 1, k - first + 1)), scored)

        return F.filter(F.transform(last, place), lambda p: p.d <= -t)

    def matching(grams: Column, m: Column) -> Column:
        hits = F.array_compact(F.transform(grams, lambda g, k: F.when(F.array_contains(m.grams, g), k)))
        reach = lambda k: F.size(F.array_intersect(F.slice(grams, k + 1, m.high), m.grams))
        hits = F.filter(hits, lambda k: (k + m.low <= F.size(grams)) & (reach(k) >= m.low))
        return F.flatten(F.transform(hits, lambda k: ends(grams, m, k)))

    def found(grams: Column) -> Column:
        fit = F.filter(table, lambda m: F.size(F.array_intersect(grams, m.grams)) >= m.low)
        ranked = F.array_sort(F.flatten(F.transform(fit, lambda m: matching(grams, m))))
        # windows of neighbouring bigrams share a word
        apart = lambda p: lambda q: (q.last + 1 < p.first) | (p.last + 1 < q.first)
        return F.aggregate(ranked, F.array().cast(PLACES), lambda kept, p: F.when(F.forall(kept, apart(p)), F.concat(kept, F.array(p))).otherwise(kept))

    return F.transform(once(pairs_of(words), found), lambda p: F.struct(
        (-p.d).alias("dice"), p.license.alias("license"), F.array_join(F.slice(words, p.first + 1, p["last"] - p.first + 2), " ").alias("text")))


def _best(words: Column, templates: Mapping[str, str], t: float = THRESHOLD) -> Column:
    """The best (dice, license) of a unit's words; null if no template reaches the threshold."""
    table = _table(templates, t)

    def against(grams: Column) -> Column:
        fit = F.filter(table, lambda m: F.size(grams).between(m.low, m.high))
        dice = lambda m: 2.0 * F.size(F.array_intersect(grams, m.grams)) / (F.size(grams) + F.size(m.grams))
        found = F.filter(F.transform(fit, lambda m: F.struct(dice(m).alias("dice"), m.license.alias("license"))), lambda m: m.dice >= t)
        ranked = F.array_sort(F.transform(found, lambda m: F.struct((-m.dice).alias("d"), m.license.alias("license"))))
        first = F.get(ranked, F.lit(0))
        return F.when(F.size(found) > 0, F.struct((-first.d).alias("dice"), first.license.alias("license")))

    # one element, so that the set is made once and not for every template
    return once(F.array_distinct(pairs_of(words)), against)

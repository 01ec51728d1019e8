"""Licence scan by sentence rules, in DataFrame operations only.

A text is split into pieces at line ends and behind . ! ? before white space; pieces are normalised to lower-case letters and
digits with single blanks. A known sentence has an identifier and is found where its words stand from a piece's beginning, or
from behind a semicolon, to a piece's end or a semicolon, over as many pieces as it takes: wrapped sentences and abbreviations
with a full stop are whole. Of several the longest is taken. The identifiers of a text, in order, are matched against ordered
rules: each rule is a run of identifiers, the first rules are tried first, and what a rule has matched is not matched again.
All of it is a projection of each row: nothing is shuffled, exploded or broadcast, so neither long texts nor frequent
licences make a hot group. Both tables are parameters; their sizes bound the expression.

Defined results: null and empty texts have no sentences; licences are given once each, in the order of the rules; `unknown`
counts pieces that speak of a licence outside known sentences, `unmatched` known ones that no rule took. Extra columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and the licence sentences that they stand for, normalised.
SENTENCES = {
    "agpl3-ref": "licensed under the gnu affero general public license version 3",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-ref-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "asis-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd2-ref": "licensed under the bsd 2 clause license",
    "bsd3-ref": "licensed under the bsd 3 clause license",
    "cc0-ref": "released under cc0 1 0",
    "ccby4-ref": "licensed under cc by 4 0",
    "ccbync4-ref": "licensed under cc by nc 4 0",
    "ccbysa4-ref": "licensed under cc by sa 4 0",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-ref": "released under the isc license",
    "lgpl3-ref": "licensed under the gnu lesser general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-grant-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-ref": "released under the mit license",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Licences in the order in which they are tried, and the runs of identifiers that give them.
RULES = [
    ("Apache-2.0", ["apache2-ref-the", "apache2-comply", "apache2-copy", "asis-basis"]),
    ("Apache-2.0", ["apache2-ref-the", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("MIT", ["mit-grant-full", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache2-ref-the"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MIT", ["mit-grant-full"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("BSD", ["bsd-redist"]),
    ("ISC", ["isc-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("Unlicense", ["unlicense"]),
    ("proprietary", ["reserved"]),
]

#: Fixed value: a sentence with one of these is about a licence; what isn't known counts as unknown then.
MARKS = r"licen[sc]e|permission|warrant|redistribut|cc0|public domain|rights reserved|copyright"


#: The same over line ends: a look at a whole text.
LOOK = MARKS.replace(" ", "[^a-z0-9]+")


def pieces(text: Column) -> Column:
    """A text's normalised pieces in one string, each behind a line feed and a sign: ! if it has a mark of a licence, else ~.
    Semicolons stay."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[.!?])\s+")
    sign = lambda s: F.when(F.lower(s).rlike(MARKS), "\n!").otherwise("\n~")
    return F.array_join(F.transform(parts, lambda s: F.concat(sign(s), F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9;]+", " ")))), "")


def pattern(known: dict[str, str]) -> str:
    """Of the known sentences in what pieces() gives."""
    each = [r"[ ;!~\n]++".join(s.split()) for s in sorted(known.values(), key=len, reverse=True)]
    return rf"(?<=[!~;])[ ;]*+(?:{'|'.join(each)}) ?(?=[\n;]|\z)"


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """doc_id, sentence_ids (joined by commas, in order), licences (joined by commas), unmatched and unknown of every row of
    docs (doc_id, text)."""
    table = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    # documents without any mark, nearly all, are settled by one look; known sentences without one are looked for themselves
    bare = [r"[^a-z0-9]+".join(s.split()) for s in known.values() if not re.search(MARKS, s)]
    rows = docs.select("doc_id", F.when(F.lower("text").rlike("|".join([LOOK, *bare])), pieces(F.col("text"))).otherwise("").alias("s"))
    one, none = F.lit(pattern(known)), F.array().cast("array<string>")
    hits = F.transform(F.regexp_extract_all("s", one, F.lit(0)), lambda x: F.try_element_at(table, F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))))
    left = F.filter(F.split(F.regexp_replace("s", one, F.lit("!")), "\n"), lambda x: F.contains(x, F.lit("!")) & x.rlike(MARKS))
    rows = rows.select("doc_id", F.when(F.col("s") == "", none).otherwise(hits).alias("ids"), F.when(F.col("s") == "", 0).otherwise(F.size(left)).cast("long").alias("unknown"))
    joined = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    rows = rows.withColumn("rest", F.when(F.size("ids") > 0, joined).otherwise(""))
    # a step a rule: whether what is left has its run, and what is left without it
    step = F.struct(F.col("rest").alias("rest"), F.array().cast("array<string>").alias("hits"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in run)).alias("run")) for name, run in rules])

    def tried(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        # what was on both sides of a run isn't joined to a new one
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["run"], F.lit("|"))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["hits"], F.array(rule["name"]))).otherwise(state["hits"]).alias("hits"),
        )

    done = F.when(F.col("rest") == "", step).otherwise(F.aggregate(table, step, tried))
    rows = rows.withColumn("done", done)
    return rows.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("done.hits", ",").alias("licences"),
        F.regexp_count("done.rest", F.lit(",[^,|]+,")).cast("long").alias("unmatched"),
        "unknown",
    )

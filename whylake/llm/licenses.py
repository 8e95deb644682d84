"""Licence scan by sentences and rules.

Texts are split into pieces at line ends and after closing marks, colons and semicolons.  Pieces are normalised to
lower-case words, so comment marks vanish, and every run of pieces that makes up a known licence sentence, on one line or
wrapped over many, is a hit; this gives a sequence of sentence numbers.  Places are counted in lines and sentences.  A rule is an ordered list of such
numbers; it matches where its sentences follow one another with no other sentence of the same rule between them.

Cases: a null or empty text has no sentences; every occurrence of a rule is a row; repeated rows and null ids have their
own findings; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.llm.common import table

# Sentences of public licences, lower case, words only.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may obtain a copy of the license at",
    3: "this work is licensed under the gnu general public license version 3",
    4: "released under the mit license",
    5: "licensed under cc by nc 4 0",
    6: "licensed under cc by 4 0",
    7: "licensed under cc by sa 4 0",
    8: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    11: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    12: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    13: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    14: "you should have received a copy of the gnu general public license along with this program",
}
#: Ordered rules: (rule, licence, sentence numbers).
RULES = [
    ("apache-notice", "Apache-2.0", [1]),
    ("apache-notice-with-address", "Apache-2.0", [1, 2]),
    ("gpl-notice", "GPL-3.0", [3]),
    ("gpl-header", "GPL-3.0-or-later", [13, 14]),
    ("mit-notice", "MIT", [4]),
    ("mit-text", "MIT", [8, 9]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", [5]),
    ("cc-by-notice", "CC-BY-4.0", [6]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", [7]),
    ("bsd-text", "BSD-2-Clause", [10, 11, 12]),
]
#: Headers and licences beyond those of the SQL statement, which looks at single lines only.
MORE_SENTENCES = {
    15: "licensed under the apache license version 2 0 the license",
    16: "you may not use this file except in compliance with the license",
    17: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    18: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    19: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    20: "this source code form is subject to the terms of the mozilla public license v 2 0",
    21: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    22: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    23: "this is free and unencumbered software released into the public domain",
    24: "distributed under the boost software license version 1 0",
}
MORE_RULES = [
    ("apache-header", "Apache-2.0", [15, 16, 2]),
    ("gpl-2-header", "GPL-2.0-or-later", [17, 14]),
    ("lgpl-header", "LGPL-2.1-or-later", [18]),
    ("agpl-header", "AGPL-3.0-or-later", [19]),
    ("mpl-header", "MPL-2.0", [20]),
    ("isc-text", "ISC", [21]),
    ("bsd-3-text", "BSD-3-Clause", [10, 11, 12, 22]),
    ("unlicense-text", "Unlicense", [23]),
    ("boost-notice", "BSL-1.0", [24]),
]
END_OF_SENTENCE = "([.!?])[ \\t\\x0B\\f\\r]+"
NOT_A_WORD = "[^\\p{L}\\p{N}]+"


#: Comment words and list marks before the words of a line; marks without letters or digits need no rule.
MARK = "(?i)^[^\\p{L}\\p{N}]*(?:(?:dnl|rem)[ \\t]+|[0-9a-z]\\)[ \\t]+)"


def pieces(text: Column) -> Column:
    """Array of (place, words): normalised pieces of a text in their order with the place of their line or sentence."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), END_OF_SENTENCE, "$1\n"), "\n")
    lines = F.filter(lines, lambda s: s.rlike("[\\p{L}\\p{N}]"))

    def normal(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, MARK, "")), NOT_A_WORD, " "))

    parts = F.transform(lines, lambda s, i: F.transform(F.split(s, "(?<=[:;])[ \\t]+"), lambda p: F.struct(i.alias("place"), normal(p).alias("words"))))
    return F.filter(F.flatten(parts), lambda p: p["words"] != "")


def hits_of(known: list[str]) -> Column:
    """Array of (first, last, at, sentence): runs of the column ``pieces`` that are a known sentence."""
    most, longest = max(s.count(" ") + 1 for s in known), max(map(len, known))
    starts = sorted({" ".join(s.split(" ")[:3]) for s in known})
    start = f"^(?:{'|'.join(starts)})(?: |$)"
    part = F.col("pieces")

    def run(i: Column, n: Column | int) -> Column:
        # a piece longer than every sentence is cut: it is in none of them
        return F.array_join(F.transform(F.slice(part, i + 1, n), lambda p: F.substring(p["words"], 1, longest + 1)), " ")

    def begins(p: Column, i: Column) -> Column:
        return F.when(p["words"].rlike("^[^ ]+ [^ ]+ [^ ]"), p["words"].rlike(start)).otherwise(run(i, 3).rlike(start))

    begun = F.filter(F.transform(part, lambda p, i: F.when(begins(p, i), i)), lambda i: i.isNotNull())
    runs = F.transform(begun, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(part) - i)), lambda n: F.struct(
        F.get(part, i)["place"].alias("first"), F.get(part, i + n - 1)["place"].alias("last"), i.alias("at"), run(i, n).alias("sentence"))))
    return F.filter(F.flatten(runs), lambda r: r["sentence"].isin(known))


def scan(docs: DataFrame, known: dict[int, str] | None = None, rules: list | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rule, license, first_sentence, last_sentence): places of sentences are counted from 0."""
    spark = docs.sparkSession
    steps = [(rule, name, n, i, len(numbers)) for rule, name, numbers in (RULES + MORE_RULES if rules is None else rules) for i, n in enumerate(numbers, 1)]
    known = SENTENCES | MORE_SENTENCES if known is None else known
    known_table = spark.createDataFrame(list(known.items()), "number int, sentence string")
    step_table = spark.createDataFrame(steps, "rule string, license string, number int, step int, steps int")
    marked = known_table.join(F.broadcast(step_table), "number").drop("number")  # fixed tables of a few dozen rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    cut = rows.select("doc_id", "row", pieces(F.col("text")).alias("pieces"))
    places = cut.select("doc_id", "row", F.explode_outer(hits_of(list(known.values()))).alias("hit")).where("hit is not null").select("doc_id", "row", "hit.*")
    hits = places.join(F.broadcast(marked), "sentence").drop("sentence")
    order = Window.partitionBy("row", "rule").orderBy("at", "last")
    # sentences of a rule in their order have steps that rise with their rank
    run = hits.withColumn("run", F.row_number().over(order) - F.col("step"))
    return (
        run.groupBy("row", "doc_id", "rule", "license", "steps", "run")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first_sentence"), F.max("last").alias("last_sentence"))
        .where("n = steps").select("doc_id", "rule", "license", "first_sentence", "last_sentence"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    known = ", ".join(f"({n}, '{s}')" for n, s in SENTENCES.items())
    steps = ", ".join(f"('{rule}', '{name}', {n}, {i}, {len(numbers)})" for rule, name, numbers in RULES for i, n in enumerate(numbers, 1))
    return f"""
WITH known(number, sentence) AS (VALUES {known}),
steps(rule, license, number, step, steps) AS (VALUES {steps}),
docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, row_no, string_split(regexp_replace(text, '([.!?])[ \\t\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM docs),
normal AS (SELECT doc_id, row_no, list_filter(list_transform(parts, lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda s: s <> '') AS parts FROM lines),
places AS (SELECT doc_id, row_no, unnest(parts) AS sentence, unnest(range(len(parts))) AS place FROM normal),
hits AS (SELECT doc_id, row_no, place, rule, license, step, steps FROM places JOIN known USING (sentence) JOIN steps USING (number)),
runs AS (SELECT *, row_number() OVER (PARTITION BY row_no, rule ORDER BY place) - step AS run FROM hits)
SELECT doc_id, rule, license, CAST(min(place) AS INTEGER) AS first_sentence, CAST(max(place) AS INTEGER) AS last_sentence
FROM runs GROUP BY row_no, doc_id, rule, license, steps, run HAVING count(*) = steps"""

"""License scans: exact containment join of license templates with the text blocks of documents.

A block is any run of consecutive words of a document, ``STRETCH`` times as long as the template's text. It matches
a template if it holds at least ``THRESHOLD`` of the template's distinct words and all of its naming words. All blocks
of all documents are covered, by a set-similarity join of two tables of tokens:

* words in global order: rarest first, by the number of documents that hold them, counted over all of them;
* prefix filter: a matching block misses few template words, so it holds ``AGREE`` of the template's rarest; the prefix
  words of the documents are joined with those of the templates, and only what meets goes on;
* length filter: document and block must hold as many words as the match needs;
* positional filter: the prefix words within a block's reach and all words later in the global order must suffice.

What passes is compared in full, at each place where a block can begin with a word of the template (a block that
begins elsewhere holds no more). Base places are those where a phrase's words stand consecutively.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A null text is empty: no words, no labels, score
0. Repeated rows and null ids are scanned each; an empty table gives an empty result; a very long text is scanned to its
end; other columns aren't read, whatever their names. All steps are DataFrame and column functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.workspace import Workspace

#: Label of each phrase whose consecutive words are base places.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, naming words, text) of common license notices.
TEMPLATES = (
    ("mit", "permission granted charge merge sublicense", """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"""),
    ("mit", "permission granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "this project is licensed under the terms of the mit license"),
    ("isc", "permission isc use copy", "isc license permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "apache license file compliance", """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
the license for the specific language governing permissions and limitations under the license"""),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "file compliance license", "you may not use this file except in compliance with the license"),
    ("bsd", "redistributions endorse promote", """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in
binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission"""),
    ("bsd", "redistribution binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "gnu general public redistribute", """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
general public license for more details"""),
    ("gpl", "gnu public", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu public redistribute", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"),
    ("unlicense", "unencumbered domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "cc0", "to the extent possible under law the author has dedicated all copyright and related rights to the public domain under the cc0 dedication"),
    ("cc-by", "commons attribution international", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "cc sa", "licensed under cc by sa 4 0"),
)
THRESHOLD = 0.8
#: Words of a block for each word of the template's text.
STRETCH = 1.5
#: Prefix words that a matching block holds at least (or as many as it needs, if fewer).
AGREE = 2
#: Rows of a table of template words up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCKS = "array<struct<template:int,label:string,first_word:bigint,n_words:bigint,held:int,containment:double>>"


def words_of(text: Column) -> Column:
    """Two letters outside ASCII that have ASCII lower case are set aside before ``lower``."""
    apart = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.array_remove(F.split(F.lower(apart), SEPARATORS), "")


def template_rows(templates: tuple, threshold: float, stretch: float) -> list[tuple]:
    """(template, label, word, names it, distinct words, words needed, words of a block) for each word."""
    out = []
    for i, (label, names, text) in enumerate(templates):
        words = text.split()
        distinct = sorted(set(words))
        if missing := set(names.split()) - set(words):
            raise ValueError(f"naming words {sorted(missing)} aren't in the template of {label}")
        need, reach = math.ceil(threshold * len(distinct) - 1e-9), max(1, int(stretch * len(words)))
        out += [(i, label, w, w in names.split(), len(distinct), max(need, 1), reach) for w in distinct]
    return out


def _bounded(df: DataFrame, n: int) -> DataFrame:
    """A broadcast if the counted rows allow it."""
    return F.broadcast(df) if n <= BROADCAST_WORDS else df


def _phrase_starts(words: list[str]) -> Column:
    """Word numbers where all words of a phrase stand one after another, out of the phrases' words ``told``."""
    def stand(h: Column, i: Column) -> Column:
        here = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            then = F.get("told", i + k)
            here = here & F.coalesce((then["word"] == w) & (then["at"] == h["at"] + k), F.lit(False))
        return here

    return F.transform(F.filter("told", stand), lambda h: h["at"])


def scan(
    docs: DataFrame, space: Workspace, phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES,
    threshold: float = THRESHOLD, stretch: float = STRETCH,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matching ``blocks``."""
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    rows = template_rows(templates, threshold, stretch)
    terms = spark.createDataFrame(rows, "template int, label string, word string, names boolean, size int, need int, reach int")
    vocabulary = sorted({r[2] for r in rows} | {w for p in phrases for w in p.split()})

    # whole texts are read once; of a document only vocabulary words stay, with their places
    numbered = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    known = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    table = numbered.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), known.alias("hits"))
    table = space.write(table, "hits")  # written, so that row numbers stand

    # the global order of the template words: as many rows as the vocabulary has words
    often = table.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    rarest = Window.partitionBy("template").orderBy(F.coalesce("docs", F.lit(0)), "word")
    ranked = terms.join(often, "word", "left").withColumn("nth", F.row_number().over(rarest))
    ranked = space.write(ranked.withColumn("prefix", F.col("nth") <= F.col("size") - F.col("need") + F.least(F.lit(AGREE), F.col("need"))), "terms")

    # prefix words of documents meet those of templates
    prefix = _bounded(ranked.filter("prefix").select("word", "template", "need", "reach"), len(rows))
    places = table.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", F.col("h.at").alias("at"), F.col("h.word").alias("word"))
    met = places.join(prefix, "word").filter(F.col("n_words") >= F.col("need"))
    pairs = met.groupBy("row", "template").agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("anchors"), F.first("need").alias("need"), F.first("reach").alias("reach")
    )  # of one document and template
    # a block holds anchors from its first one on, and no more than its reach has places
    later = F.col("need") - F.least(F.lit(AGREE), F.col("need"))  # template words after the prefix
    ahead = lambda a, i: F.filter(F.slice("anchors", i + 1, F.col("reach")), lambda b: b["at"] < a["at"] + F.col("reach"))
    enough = F.transform("anchors", lambda a, i: F.when(F.size(F.array_distinct(F.transform(ahead(a, i), lambda b: b["word"]))) + later >= F.col("need"), a["at"]))
    # what a block around such an anchor can hold lies in the anchor's stretch of words or the ones beside it
    stretches = lambda at: F.sequence(F.floor(at / F.col("reach")) - 1, F.floor(at / F.col("reach")) + 1)
    pairs = pairs.withColumn("near", F.array_distinct(F.flatten(F.transform(F.array_compact(enough), stretches)))).filter(F.size("near") > 0).select("row", "template", "near")
    sets = ranked.groupBy("template", "label", "size", "need", "reach").agg(F.collect_set("word").alias("set"), F.collect_set(F.when(F.col("names"), F.col("word"))).alias("names"))

    # full comparison: all blocks that begin with a word of the template
    full = pairs.join(table.select("row", "n_words", "hits"), "row").join(_bounded(sets, len(templates)), "template")
    full = full.withColumn("own", F.filter("hits", lambda h: F.array_contains("near", F.floor(h["at"] / F.col("reach"))) & F.array_contains("set", h["word"])))

    def block(h: Column, i: Column) -> Column:
        inside = F.filter(F.slice("own", i + 1, F.col("reach")), lambda x: x["at"] < h["at"] + F.col("reach"))
        held = F.when(F.size(inside) >= F.col("need"), F.array_distinct(F.transform(inside, lambda x: x["word"])))
        named = F.size(F.array_except("names", held)) == 0
        n = F.least(F.col("reach"), F.col("n_words") - h["at"])
        return F.when((F.size(held) >= F.col("need")) & named, F.struct(
            "template", "label", h["at"].cast("long").alias("first_word"), n.cast("long").alias("n_words"), F.size(held).alias("held"), (F.size(held) / F.col("size")).alias("containment"),
        ))

    found = full.select("row", F.filter(F.transform("own", block), lambda b: b.isNotNull()).alias("blocks")).filter(F.size("blocks") > 0)
    found = space.write(found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("blocks"))).cast(BLOCKS).alias("blocks")), "blocks")

    in_phrases = sorted({w for p in phrases for w in p.split()})
    judged = table.withColumn("told", F.filter("hits", lambda h: h["word"].isin(in_phrases)))
    for i, phrase in enumerate(phrases):
        judged = judged.withColumn(f"p{i}", _phrase_starts(phrase.split()))
    starts = [F.col(f"p{i}") for i in range(len(phrases))]
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(starts, phrases.values())], F.lit(None).cast("string")))
    judged = judged.select("row", "doc_id", "n_words", F.flatten(F.array(F.array().cast("array<int>"), *starts)).alias("places"), F.array_distinct(base).alias("base"))
    judged = judged.join(found, "row", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(BLOCKS)))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return judged.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("blocks", lambda b: b["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), "blocks",
    )


def oracle_sql(phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, stretch: float = STRETCH) -> str:
    """The scan without any filter: each word of a template in a document, with the distinct words within reach."""
    phrases = PHRASES if phrases is None else phrases
    rows = ", ".join(f"({i}, '{label}', '{w}', {names}, {size}, {need}, {reach})" for i, label, w, names, size, need, reach in template_rows(templates, threshold, stretch))
    cases = " UNION ALL ".join(
        f"SELECT n, '{label}' AS label, i - 1 AS place FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE "
        + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in phrases.items()
    )
    return f"""
WITH w AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
     t(template, label, word, names, size, need, reach) AS (VALUES {rows}),
     h AS (SELECT n, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM w),
     o AS (SELECT n, pos, h.word, t.* EXCLUDE (word) FROM h JOIN t ON h.word = t.word),
     c AS (SELECT n, template, label, size, need, count(DISTINCT word) OVER b AS held, count(DISTINCT CASE WHEN names THEN word END) OVER b AS named
           FROM o WINDOW b AS (PARTITION BY n, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND (reach - 1) FOLLOWING)),
     m AS (SELECT template, count(*) FILTER (names) AS names FROM t GROUP BY template),
     k AS (SELECT n, label, held / size AS c FROM c JOIN m USING (template) WHERE held >= need AND named = names),
     p AS ({cases}),
     pa AS (SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY n),
     la AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM k UNION SELECT n, label FROM p) GROUP BY n),
     sc AS (SELECT n, max(c) AS score FROM k GROUP BY n)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN pa USING (n) LEFT JOIN la USING (n) LEFT JOIN sc USING (n)
"""

"""License scans: phrases, and an exact set-similarity join of text blocks with license templates, with Spark's own functions only.

Texts are cut into blocks at blank lines and sentence ends, so a wrapped notice is one block; a block is the set of its words. A template's containment in a block is
the share of the template's distinct words that the block holds. The join returns every pair of block and template that reaches
the threshold. Only words of templates can count, so blocks keep these alone, ordered by their frequency over the whole corpus,
rarest first. Of a template with n words, of which c must be met, one of the first n - c + 1 is in every matching block, and it
is among the block's own first |b| - c + 1 (prefix filter); a block of less than c such words cannot match (length filter); and
a first common word at place i of the template and j of the block leaves at most 1 + min(n - i, |b| - j) common ones (positional
filter). What passes is verified on the whole sets. Equal blocks are joined once.

Notices of related licences share most of their words. So a match gives its label only where the block holds all the words that
the label demands and the template has ("lesser") and none that it bars ("affero", another version): NAMES has both by label.

Base phrases stand as consecutive words; their places are counted one by one. A null text counts as empty: no words, no labels,
score 0. The score is 1 where a phrase stands, else the largest containment of a matched template, else 0. Each row of the input
gives a row; rows that share an id but not a text get their own results, equal rows equal ones; null ids are kept. Templates with
a null label or text take no part, nor do those without words; repeated ones count once. An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label and wording of license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words that a block must hold for a label's templates that have them, and words that bar it: what tells a licence from its relatives.
NAMES = {
    "mit": (("mit", "released"), ()),
    "apache": (("apache",), ()),
    "gpl": (("gnu",), ("lesser", "affero")),
    "gpl-3.0": (("gnu", "3"), ("lesser", "affero", "1", "2")),
    "lgpl": (("lesser",), ("affero",)),
    "agpl": (("affero",), ("lesser",)),
    "apache-2.0": (("apache", "2"), ("1",)),
    "mpl": (("mozilla",), ()),
    "cc-by": (("cc", "creative"), ("nc", "noncommercial", "nd", "noderivatives", "sa", "sharealike")),
    "cc-by-nc": (("nc",), ()),
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"(?:\r\n|\n|\r(?!\n))(?:[ \t\x0B\f]*(?:\r\n|\n|\r(?!\n)))+|(?<=[.!?;])\s+"
MOST_TEMPLATE_WORDS = 20_000


def words_of(text: str) -> list[str]:
    low = text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return [w for w in re.split(SEPARATORS, low) if w]


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(norm: Column, n: Column, phrases: dict[str, str]) -> Column:
    """For each phrase: label, number of places, first and last start; norm has one space before and after every word."""

    def one(phrase: str, label: str) -> Column:
        parts = F.split(norm, f" {phrase}(?= )", -1)
        size = len(phrase.split())
        found = F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), spaces(F.get(parts, F.lit(0))).cast("long").alias("first"), (n - spaces(F.element_at(parts, -1)) + 1 - size).cast("long").alias("last"))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), found)

    return F.array_compact(F.array(*(one(p, l) for p, l in phrases.items())))


def scan(docs: DataFrame, vocabulary: list[str], least: int, phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """One row a row: id, version (of the text), n_words, places of phrases, blocks with `least` words of the vocabulary or more, and the numbers (from 1) of the vocabulary's words in the text."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    df = df.select("id", F.xxhash64("text").alias("version"), F.translate("text", ascii_uppercase, ascii_lowercase).alias("low"))
    flat = F.concat(F.lit(" "), F.regexp_replace("low", SEPARATORS, " "), F.lit(" "))
    df = df.withColumn("norm", F.regexp_replace(flat, "  +", " "))
    df = df.withColumn("n", F.when(F.col("norm") == " ", 0).otherwise(spaces(F.col("norm")) - 1).cast("long"))
    own = F.array(*(F.lit(w) for w in vocabulary)) if vocabulary else F.array().cast("array<string>")
    blocks = F.transform(F.split("low", BLOCK_END, -1), lambda b: F.array_intersect(F.split(b, SEPARATORS, -1), own))
    df = df.select("id", "version", "n", phrase_places(F.col("norm"), F.col("n"), phrases).alias("places"), blocks.alias("every"))
    known = F.transform(F.array_distinct(F.flatten("every")), lambda w: F.array_position(own, w).cast("int"))
    # a text with no block of `least` known words cannot match; most blocks go here
    return df.select("id", "version", "n", "places", F.filter("every", lambda b: F.size(b) >= least).alias("blocks"), known.alias("known"))


def frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Of scanned rows, the number of texts that hold each word; at most a row for each word of the vocabulary."""
    counts = rows.select(F.explode("known").alias("k")).groupBy("k").count().collect()
    return {vocabulary[r["k"] - 1]: r["count"] for r in counts}


def containment_join(blocks: DataFrame, templates: list[tuple[str, list[str]]], threshold: float, names: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None) -> DataFrame:
    """set, label, score of every match; blocks: set (an array of distinct words, ordered rarest first); templates: words ordered likewise.

    names: by label, words that a block must hold if the template has them, and words that bar it.
    """
    told = {l: (names or {}).get(l, ((), ())) for l, _ in templates}
    spark = blocks.sparkSession
    need = lambda n: -int(-threshold * n // 1)
    prefix = [(w, k, i + 1) for k, (_, ws) in enumerate(templates) for i, w in enumerate(ws[: len(ws) - need(len(ws)) + 1])]
    index = spark.createDataFrame(prefix, "word string, template int, i int")
    whole = spark.createDataFrame([(k, l, ws, len(ws), need(len(ws)), [w for w in told[l][0] if w in ws], list(told[l][1])) for k, (l, ws) in enumerate(templates)], "template int, label string, words array<string>, n int, c int, must array<string>, bars array<string>")
    index = index.join(whole, "template")
    least = min(need(len(ws)) for _, ws in templates)
    first = F.slice("set", F.lit(1), F.size("set") - least + 1)
    tokens = blocks.where(F.size("set") >= least).select("set", F.posexplode(first).alias("j", "word"))
    met = tokens.join(F.broadcast(index), "word")  # at most MOST_TEMPLATE_WORDS rows, checked by scan_licenses
    size = F.size("set")
    may = met.where((size >= F.col("c")) & (F.col("j") < size - F.col("c") + 1) & (1 + F.least(F.col("n") - F.col("i"), size - F.col("j") - 1) >= F.col("c")))
    common = F.size(F.array_intersect("set", "words"))
    named = (F.size(F.array_except("must", "set")) == 0) & (F.size(F.array_intersect("bars", "set")) == 0)
    return may.where((common >= F.col("c")) & named).groupBy("set", "label").agg(F.max(common / F.col("n")).alias("score"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, phrases: dict[str, str] | None = None, names: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    sets = sorted({(l, tuple(sorted(set(words_of(t))))) for l, t in (TEMPLATES if templates is None else templates) if l is not None and t is not None and words_of(t)})
    names = NAMES if names is None else names
    vocabulary = sorted({w for _, ws in sets for w in ws} | {w for pair in names.values() for ws in pair for w in ws})
    if sum(len(ws) for _, ws in sets) > MOST_TEMPLATE_WORDS or len(vocabulary) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words")
    least = min((-int(-threshold * len(ws) // 1) for _, ws in sets), default=1)
    rows = written(scan(docs, vocabulary, least, PHRASES if phrases is None else phrases, id_col, text_col), "licenses-scanned")
    shape = "id {}, version long, found array<struct<label:string,score:double>>".format(rows.schema["id"].dataType.simpleString())
    found = docs.sparkSession.createDataFrame([], shape)
    if sets:
        n = frequencies(rows, vocabulary)  # at most MOST_TEMPLATE_WORDS rows
        order = sorted(vocabulary, key=lambda w: (n.get(w, 0), w))
        ranked = F.array(*(F.lit(w) for w in order))
        blocks = rows.select("id", "version", F.explode("blocks").alias("block")).select("id", "version", F.array_intersect(ranked, "block").alias("set")).distinct()
        blocks = written(blocks, "licenses-blocks")
        place = {w: k for k, w in enumerate(order)}
        matches = written(containment_join(blocks.select("set").distinct(), [(l, sorted(ws, key=place.__getitem__)) for l, ws in sets], threshold, names), "licenses-matches")
        # a notice may stand in a third of all texts; adaptive execution splits this join
        labels = matches.groupBy("set").agg(F.collect_list(F.struct("label", "score")).alias("labels"))  # at most one for each label
        pairs = blocks.join(written(labels, "licenses-labels"), "set").select("id", "version", F.inline("labels"))
        found = pairs.groupBy("id", "version", "label").agg(F.max("score").alias("score")).groupBy("id", "version").agg(F.collect_list(F.struct("label", "score")).alias("found"))
    found = found.withColumnsRenamed({"id": "id_", "version": "version_"})
    out = rows.drop("blocks", "known").join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("version") == F.col("version_")), "left")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.coalesce(F.transform("found", lambda p: p["label"]), F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda p: p["score"])), F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The query in SQL: every block against every template, every word against every phrase."""

    def listed(words: list[str] | tuple[str, ...]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"

    sets = sorted({(l, tuple(sorted(set(words_of(t))))) for l, t in TEMPLATES})
    rows = ", ".join(f"('{l}', {listed(ws)}, {len(ws)}, {-int(-0.8 * len(ws) // 1)}, {listed([w for w in NAMES.get(l, ((), ()))[0] if w in ws])}, {listed(NAMES.get(l, ((), ()))[1])})" for l, ws in sets)
    phrases = ", ".join(f"('{l}', {listed(p.split())}, {len(p.split())})" for p, l in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
phrases(label, phrase, size) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + size] = phrase)) AS place FROM w, phrases WHERE contains(low, phrase[1])),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates(label, words, n, need, must, bars) AS (VALUES {rows}),
blocks AS (SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(unnest(regexp_split_to_array(regexp_replace(replace(replace(low, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([.!?;])\s+', '\1' || chr(10) || chr(10), 'g'), '\n([ \t\x0B\x0C]*\n)+')), '{word}')) AS own FROM w),
found AS (SELECT doc_id, label, max(len(list_intersect(own, words)) / n) AS score FROM blocks, templates WHERE len(own) >= need AND len(list_intersect(own, words)) >= need AND list_has_all(own, must) AND NOT list_has_any(own, bars) GROUP BY ALL),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.score, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""


SQL = sql()

"""License scans by diagonal voting, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

def _but(letters: str) -> str:
    """A run of what isn't ASCII but the digits and these letters. The separators stand one by one: Java looks such a class up
    in a table, where ranges are tried in turn."""
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in "0123456789" + letters) + "]+"


#: Words of a lower-cased text, and of any.
WORDS, ANY_CASE = _but(LOWER), _but(LOWER + UPPER)
#: The phrases asked for, and phrases of common licenses.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-3.0-named": "this work is licensed under the gnu general public license version 3",
    "apache-2.0-named": "licensed under the apache license version 2 0",
    "mit-named": "released under the mit license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "copyright-notice": "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
#: Pairs of two of these are no anchors.
FUNCTION_WORDS = "a an and any are as at by for in is it may of or such that the this to with you".split()
#: Neighbouring diagonals are merged within so many words; a span counts if it holds so large a share of the template's anchors.
GAP, SHARE = 3, 0.5


def folded(text: Column) -> Column:
    """Lower case for matching ASCII phrases. lower() is much faster than translating A-Z; the two characters whose lower case
    holds an ASCII letter, U+0130 and U+212A, must not become one, so texts that have them are translated."""
    return F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def template_grams(spark: SparkSession, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(gram, left, right, label, exact, at, anchors): the word pairs of all templates. Its size is that of the templates, a parameter."""
    rows = []
    for exact, table in ((True, base), (False, templates)):
        for label, text in table.items():
            words = text.split()
            if len(words) < 2:
                raise ValueError("a template has two words at least")
            grams = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if exact or a not in FUNCTION_WORDS or b not in FUNCTION_WORDS]
            rows += [(a, b, label, exact, i, len(grams)) for i, a, b in grams]
    if len(rows) > 100_000:
        raise ValueError("templates are broadcast; 100,000 word pairs at most")
    return spark.createDataFrame(rows, "left string, right string, label string, exact boolean, at int, anchors int").withColumn("gram", F.xxhash64("left", "right"))


def license_hits(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs (doc_id, rk, text) -> (doc_id, rk, label, exact, first, last, share), a row for each verified span of a template.

    All rolling pairs of words meet the template pairs by hash (words are compared too); votes are counted by template and
    diagonal, the place in the text less the place in the template. An exact template needs all its pairs on one diagonal,
    which are then the whole phrase. Otherwise neighbouring diagonals at most GAP apart are one span: insertions and deletions move
    the diagonal; and diagonals so near are near in place, too, as a place is at most a template's length after its
    diagonal. A span is kept if it holds SHARE of the template's anchors. Neighbours are compared in the order of diagonals, so a text
    costs its votes and their sort.
    """
    words = F.regexp_extract_all(folded(F.col("text")), F.lit(WORDS), F.lit(0))
    rows = docs.select("doc_id", "rk", words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b")))
    rolling = rows.where(F.size("w") > 1).select("doc_id", "rk", F.posexplode(pairs).alias("place", "p")).select("doc_id", "rk", "place", F.col("p.gram").alias("gram"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    grams = F.broadcast(template_grams(docs.sparkSession, base, templates))
    met = rolling.join(grams, "gram").where((F.col("a") == F.col("left")) & (F.col("b") == F.col("right")))
    key = ["doc_id", "rk", "label"]
    # rows that repeat vote once: distinct places
    votes = staged(met.groupBy(*key, "exact", "anchors", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("place").alias("lo"), F.max("place").alias("hi")), "votes")
    whole = votes.where("exact AND size(ats) = anchors").select(*key, "exact", F.col("diagonal").cast("long").alias("first"), F.col("diagonal").cast("long").alias("last"), F.lit(1.0).alias("share"))

    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > GAP
    runs = votes.where("NOT exact").withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    anchored = runs.groupBy(*key, "run").agg(F.min("lo").cast("long").alias("first"), F.max("hi").cast("long").alias("last"), F.first("anchors").alias("anchors"))
    # distinct anchors of a run, counted and not gathered: a long text may repeat them often
    held = runs.select(*key, "run", F.explode("ats").alias("anchor")).distinct().groupBy(*key, "run").agg(F.count("*").alias("held"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, "run")]
    spans = anchored.alias("l").join(held.alias("r"), same).select(*(f"l.{c}" for c in key), F.lit(False).alias("exact"), "first", "last", (F.col("held") / F.col("anchors")).alias("share"))
    return whole.unionByName(spans.where(F.col("share") >= SHARE))


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base, first_word and last_word count and bound the places of the base phrases; score is the largest share of a
    template's anchors that a span holds, 0 without a span. Null and empty texts: 0 words, empty labels, null places. Null
    ids are scanned like others. Rows that repeat get the same result each; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rk"), text.alias("text"))
    hits = license_hits(rows, base, templates)
    at = lambda c: F.when(F.col("exact"), F.col(c))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = hits.groupBy(F.col("doc_id").alias("h_id"), F.col("rk").alias("h_rk")).agg(F.count(at("first")).alias("n_base"), F.min(at("first")).alias("first_word"), F.max(at("last")).alias("last_word"), labels(at("label")).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max("share").alias("score"))
    every = rows.select("doc_id", "rk", F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("rk") == F.col("h_rk")), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", blank("base_labels"), blank("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))

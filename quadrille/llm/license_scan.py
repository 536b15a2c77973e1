"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a text whose letters A to Z are still in either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that must stand word for word.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices on neighbouring diagonals: the words, and runs of them that must stand whole (name and version).
NOTICES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license", "2 0"]),
        ("you may not use this file except in compliance with the license", []),
    ],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted", [])],
    "cc-by-nc-4.0": [
        ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
        ("creative commons attribution noncommercial 4 0 international", ["attribution noncommercial", "4 0"]),
    ],
    "cc-by-4.0": [
        ("licensed under cc by 4 0", ["cc by 4 0"]),
        ("creative commons attribution 4 0 international", ["attribution 4 0"]),
    ],
    "gpl-3.0": [
        ("licensed under the gnu general public license version 3", ["public license", "version 3"]),
        ("this program is free software you can redistribute it and or modify it", []),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software", []),
    ],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"])],
}

Notices = dict[str, list[tuple[str, list[str]]]]


def lowered(word: Column) -> Column:
    """A word with A to Z in lower case: lower() of a word of ASCII; others equal no template's word in either case."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(word)


def words_of(text: Column) -> Column:
    """The words of a text as they stand; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def _templates(phrases: dict[str, str], notices: Notices, k: int, coverage: float) -> tuple[list[tuple], list[tuple]]:
    """Places (gram, template, at, bit) and templates (template, label, parts, least, key, exact): `least` grams must
    be found, and all in the mask `key`."""
    places, kinds = [], []
    for label, text, keys, exact in [*((a, b, [], True) for a, b in phrases.items()), *((a, t, x, False) for a, b in notices.items() for t, x in b)]:
        words = text.split(" ")
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        if not 1 <= len(grams) <= 63:
            raise ValueError(f"a template has {k} to {62 + k} words: {text}")
        mask = 0
        for x in keys:
            own = x.split(" ")
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            for i in range(at, at + len(own) - k + 1):
                mask |= 1 << i
        # a word more costs k - 1 grams, a word changed or left out k
        least = len(grams) if exact else min(len(grams) - k, math.ceil(coverage * len(grams)))
        places += [(gram, len(kinds), i, 1 << i) for i, gram in enumerate(grams)]
        kinds.append((len(kinds), label, len(grams), max(1, least), mask, exact))
    return places, kinds


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A local table of so many rows as are written here."""
    literal = lambda x: "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}L" if x.bit_length() > 31 else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names})")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: Notices = NOTICES, k: int = 2, slack: int = 2, coverage: float = 0.85) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Every run of k words of every text is hashed and joined to the places of the templates (a broadcast table of
    a fixed number of rows).  Hashes have 64 bits, and only those of the templates' few hundred runs could be met by
    chance.  A hit votes for its diagonal, place in text less place in template; votes of diagonals at most `slack` apart are merged, so a word more or less breaks
    no span.  A span of a notice is verified by its runs: name and version whole, and of the others as many
    as one word changed, left out or put in leaves, or `coverage` of them if that is fewer; a phrase by all of
    it on one diagonal.  score: the best share of a verified span's runs, else 0.

    Null or empty text: no words and no labels; so too of an empty table, no rows.  A text of any length is one row's
    array of words.  Equal rows are scanned as one and returned as often as they stand; other
    columns are not read, so their names do not matter; an id of any type, or null, stays as it is."""
    spark = docs.sparkSession
    places, kinds = _templates(phrases, notices, k, coverage)
    # a run with the number 0 marks a document, so that one without hits stays
    spots = _values(spark, [*places, ("", -1, 0, 0)], "_gram, _template, _at, _bit")
    rolling = F.xxhash64(F.get(F.split("_gram", " "), F.lit(0)))
    for i in range(1, k):
        rolling = F.xxhash64(rolling, F.xxhash64(F.get(F.split("_gram", " "), F.lit(i))))
    spots = spots.withColumn("_h", F.when(F.col("_template") < 0, F.lit(0).cast("long")).otherwise(rolling))
    kind = _values(spark, kinds, "_template, _label, _parts, _least, _key, _exact")
    # only hashes of words leave the projection: rows with the words, one for each run, would grow with the square of a text
    listed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_th"), F.transform(words_of(F.col(text_col)), lambda x: F.xxhash64(lowered(x))).alias("_g"))
    grams, size = F.col("_g"), F.size("_g")
    for i in range(1, k):  # the hash of a run goes on from that of its first words; what runs over the end meets nothing
        grams = F.zip_with(grams, F.slice("_g", F.lit(i + 1), F.greatest(size - i, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    # outer: no test of the size is inferred and pushed below the projection, where it would make all words again
    marked = listed.select("doc_id", "_th", size.cast("long").alias("_words"), F.concat(F.array(F.lit(0).cast("long")), grams).alias("_g"))
    rolled = marked.select("doc_id", "_th", "_words", F.posexplode_outer("_g").alias("_pos", "_h"))
    hits = rolled.join(F.broadcast(spots), "_h").where((F.col("_template") < 0) == (F.col("_pos") == 0))
    key = ["doc_id", "_th"]
    votes = hits.groupBy(*key, "_template", (F.col("_pos") - 1 - F.col("_at")).alias("_diagonal")).agg(F.bit_or("_bit").alias("_seen"), F.max("_words").alias("_n"), F.count("*").alias("_copies"))
    by_place = Window.partitionBy(*key, "_template").orderBy("_diagonal")
    told = votes.join(F.broadcast(kind), "_template", "left")
    far = F.col("_diagonal") - F.lag("_diagonal").over(by_place)
    spans = told.withColumn("_new", F.when(F.col("_exact") | far.isNull() | (far > slack), 1).otherwise(0)).withColumn("_span", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*key, "_template", "_span").agg(F.bit_or("_seen").alias("_seen"), F.min("_diagonal").alias("_begin"), F.max("_n").alias("_n"), F.max("_copies").alias("_copies"))
    judged = merged.join(F.broadcast(kind), "_template", "left").withColumn("_found", F.bit_count("_seen"))
    good = F.coalesce((F.col("_found") >= F.col("_least")) & (F.col("_seen").bitwiseAND(F.col("_key")) == F.col("_key")), F.lit(False))
    base = good & F.col("_exact")
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("_label")))), ",")
    scanned = judged.groupBy(*key).agg(
        F.max("_n").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("_begin"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("_begin"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(good).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("_found") / F.col("_parts"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("_template") < 0, F.col("_copies"))).cast("int").alias("_copies"),
    )
    return scanned.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_th", "_copies", "_copy")

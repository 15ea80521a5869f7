"""License scans by an exact set-similarity join (operator 7).

Templates are sets of words; a text block starts at a template word and runs
up to ``block_words`` of the template's length, so that a notice with words put
in stays whole.  A word that only a larger template has (``nc`` of cc-by-nc,
whose words include those of cc-by) ends a block that is longer than the
template.  A block meets a template if it holds at least
``THRESHOLD`` of its words.  Words are ordered by their frequency over the
whole corpus, rarest first.  With ``need`` words required of ``size``:

* prefix filter: a meeting block holds one of the ``size - need + 1`` rarest
  words of the template, so only texts with such a word are looked at;
* length filter: the text must hold ``need`` different words of the template;
* positional filter: if a block's rarest template word has rank r (from 0), it
  can hold at most ``size - r`` words of the template;
* what is left is counted exactly.

Base places (fixed phrases) come from the same pass over the words.

Defined results: a null or wordless text has no words, places or labels and
scores 0; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, whole_text

# fixed values: base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: notices by label
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file "
               "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.85
#: Words that a block may have beyond a template's length over the threshold.
SLACK_WORDS = 4

#: ASCII letters in lower case, digits, and every byte of other characters stay; the rest breaks words.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def block_words(length: int, threshold: float) -> int:
    """Words of the longest block: the length over the threshold, at most twice
    the length, and a few more, which matter for short templates."""
    return math.ceil(length / max(threshold, 0.5) - 1e-9) + SLACK_WORDS


def scan_words(text: str, phrases: dict[str, str], vocabulary: dict[bytes, int]):
    """(number of words, [(place, label)], word positions and numbers of the
    vocabulary words) of one text."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    at, which = [], []
    for i, number in enumerate(map(vocabulary.get, words)):
        if number is not None:
            at.append(i)
            which.append(number)
    places = []
    flat = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        place, last, found = 0, 0, flat.find(wanted)
        while found >= 0:
            # counted on from the place before, so long texts take linear time
            place += flat.count(b" ", last, found)
            places.append((place, label))
            last, found = found, flat.find(wanted, found + 1)
    return len(words), places, at, which


def _words(docs: DataFrame, id_col: str, text_col: str, phrases, vocabulary) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [scan_words(t, phrases, vocabulary) for t in batch["_text"]]
            yield pd.DataFrame({
                "_id": batch["_id"], "n_words": [o[0] for o in out],
                "n_base": [len(o[1]) for o in out],
                "first_word": pd.array([min((p for p, _ in o[1]), default=None) for o in out], dtype="Int64"),
                "last_word": pd.array([max((p for p, _ in o[1]), default=None) for o in out], dtype="Int64"),
                "_base": [sorted({label for _, label in o[1]}) for o in out],
                "_at": [o[2] for o in out], "_word": [o[3] for o in out]})

    slim = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return slim.mapInPandas(rows, (
        f"_id {slim.schema['_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, _base array<string>, _at array<int>, _word array<int>"))


def template_blocks(rows: DataFrame, templates, threshold: float) -> DataFrame:
    """(_row, label, share): the best block of each template and text that
    meets the threshold.  ``rows`` has _row, _at and _word."""
    spark = rows.sparkSession
    # one count per vocabulary word comes back
    counts = dict(rows.select(F.explode("_word").alias("w")).groupBy("w")
                  .agg(F.count(F.lit(1)).alias("n")).collect())
    index, prefix = [], set()
    blocks = []
    for label, numbers, length in templates:
        ends = {w for _, other, _ in templates if set(numbers) < set(other) for w in other} - set(numbers)
        blocks.append((label, numbers, block_words(length, threshold), ends))
        if ends:
            blocks.append((label, numbers, length, set()))
    for t, (label, numbers, length, ends) in enumerate(blocks):
        ordered = sorted(numbers, key=lambda w: (counts.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        for rank, w in enumerate(ordered):
            index.append((w, t, label, rank, len(ordered), need, length, w))
        index += [(w, t, label, None, len(ordered), need, length, None) for w in sorted(ends)]
        prefix.update(ordered[:len(ordered) - need + 1])
    table = spark.createDataFrame(index, "w int, t int, label string, rank int, size int, need int, span int, own int")
    may = rows.select("_row", "_at", "_word").filter(
        F.exists("_word", lambda w: w.isin(*sorted(prefix))))
    hits = may.select("_row", F.explode(F.arrays_zip("_at", "_word")).alias("h")).select(
        "_row", F.col("h._at").alias("at"), F.col("h._word").alias("w"))
    # the table has one row per template word
    hits = hits.join(F.broadcast(table), "w")
    text = Window.partitionBy("_row", "t")
    # words that end a block have no number of their own; their part begins with them
    hits = hits.withColumn("_have", F.size(F.collect_set("own").over(text))).filter("_have >= need")
    hits = hits.withColumn("_part", F.sum(F.col("own").isNull().cast("int")).over(text.orderBy("at")))
    found = None
    for span in sorted({length for _, _, length, _ in blocks}):
        block = Window.partitionBy("_row", "t", "_part").orderBy("at").rangeBetween(0, span - 1)
        own = (hits.filter(F.col("span") == span)
               .withColumn("_rarest", F.min("rank").over(block))
               .withColumn("_held", F.size(F.collect_set("own").over(block)))
               .filter((F.col("_rarest") <= F.col("size") - F.col("need")) & (F.col("_held") >= F.col("need")))
               .select("_row", "label", (F.col("_held") / F.col("size")).alias("share")))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("_row", "label").agg(F.max("share").alias("share"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with base places and all labels."""
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, t in templates for w in t.encode().split()}))}
    numbered = [(label, sorted({vocabulary[w] for w in t.encode().split()}), len(t.split()))
                for label, t in templates]
    rows = saved(_words(docs, id_col, text_col, phrases, vocabulary)
                 .withColumn("_row", F.monotonically_increasing_id()))
    met = template_blocks(rows, numbered, threshold).groupBy("_row").agg(
        F.collect_set("label").alias("_met"), F.max("share").alias("_share"))
    out = rows.drop("_at", "_word").join(met, "_row", "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_met", F.array().cast("array<string>"))))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))

"""License scans by diagonal voting.

All rolling word k-grams of all documents are joined by hash to the k-grams of the license templates: pairs for the
short base phrases, runs of four words for license notices. A joined row votes for the diagonal (place in the document
minus place in the template). Votes are counted for each diagonal, neighbouring diagonals are merged, so that
inserted or missing words do no harm, and the merged span is verified by the distinct template words that it covers:
a phrase stands where one diagonal has all its places; a notice counts where few of its words are not covered. Where
notices that share most of their words are found in one place, the one that is covered best counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and labels: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of common licenses (fixed texts, in words), with labels of the method's own.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "this work is licensed under the creative commons attribution": "cc",
}
#: Words of a gram, of phrases and of notices. A template has at most 63 words, one bit each.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Words of a notice that may be uncovered, at least and as a share; how far above a diagonal others are merged with it.
MISSING, MISSING_SHARE, NEIGHBOURS = 4, 0.2, 40

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_GRAM = "template int, label string, base boolean, grams int, words int, family int, place int, ta string, tb string, tc string, td string"


def families() -> list[int]:
    """For each notice the first that it shares at least half of its grams with, itself included."""
    grams = [{tuple(w[i : i + NOTICE_GRAM]) for i in range(len(w) - NOTICE_GRAM + 1)} for w in (t.split(" ") for t in TEMPLATES)]
    return [next(j for j, other in enumerate(grams) if 2 * len(own & other) >= min(len(own), len(other))) for own in grams]


def _templates(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template, a fixed list; and a mark that stands for the end of a document."""
    rows = [(-1, None, False, 0, 0, -1, 0, "", "", None, None)]
    family = [*range(len(PHRASES)), *(len(PHRASES) + f for f in families())]
    for i, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        words, base = text.split(" "), i < len(PHRASES)
        k = PHRASE_GRAM if base else NOTICE_GRAM
        for p in range(len(words) - k + 1):
            rows.append((i, label, base, len(words) - k + 1, len(words), family[i], p, *words[p : p + k], *[None] * (4 - k)))
    grams = spark.createDataFrame(rows, _GRAM)
    return grams.withColumn("th", F.when(F.col("tc").isNull(), F.xxhash64("ta", "tb")).otherwise(F.xxhash64("ta", "tb", "tc", "td")))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their first and last
    start), base_labels, labels (base and method's, sorted, comma-joined), score (largest covered share of a template).

    docs: doc_id, text (null: empty); other columns are left out. Words are runs of ASCII digits, ASCII letters in
    lower case and any other characters beyond ASCII. Rows that repeat each give a row; a null doc_id stays null.
    Documents without a hit have n_base 0, null first_word and last_word, empty labels and score 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the two characters beyond ASCII whose lower case holds an ASCII letter stay what they are
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    lower = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    own = own.withColumn("n_words", F.size("w").cast("long"))
    # grams from each word on, and last a mark that keeps documents without hits; "" stands beyond the end
    after = lambda i: F.concat(F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))), F.array(*[F.lit("")] * (i + 1)))
    zipped = F.arrays_zip(*(after(i).alias(c) for i, c in enumerate("abcd")))
    grams = own.select("doc_id", "tag", "n_words", F.posexplode(zipped).alias("at", "g")).select("doc_id", "tag", "n_words", "at", "g.a", "g.b", "g.c", "g.d")
    grams = grams.withColumn("h", F.explode(F.array(F.xxhash64("a", "b"), F.xxhash64("a", "b", "c", "d"))))
    # a fixed list: broadcast whatever the input
    templates = F.broadcast(_templates(spark))
    same = (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("tc").isNull() | ((F.col("c") == F.col("tc")) & (F.col("d") == F.col("td"))))
    votes = grams.join(templates, (F.col("h") == F.col("th")) & same)
    document = ["doc_id", "tag", "n_words"]
    lines = votes.groupBy(*document, "template", "label", "base", "grams", "words", "family", (F.col("at") - F.col("place")).cast("long").alias("diagonal")).agg(
        F.count("*").alias("votes"), F.bit_or(F.expr("shiftleft(1L, place)")).alias("places")
    )
    # rows that repeat vote together: the mark has one vote for each of them
    copies = F.max(F.when(F.col("template") == -1, F.col("votes"))).over(Window.partitionBy(*document))
    lines = lines.withColumn("copies", copies).withColumn("votes", F.expr("votes div copies"))
    near = Window.partitionBy(*document, "template").orderBy("diagonal").rangeBetween(0, NEIGHBOURS)
    held = F.expr("places | shiftleft(places, 1)")
    held = F.when(F.col("base"), held).otherwise(F.expr("places | shiftleft(places, 1) | shiftleft(places, 2) | shiftleft(places, 3)"))
    lines = lines.withColumn("held", held).withColumn("covered", F.bit_count(F.bit_or("held").over(near)))
    whole = F.col("base") & (F.col("votes") == F.col("grams"))
    share = F.when(F.col("words") > 0, F.col("covered") / F.col("words")).otherwise(0.0)
    enough = ~F.col("base") & (F.col("words") > 0) & (F.col("words") - F.col("covered") <= F.greatest(F.lit(MISSING), F.floor(F.col("words") * MISSING_SHARE)))
    place = Window.partitionBy(*document, "family").orderBy("diagonal").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    lines = lines.withColumn("share", share).withColumn("enough", enough).withColumn("best", F.max(F.when(F.col("enough"), F.col("share"))).over(place))
    share, found = F.col("share"), whole | (F.col("enough") & (F.col("share") >= F.col("best")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = lines.groupBy(*document, "copies").agg(
        F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("diagonal"))).alias("first_word"), F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"), joined(F.when(found, F.col("label"))).alias("labels"), F.max(share).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("score").cast("double").alias("score"))

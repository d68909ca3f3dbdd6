"""License scans by diagonal voting, in SQL functions only.

Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text. Every rolling GRAM-word gram of every document
is hashed and joined with the positions of the same gram in the license templates (a stated list, a few kilobytes,
so broadcast); the join also compares the grams themselves, so that a hash collision gives no vote. A hit at word p
of a document and word q of a template votes for the diagonal p - q. Votes are summed by (document, template,
diagonal), diagonals at most GAP apart are merged (an inserted or dropped word moves a match to the next one), and
each merged span is verified: the template words under its hits, over the template's length or, if that is more, the
span's own. So a span that drifts, with foreign words in between, loses. Spans with a share of MIN_SCORE or more give
their label.

Defined cases: null and empty texts have no words and no labels; fewer than GRAM words give base phrases only;
repeated rows get the same result each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_az, row_key

GRAM = 3
GAP = 3
MIN_SCORE = 0.8
#: Grams of all templates, which are broadcast.
MAX_GRAMS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the task and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of public license texts and common license lines, with the label of each.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def scan_words(text: Column) -> Column:
    """The words of the scan as an array; null gives an empty one."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: F.length(w) > 0)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """t, label, n (words of the template), q (position), gram, h: a row for each gram of each template."""
    rows = [f"({t}, '{label}', {len(w)}, {q}, '{' '.join(w[q : q + k])}')" for t, (label, text) in enumerate(templates) for w in [text.split()] for q in range(len(w) - k + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"the templates have {len(rows)} grams, more than the {MAX_GRAMS} that are broadcast")
    if not rows:
        return spark.sql("SELECT 0 AS t, '' AS label, 0 AS n, 0 AS q, '' AS tgram, 0L AS th WHERE false")
    return spark.sql(f"SELECT *, xxhash64(tgram) AS th FROM VALUES {', '.join(rows)} AS g(t, label, n, q, tgram)")


def phrase_places(words: Column, phrase: str) -> Column:
    """Places, counted from 0, where the phrase's words stand consecutively."""
    p = phrase.split()
    # filter() visits every word natively; only texts that hold the phrase's last word get this far
    at = F.transform(words, lambda w, i: F.when(w == p[-1], i))
    ends = F.filter(at, lambda i: i.isNotNull() & (i >= len(p) - 1))
    hit = lambda i: [words[i - (len(p) - 1) + j] == p[j] for j in range(len(p) - 1)]

    def fits(i: Column) -> Column:
        out = F.lit(True)
        for c in hit(i):
            out = out & c
        return out

    found = F.transform(F.filter(ends, fits), lambda i: i - (len(p) - 1))
    return F.when(F.array_contains(words, p[-1]), found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, gap: int = GAP) -> DataFrame:
    """Verified spans: doc_id, __gl_key, label, template, first_word, last_word, score."""
    grams = template_grams(docs.sparkSession, templates, k)
    words = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("__gl_key"), scan_words(F.col(text)).alias("w"))
    rolling = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", *[F.col("w")[i + j] for j in range(k)])))
    placed = words.select("doc_id", "__gl_key", F.posexplode(rolling).alias("p", "gram")).withColumn("h", F.xxhash64("gram"))
    hits = placed.join(F.broadcast(grams), (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")))
    key = ["doc_id", "__gl_key", "t"]
    # partial sums before the shuffle: a template has few words, so a diagonal's set of positions is small
    votes = hits.groupBy(*key, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.collect_set("q").alias("qs"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(along) > gap) | F.lag("diagonal").over(along).isNull()
    merged = votes.withColumn("run", F.sum(fresh.cast("int")).over(along)).groupBy(*key, "run")
    spans = merged.agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("lo").alias("first_word"), (F.max("hi") + k - 1).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (k - 1))))))
    return spans.select("doc_id", "__gl_key", "label", F.col("t").alias("template"), F.col("first_word").cast("long"), F.col("last_word").cast("long"), (covered / F.greatest(F.col("n"), F.col("last_word") - F.col("first_word") + 1)).alias("score"))


def label(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the base phrases' places and labels, and the labels and best score of its spans."""
    seen = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("__gl_key"), scan_words(F.col(text)).alias("w"))
    seen = seen.select("doc_id", "__gl_key", F.size("w").cast("long").alias("n_words"), *[phrase_places(F.col("w"), p).alias(f"at{i}") for i, (p, _) in enumerate(PHRASES)])
    places = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    seen = seen.select("doc_id", "__gl_key", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base.alias("base"))
    spans = scan(docs, templates, doc_id, text).groupBy("doc_id", "__gl_key").agg(F.collect_set(F.when(F.col("score") >= MIN_SCORE, F.col("label"))).alias("more"), F.max("score").alias("score"))
    joined = seen.alias("a").join(spans.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__gl_key") == F.col("b.__gl_key")), "left")
    return joined.select(
        "a.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )

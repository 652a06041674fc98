"""Licence scans: phrase places, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.quality import let

#: Splits text into words of letters, digits and bytes above ASCII.
GAPS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences by which public licences are recognised, with the method's labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CONTAINMENT = 0.8


def _tokens(text: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()})


def needed(n_tokens: int, containment: float) -> int:
    return math.ceil(containment * n_tokens - 1e-9)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAPS), lambda w: w != "")


def _places(w: Column) -> Column:
    """Where phrases start: array of (at, label)."""

    def label_at(i):
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            hit = F.lit(True)
            for k, part in enumerate(phrase.split()):
                hit = hit & (F.coalesce(F.get(w, i + k), F.lit("")) == part)
            out = F.when(hit, label).otherwise(out)
        return out

    found = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.cast("long").alias("at"), label_at(i).alias("label")))
    return F.when(F.size(w) > 0, F.filter(found, lambda x: x["label"].isNotNull()))


def blocks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The lines of every text, one row each, with their distinct words."""
    lines = docs.select(*keys, F.posexplode(F.split(F.lower(F.col(text)), "\n")).alias("__block", "__line"))
    return lines.select(*keys, "__block", F.array_distinct(F.filter(F.split("__line", GAPS), lambda w: w != "")).alias("__words"))


def wrapped_blocks(docs: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """The words around every line end, one row each, numbered by the line that ends there.

    Up to `most` words before and after it, over as many lines as that takes, but not past
    a line without words. __seq has these words in order, __at says how many stand before
    the line end, __words are the distinct ones.
    """
    line_end = F.regexp_replace(F.lower(F.col(text)), "\n", " N ")  # no lower-case word is N

    def at_ends(w):
        def around(i):
            before = F.slice(w, F.greatest(F.lit(1), i - 2 * most), F.least(i - 1, F.lit(2 * most)))
            after = F.slice(w, i + 1, F.lit(2 * most))
            before = F.split(F.regexp_replace(F.concat(F.lit(" "), F.array_join(before, " "), F.lit(" N ")), "(?s)^.* N(?= N )", ""), " ")
            after = F.split(F.regexp_replace(F.concat(F.lit(" N "), F.array_join(after, " "), F.lit(" ")), "(?s) N N .*$", ""), " ")
            own = lambda x: (x != "") & (x != "N")
            before = F.reverse(F.slice(F.reverse(F.filter(before, own)), 1, most))
            return F.struct(before.alias("before"), F.slice(F.filter(after, own), 1, most).alias("after"))

        ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i) == "N")
        return F.transform(ends, around)

    w = F.filter(F.split(line_end, GAPS), lambda x: x != "")
    ends = docs.where(F.contains(F.col(text), F.lit("\n"))).select(*keys, F.posexplode(let(w, at_ends)).alias("__block", "__end"))
    ends = ends.select(*keys, "__block", F.concat("__end.before", "__end.after").alias("__seq"), F.size("__end.before").alias("__at"))
    return ends.where((F.col("__at") > 0) & (F.size("__seq") > F.col("__at"))).withColumn("__words", F.array_distinct("__seq"))


def template_matches(docs: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row (keys, block, template, label, containment) for each line that holds enough of a template.

    Exact. A notice may be wrapped: every run of as many words as the template has that goes
    over the end of a line, but not over a line without words, counts as that line's too.
    Such runs are formed only in texts that hold a key of the join. Template words are ordered by how many lines of the corpus hold them, rarest
    first (counts of the fixed template vocabulary only reach the driver). A line can hold
    a share of a template only if it holds one of the template's first words in that order,
    which is the key of the join; the length and positional bounds drop candidates before
    the sets are compared. The template side is a fixed small table and is broadcast.
    """
    spark = docs.sparkSession
    sets = [(i, label, _tokens(t)) for i, (label, t) in enumerate(templates)]
    vocabulary = sorted({w for *_, t in sets for w in t})
    own = F.array(*[F.lit(w) for w in vocabulary])
    lines = blocks(docs, keys, text)
    held = lines.select(F.explode(F.array_intersect("__words", own)).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in held}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    length = [len("".join(c if c.isalnum() else " " for c in t).split()) for _, t in templates]
    heads = []
    for i, label, t in sets:
        t = sorted(t, key=rank.get)
        least = needed(len(t), containment)
        heads += [(w, i, label, p, t, least, length[i]) for p, w in enumerate(t[: len(t) - least + 1])]
    right = F.broadcast(spark.createDataFrame(heads, "w string, template int, label string, p int, t array<string>, least int, n int"))
    first = F.array(*[F.lit(w) for w in sorted({h[0] for h in heads})])
    shortest = min(h[5] for h in heads)
    wrapped = wrapped_blocks(docs.where(F.lower(F.col(text)).rlike("|".join(sorted({h[0] for h in heads})))), keys, text, max(length) - 1)
    near = (
        lines.unionByName(wrapped, allowMissingColumns=True).where(F.size("__words") >= shortest)
        .withColumn("__hits", F.array_intersect("__words", first)).where(F.size("__hits") > 0)
        .withColumn("__own", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("__words")))
        .select(*keys, "__block", "__own", "__seq", "__at", F.explode("__hits").alias("w"))
        .join(right, "w")
        .where(F.size("__own") >= F.col("least"))
        .where(1 + F.least(F.size("t") - F.col("p") - 1, F.size("__own") - F.array_position("__own", F.col("w")).cast("int")) >= F.col("least"))
    )
    run = lambda p: F.size(F.array_intersect(F.col("t"), F.slice(F.col("__seq"), p, F.col("n"))))
    runs = F.array_max(F.transform(F.sequence(F.greatest(F.lit(1), F.col("__at") - F.col("n") + 2), F.col("__at")), run))
    overlap = F.when(F.col("__seq").isNull(), F.size(F.array_intersect("t", "__own"))).otherwise(runs)
    sure = near.withColumn("__n", overlap).where(F.col("__n") >= F.col("least"))
    return sure.select(*keys, F.col("__block").alias("block"), "template", "label", (F.col("__n") / F.size("t")).alias("share")).groupBy(*keys, "block", "template", "label").agg(F.max("share").alias("containment"))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document: words, phrase places, labels and a score.

    score is 1 for a document with a phrase, else the best containment reached. Null or
    blank text has no words, no labels and score 0. Repeated rows each get their own row;
    a row is known by its id and the hash of its text, so null ids are fine too.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("__t", F.xxhash64("text"))
    matched = (
        template_matches(base, ["doc_id", "__t"], "text", templates, containment)
        .groupBy("doc_id", "__t").agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__best"))
        .withColumnRenamed("doc_id", "__id").withColumnRenamed("__t", "__hash")
    )
    w = words(F.col("text"))
    counted = base.select(
        "doc_id", "__t",
        F.size(F.filter(F.split("text", GAPS), lambda x: x != "")).cast("long").alias("n_words"),
        F.when(F.col("text").rlike("(?i)license"), let(w, _places)).alias("__places"),
    )
    out = counted.join(matched, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__hash")), "left")
    none = F.array().cast("array<string>")
    places = F.coalesce(F.col("__places"), F.array().cast("array<struct<at:bigint,label:string>>"))
    base_labels = F.array_distinct(F.transform(places, lambda x: x["label"]))
    labels = F.array_union(base_labels, F.coalesce(F.col("__labels"), none))
    return out.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["at"])).alias("first_word"), F.array_max(F.transform(places, lambda x: x["at"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("__best"), F.lit(0.0))).alias("score"),
    )

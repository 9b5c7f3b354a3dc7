"""License scans by diagonal voting. DataFrame functions only.

Every rolling pair of words of a document is hashed and joined to the template positions that hold the same pair.
A match votes for the diagonal ``document position - template position``; an uninterrupted copy puts all its votes
on one diagonal, an inserted or dropped word moves the rest to a neighbour. Votes are added up by diagonal,
neighbouring diagonals are merged, and a merged span is verified by the share of distinct template positions it
holds and by its length. A short phrase must hold every position on one diagonal, which makes its places exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import read_table

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The opening words of public licence notices and the labels of the method's own.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "this work is licensed under the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "released under the mit license": "mit-notice",
    "licensed under cc by": "cc-notice",
}
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of anything but the ASCII characters that are neither letter nor digit.

    ``lower`` folds more than A-Z; the two characters whose small form holds an ASCII letter are replaced first, so
    that templates, which are ASCII, meet the same words.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(plain), WORD_BREAK), "")


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """A row per template position; the templates are constants of this job, so the table may be broadcast."""
    listed = [(text, label, exact) for given, exact in ((phrases, True), (notices, False)) for text, label in given.items()]
    for text, _, _ in listed:
        if len(text.split()) < GRAM:
            raise ValueError(f"a template needs {GRAM} words or more: {text!r}")
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.array(*map(F.lit, text.split())).alias("ws")) for k, (text, label, exact) in enumerate(listed)])
    t = spark.range(1).select(F.inline(rows)).select("*", F.size("ws").alias("m"))
    t = t.select("template", "label", "exact", "ws", "m", F.explode(F.sequence(F.lit(0), F.col("m") - GRAM)).alias("tpos"))
    return t.select("template", "label", "exact", "m", "tpos", *[F.get("ws", F.col("tpos") + j).alias(f"t{j}") for j in range(GRAM)])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
                  coverage: float = 0.7, band: int = 3, stretch: float = 1.5) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``spans`` (label, first and last word, share, exact), in order.

    A notice span counts if it holds ``coverage`` of the template's positions within ``stretch`` times its words;
    diagonals up to ``band`` apart are one span. Null texts are empty; a null id is an id. A row is known by its id and
    text: rows that share only the id are apart, rows that repeat both are scanned as one and each given the result.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = F.broadcast(_templates(spark, phrases, notices).select("*", F.xxhash64("t0", "t1").alias("gram")))
    # explode(array(..)) keeps the words from being split again for every use.
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("th"), F.explode(F.array(words(F.col(text_col)))).alias("ws"))
    # Position -1 stands for the document itself, so that one pass gives the matches and the word counts.
    places = rows.select("id", "th", "ws", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("ws") - GRAM, F.lit(-1)))).alias("pos"))
    places = places.select("id", "th", "ws", "pos", F.when(F.col("pos") >= 0, F.xxhash64(F.get("ws", F.col("pos")), F.get("ws", F.col("pos") + 1))).alias("at"))
    found = places.join(table, F.col("at") == F.col("gram"), "left").where("pos = -1 or (template is not null and get(ws, pos) = t0 and get(ws, pos + 1) = t1)")
    found = found.select("id", "th", "template", "label", "exact", "m", "tpos", "pos", F.when(F.col("pos") == -1, F.size("ws").cast("long")).alias("n_words"))

    votes = found.groupBy("id", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("m").alias("m"),
        F.collect_set("tpos").alias("held"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"),
    )
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    step = F.when(F.col("template").isNull() | F.col("exact") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(band + 1)) > band), 1).otherwise(0)
    spans = votes.select("*", step.alias("step")).select("*", F.sum("step").over(order).alias("cluster"))
    merged = spans.groupBy("id", "th", "template", "cluster").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("m").alias("m"),
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    share = F.col("held") / (F.col("m") - (GRAM - 1))
    verified = F.when(F.col("exact"), share == 1).otherwise((share >= coverage) & (F.col("last") - F.col("first") + 1 <= F.col("m") * stretch))
    span = F.struct("first", "last", "label", "exact", share.alias("share"))
    each = merged.groupBy("id", "th").agg(F.max("n_words").alias("n_words"), F.max("copies").cast("int").alias("copies"), F.sort_array(F.collect_list(F.when(verified, span))).alias("spans"))
    return each.select(F.col("id").alias(id_col), "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scanned for phrases and notices."""
    scanned = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    out = scanned.select("doc_id", "n_words", "spans", base.alias("base"))
    labels = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.get("base", F.lit(0))["first"].cast("long").alias("first_word"),
        F.when(F.size("base") > 0, F.element_at("base", -1)["first"]).cast("long").alias("last_word"), labels("base").alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )

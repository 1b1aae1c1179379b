"""License texts in documents: MinHash bands over overlapping text windows, exact containment; built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle.
WIDTH = 5
#: Window sizes in words; a template is sought by the largest that fits it.
CLASSES = (5, 7, 12, 24)
#: Bands and rows of each: a window with similarity 0.8 shares a band with probability 1 - (1 - 0.8^2)^8, over 0.9997.
BANDS, ROWS = 8, 2
#: Band rows of templates up to which they are broadcast; counted first, shuffled beyond it.
BROADCAST_ROWS = 200_000

# Notices as the licences' own publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
]


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Distinct shingles as strings; none for fewer than WIDTH words."""
    at = F.when(F.size(words) >= WIDTH, F.sequence(F.lit(1), F.size(words) - WIDTH + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, WIDTH), " ")))


def _bands(words: Column, start: Column, size: Column) -> Column:
    """Band keys of the window of `size` words from `start` (1 is the first).

    A row's minimum is taken over shingle hashes exclusive-or a fixed mask: masks order the
    hashes in ways as good as independent, and the shingles are hashed once.
    """
    hashes = F.transform(F.sequence(start, start + size - WIDTH), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(WIDTH)]))
    mask = lambda k: F.lit(((0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1) - (1 << 63))
    least = lambda h, k: F.array_min(F.transform(h, lambda x: x.bitwiseXOR(mask(k))))
    keys = lambda h: F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(h, b * ROWS + r) for r in range(ROWS)]).alias("key")) for b in range(BANDS)])
    return F.element_at(F.transform(F.array(hashes), keys), 1)


def _plain(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def anchors(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs of neighbouring words of which every shingle of every template has one, long ones preferred.

    A text without any of them has no shingle of a template.
    """
    sets = []
    for _, text in templates:
        words = _plain(text)
        pairs = list(zip(words, words[1:], strict=False))
        sets += [frozenset(pairs[i : i + WIDTH - 1]) for i in range(len(words) - WIDTH + 1)]
    chosen: list[tuple[str, str]] = []
    while sets:
        count: dict[tuple[str, str], int] = {}
        for s in sets:
            for p in s:
                count[p] = count.get(p, 0) + 1
        best = max(count, key=lambda p: (count[p] * len(p[0]) * len(p[1]), p))
        chosen.append(best)
        sets = [s for s in sets if best not in s]
    return sorted(chosen)


def _template_bands(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("notice")) for i, t in templates])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.*", _words(F.col("t.notice")).alias("words"))
    size = F.greatest(*[F.when(F.size("words") >= c, c) for c in CLASSES], F.lit(0))
    table = table.withColumn("class", size).where(F.col("class") > 0)
    table = table.withColumn("offset", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("class") + 1)))
    table = table.withColumn("b", F.explode(_bands(F.col("words"), F.col("offset"), F.col("class"))))
    return table.select("license", "class", "offset", F.col("b.band").alias("band"), F.col("b.key").alias("key"), F.size("words").alias("length"), _shingles(F.col("words")).alias("wanted"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """Templates that whole texts contain: doc_id, license, first_word, containment.

    docs: doc_id, text; other columns are ignored. templates: (license, text), the caller's list.
    Words are lower-case runs of letters and digits. Containment is the share of a template's
    distinct five-word shingles that stand in the stretch of text where a window met it (the
    template's length and a quarter more on either side); rows with at least `least` return, the
    best for each row of docs and template, first_word (from 0) being where the template would
    begin. Templates of fewer than five words never match; null, blank and short texts contain
    nothing; repeated rows give one result for each doc_id and template; a null doc_id counts as one id.

    A text without any anchor (see `anchors`) has no shingle of any template, so only texts with
    one are cut in windows, and only windows that hold one are hashed: nothing else could match.
    Windows of each class overlap in all but one word. Their MinHash bands retrieve templates from a
    table whose size is checked before it is broadcast; shingles as strings then decide.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    marks = anchors(templates)
    if not marks:
        return docs.select(F.col("doc_id").cast("long"), F.lit("").alias("license"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment")).where("false")
    table = _template_bands(spark, templates)
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    lower = F.lower("text")
    found = F.lit(False)
    for first, second in marks:
        found = found | (lower.contains(first) & lower.contains(second))
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(found).select("doc_id", _words(F.col("text")).alias("words")).where(F.size("words") >= WIDTH)
    pair = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda v, w: F.concat(v, F.lit(" "), w).isin([" ".join(m) for m in marks]))
    at = F.filter(F.transform(pair, lambda hit, i: F.when(hit, i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at).where(F.size("at") > 0)
    rows = rows.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES)))).where(F.size("words") >= F.col("class"))
    last = F.size("words") - F.col("class") + 1
    over = lambda p: F.sequence(F.least(F.greatest(p - F.col("class") + 1, F.lit(1)), last), F.least(p, last))
    rows = rows.withColumn("start", F.explode(F.array_distinct(F.flatten(F.transform("at", over)))))
    # only the words that a template could cover go on
    longest = max(len(_plain(t)) for _, t in templates)
    reach = longest + longest // 4 + 2
    low = F.greatest(F.col("start") - reach, F.lit(1))
    rows = rows.select("doc_id", "class", "start", low.alias("low"), F.slice("words", low, F.col("start") - low + F.col("class") + reach).alias("words"))
    rows = rows.withColumn("b", F.explode(_bands(F.col("words"), F.col("start") - F.col("low") + 1, F.col("class"))))
    met = rows.select("*", F.col("b.band").alias("band"), F.col("b.key").alias("key")).join(table, ["class", "band", "key"])
    begin = F.col("start") - F.col("offset") + 1
    slack = F.ceil(F.col("length") / 4).cast("int")
    first = F.greatest(begin - slack, F.col("low"))
    region = F.slice("words", first - F.col("low") + 1, begin + F.col("length") + slack - first)
    met = met.select("doc_id", "license", (F.greatest(begin, F.lit(1)) - 1).alias("first_word"), "wanted", region.alias("region")).distinct()
    met = met.select("doc_id", "license", "first_word", (F.size(F.array_intersect("wanted", _shingles(F.col("region")))) / F.size("wanted")).alias("containment"))
    best = met.where(F.col("containment") >= least).groupBy("doc_id", "license").agg(F.max(F.struct("containment", -F.col("first_word"))).alias("m"))
    return best.select("doc_id", "license", (-F.col("m.col2")).alias("first_word"), F.col("m.containment").alias("containment"))

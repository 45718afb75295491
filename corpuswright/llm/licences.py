"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs end at blank lines; comment marks at the ends of a line do not count
and wrapped lines are joined. A multinomial logistic regression over the word 1-
and 2-grams of licence texts, trained here on those texts and on a bounded sample
of corpus paragraphs and lines as the unknown class, chooses among the families
of which a text holds most of a template, and unknown; its probabilities are
calibrated on held-out rows. A paragraph that holds
most of a template is classified line by line, in runs of lines and as a whole,
so a statement counts wherever it stands. Everything over the whole corpus is
column expressions over small fixed lists (template pairs, marks).
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .rows import body

#: Opening statements of public licences (fixed values).
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
UNKNOWN = "unknown"
#: Sentences that speak of licences without granting one, for the unknown class.
OTHER = (
    "A driving license is required to rent a car.",
    "The city may license new shops after a public hearing.",
    "All rights reserved by the author of this public work.",
    "The software version was agreed upon in general terms.",
)
#: Documents whose paragraphs and lines stand for the unknown class in training, those with the smallest hash of their id.
SAMPLE = 2000
#: Most n-grams of the vocabulary.
VOCABULARY = 4096
#: Share of a template's 2-grams a text must hold to confirm it, and the least probability.
CONFIRM, LEAST = 0.6, 0.5
#: Lines of the runs of a paragraph that are classified besides the whole.
RUNS = (1, 2, 3, 4, 6, 9, 12)
#: Separators of words: dots that end a word are not part of it.
BREAK = r"(?<![.])[.]++(?:[^a-z0-9.+-]++|$)|[^a-z0-9.+-]++"
#: Comment marks and space at the start and end of a line.
_MARK = r"\h\f#/*;%!|<>{}\"'`=_~-"
MARKS = rf"(?md)^[{_MARK}]*+(?:[.]\\\"|@?(?:dnl|DNL|rem|REM)(?![A-Za-z0-9])|[cC](?= ))?+[{_MARK}]*+|(?<![{_MARK}])[{_MARK}]++$"
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Pairs of neighbouring words."""
    size = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), size - 1), F.slice(words, F.lit(2), size - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(size > 1, pairs).otherwise(F.array().cast("array<string>"))


def n_grams(words: str) -> Column:
    """Distinct words and pairs of neighbouring words."""
    return F.array_distinct(F.concat(F.col(words), pairs_of(F.col(words))))


def _plain_words(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


def template_pairs() -> list[tuple[str, list[str]]]:
    """Family and distinct pairs of neighbouring words of every template."""
    words = [(f, _plain_words(t)) for f, texts in TEMPLATES.items() for t in texts]
    return [(f, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))) for f, w in words]


def marks() -> list[str]:
    """Words of which a text must have one to confirm any template.

    Of each template words are taken, the longest first, until the pairs without
    one of them are too few to confirm it.
    """
    found: set[str] = set()
    for _, pairs in template_pairs():
        for w in [None, *sorted({w for p in pairs for w in p.split()}, key=lambda w: (-len(w), w))]:
            if sum(found.isdisjoint(p.split()) for p in pairs) < CONFIRM * len(pairs):
                break
            if w is not None:
                found.add(w)
    return sorted(found)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def shown(words: Column) -> Column:
    """Families of the templates that ``words`` hold enough pairs of; with repeats."""
    templates = template_pairs()
    held = F.array_intersect(pairs_of(words), _strings(sorted({p for _, pairs in templates for p in pairs})))

    def families(hits: Column) -> Column:
        share = [F.when(F.size(F.array_intersect(hits, _strings(pairs))) >= CONFIRM * len(pairs), F.lit(f)) for f, pairs in templates]
        return F.array_compact(F.array(*share))

    # one evaluation of the intersection for all templates
    return F.flatten(F.transform(F.array(held), families))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body``, ``paragraph`` number, its ``text`` without comment marks and its ``words``; those with a word."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), MARKS, "")
    cut = docs.select("doc_id", body().alias("body"), F.posexplode(F.split(text, "\n\n+")).alias("paragraph", "text"))
    return cut.withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)


def licensed(docs: DataFrame) -> DataFrame:
    """Paragraphs (``paragraphs_of``) that hold most of a template."""
    near = paragraphs_of(docs).where(F.arrays_overlap("words", _strings(marks())))
    return near.where(F.size(shown(F.col("words"))) > 0)


def runs_of(paragraphs: DataFrame) -> DataFrame:
    """``key`` (document, paragraph, first line, number of lines), ``words``, ``shown`` of the runs that hold most of a template."""
    lines = paragraphs.select("doc_id", "body", "paragraph", F.transform(F.split("text", "\n"), words_of).alias("lines"))
    n = F.size("lines")

    def of_length(size: Column, starts: Column) -> DataFrame:
        first = F.filter(starts, lambda i: F.size(shown(F.flatten(F.slice("lines", i, size)))) > 0)
        rows = lines.select("doc_id", "body", "paragraph", "lines", F.explode(first).alias("first"))
        key = F.struct("doc_id", "body", "paragraph", "first", size.alias("n"))
        return rows.select(key.alias("key"), F.flatten(F.slice("lines", F.col("first"), size)).alias("words"))

    runs = of_length(n, F.array(F.lit(1)))
    for length in RUNS:
        size = F.lit(length)
        none = F.array().cast("array<int>")
        runs = runs.unionByName(of_length(size, F.when(n > size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).otherwise(none)))
    return runs.withColumn("shown", shown(F.col("words")))


def log_probability(logits: str, logit: Column, temperature: float) -> Column:
    """Logarithm of the softmax share of one of the logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda t, z: t + F.exp((z - top) / F.lit(temperature)))
    return (logit - top) / F.lit(temperature) - F.log(total)


class LicenceModel:
    """Bounded table ``weights`` (gram, family, weight); ``bias`` by family."""

    def __init__(self, weights: DataFrame, bias: list[tuple[str, float]], temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def logits(self, lines: DataFrame) -> DataFrame:
        """``key`` and ``logits`` (an array in the order of ``bias``) of every row of ``lines`` (``key``, ``words``)."""
        grams = lines.select("key", F.explode(n_grams("words")).alias("gram"))
        sums = grams.join(F.broadcast(self.weights), "gram").groupBy("key", "family").agg(F.sum("weight").alias("z"))
        maps = sums.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("family", "z"))).alias("zs"))
        logit = [F.coalesce(F.element_at("zs", F.lit(f)), F.lit(0.0)) + b for f, b in self.bias]
        return lines.select("key").join(maps, "key", "left").select("key", F.array(*logit).alias("logits"))

    def best(self, lines: DataFrame) -> DataFrame:
        """``key``, likeliest ``family`` of those in ``shown`` or unknown, and its calibrated probability ``p`` among them."""
        families = _strings([f for f, _ in self.bias])
        rows = self.logits(lines).join(lines.select("key", "shown"), "key")
        free = F.transform(families, lambda f: (f == UNKNOWN) | F.array_contains("shown", f))
        zs = F.zip_with("logits", F.zip_with(families, free, lambda f, m: F.struct(f.alias("f"), m.alias("m"))), lambda z, x: F.struct(z.alias("z"), x["f"].alias("f"), x["m"].alias("m")))
        rows = rows.select("key", F.filter(zs, lambda x: x["m"]).alias("zs"))
        rows = rows.select("key", F.transform("zs", lambda x: x["z"]).alias("logits"), F.array_max("zs").alias("top"))
        return rows.select("key", F.col("top.f").alias("family"), F.exp(log_probability("logits", F.col("top.z"), self.temperature)).alias("p"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string")


def train(docs: DataFrame, seed: int = 5) -> LicenceModel:
    """Fit on the templates (whole, halved and with words left out) and on paragraphs and lines of ``SAMPLE`` documents.

    Sampled paragraphs that hold most of a template are left out of the unknown class.
    A fifth of the rows is held out to choose the temperature.
    """
    spark = docs.sparkSession
    texts = _templates(spark).withColumn("words", words_of(F.col("text")))
    forms = spark.range(24).withColumnRenamed("id", "form")
    cut = F.filter(
        "words", lambda w, i: (F.col("form") == 0) | (F.pmod(F.xxhash64(F.lit(seed), w, i, F.col("form"), F.col("template")), F.lit(8)) > 0)
    )
    half = (F.size("words") / 2).cast("int")
    part = F.when((F.col("form") % 6 == 4) & (half > 6), F.slice("words", F.lit(1), half)).when(
        (F.col("form") % 6 == 5) & (half > 6), F.slice("words", half + 1, F.size("words"))
    ).otherwise(cut)
    made = texts.join(F.broadcast(forms)).select("family", part.alias("words"))

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE)
    sampled = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    free = materialize(paragraphs_of(sampled).where(F.size(shown(F.col("words"))) == 0), "free")
    lines = free.select(F.explode(F.split("text", "\n")).alias("line")).select(words_of(F.col("line")).alias("words"))
    plain = lines.where(F.size("words") > 0).unionByName(free.where(F.contains("text", F.lit("\n"))).select("words"))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), "words")
    other = spark.createDataFrame([(t,) for t in OTHER], "text string").join(F.broadcast(forms)).select(
        F.lit(UNKNOWN).alias("family"), words_of(F.col("text")).alias("words")
    )
    rows = made.unionByName(plain).unionByName(other).select("family", n_grams("words").alias("grams"))
    families = [UNKNOWN, *TEMPLATES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    held = F.pmod(F.xxhash64(F.lit(seed + 1), F.array_join("grams", " "), F.monotonically_increasing_id()), F.lit(5)) == 0
    rows = materialize(rows.withColumn("label", label).withColumn("held", held), "training")

    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True)
    fitted = counter.fit(rows.where(F.col("family") != UNKNOWN).repartition(1))
    regression = LogisticRegression(family="multinomial", maxIter=40, regParam=0.0003, elasticNetParam=0.5, standardization=False)
    model = regression.fit(fitted.transform(rows.where("NOT held")).select("label", "features"))
    matrix = model.coefficientMatrix.toArray()
    values = [
        (g, families[f], float(matrix[f][j]))
        for j, g in enumerate(fitted.vocabulary)
        for f in range(len(matrix))
        if abs(matrix[f][j]) > 1e-9
    ]
    bias = [(families[f], float(b)) for f, b in enumerate(model.interceptVector)]
    weights = spark.createDataFrame(values, "gram string, family string, weight double")

    best = LicenceModel(weights, bias, 1.0)
    tried = materialize(rows.where("held").select("label", "grams").withColumn("key", F.monotonically_increasing_id()), "held")
    rated = best.logits(tried.select("key", F.col("grams").alias("words"))).join(tried.select("key", "label"), "key")
    true = F.element_at("logits", F.col("label").cast("int") + 1)
    losses = rated.agg(*[F.avg(-log_probability("logits", true, t)).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    if losses[0] is not None:
        best.temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
    return best


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """``doc_id``, ``n_lines`` (licence lines), ``licence``, ``probability``, ``families`` of every row of ``docs``.

    ``licence`` is the likeliest confirmed family of any run of lines (null
    without one), ``families`` all of them in order. Licence lines are those of
    the shortest runs of each family in a paragraph. Null and empty texts have
    no lines, repeated rows get the same result, other columns are not read.
    """
    runs = runs_of(materialize(licensed(docs), "licence_paragraphs")).dropDuplicates(["key"])
    runs = materialize(runs, "licence_runs")
    named = model.best(runs).where((F.col("family") != UNKNOWN) & (F.col("p") >= LEAST))
    sure = materialize(named.select("key.*", "family", "p"), "sure")
    group = ["doc_id", "body", "paragraph", "family"]
    least = sure.groupBy(*group).agg(F.min("n").alias("least"), F.collect_set(F.struct("n", "first")).alias("runs"))
    shortest = F.filter("runs", lambda r: r["n"] == F.col("least"))
    lines = F.flatten(F.transform(shortest, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
    counted = least.select("doc_id", "body", "paragraph", F.explode(lines).alias("line")).distinct().groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n_lines"))
    best = sure.groupBy("doc_id", "body").agg(F.max(F.struct("p", "family")).alias("best"), F.array_sort(F.collect_set("family")).alias("families"))
    counted = counted.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), "n_lines")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    found = best.join(counted, same).select("_doc", "_body", "n_lines", "best", "families")
    found = materialize(found, "licensed")
    met = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    return docs.select("doc_id", body().alias("body")).join(found, met, "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.col("best.family").alias("licence"),
        F.col("best.p").alias("probability"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )

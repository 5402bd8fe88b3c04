"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by templates; DataFrame expressions only.

A paragraph is a line, or a run of lines up to one without a word, so that n-grams may cross line ends. Its features are its word bigrams and trigrams that occur in any template. A sparse multinomial logistic
regression (L1) is fitted to passages of the templates of each family and, as *unknown*, to a bounded sample of the corpus' own
paragraphs (``MAX_UNKNOWN`` distinct ones with the smallest hashes, less those that share much with a template) beside template passages cut so
short that they name no family. On the half of these rows that the fit did not see, a temperature is chosen that makes the
probabilities most likely; a paragraph belongs to the likeliest family if its calibrated probability reaches ``SURE``.

The prediction is confirmed if the paragraph holds at least ``CONFIRM`` of the n-grams of one of the family's templates. Both sums run
over the n-grams that a paragraph shares with the templates: every position of every text is hashed once and looked up in a
broadcast table, which the templates bound. Paragraphs that share none have the unknown class's probability and are not reported.

Null and empty texts have no paragraph with features. A licence repeated in one text is reported for each of its lines or runs, and once if rows repeat
id and text; rows without an id are reported under a null id. Of families that are equally likely the first in ``TEMPLATES`` counts, of templates equally similar the first. A run is not reported beside lines of it that name the same family, and has one family. Extra columns are ignored. With no documents the result is empty.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import least_hashes, written

#: Notices by which works name their licence, and passages of licence texts that no other family has, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU General Public License Version 2, June 1991",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "Zlib": ["Released under the zlib License.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
}
UNKNOWN = "unknown"
MAX_UNKNOWN = 2_000
SURE = 0.5
CONFIRM = 0.6
TEMPERATURES = [0.25 * 1.25**i for i in range(16)]
NOT_WORD = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def grams(w: Column) -> Column:
    """The word bigrams and trigrams of an array of words."""
    of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(of(2), of(3))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(family, text)."""
    return spark.createDataFrame([(f, t) for f, texts in templates.items() for t in texts], "family string, text string").coalesce(1)


def template_grams(templates: dict[str, list[str]]) -> dict[str, list[tuple[str, int, int]]]:
    """(family, template, its number of n-grams) of each distinct n-gram of the templates, which bound the table."""
    held: dict[str, list[tuple[str, int, int]]] = {}
    for family, texts in templates.items():
        for i, text in enumerate(texts):
            w = [x for x in re.split(NOT_WORD, text.lower()) if x]
            own = {" ".join(w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1)}
            for gram in own:
                held.setdefault(gram, []).append((family, i, len(own)))
    return held


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, paragraph, words) of all lines."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"))
    return lines.select("doc_id", "text_hash", "paragraph", tokens(F.col("line")).alias("words"))


def lines_and_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, run, whole, paragraph, words) of all lines with a word and all runs of two or more: the first line of the run, whether it is the whole run, the first line."""
    worded = lambda line: F.lower(line).rlike("[a-z0-9]")
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    first = lambda i: worded(F.get("lines", i)) & ~F.coalesce(worded(F.get("lines", i - 1)), F.lit(False))
    starts = lines.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), first))
    runs = starts.select("*", F.posexplode("starts").alias("k", "run"))
    runs = runs.withColumn("n", F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines")) - F.col("run"))
    least = F.when(F.coalesce(worded(F.get("lines", F.col("run") + 1)), F.lit(False)), -1).otherwise(0)
    units = runs.select("*", F.explode(F.sequence(least, F.col("n") - 1)).alias("i"))
    whole = F.col("i") < 0
    text = F.when(whole, F.array_join(F.slice("lines", F.col("run") + 1, F.col("n")), "\n")).otherwise(F.get("lines", F.col("run") + F.col("i")))
    return units.select("doc_id", "text_hash", "run", whole.alias("whole"), (F.col("run") + F.greatest("i", F.lit(0))).alias("paragraph"), tokens(text).alias("words"))


def gram_key(n: int, word) -> Column:
    """64-bit key of an n-gram of words."""
    return F.xxhash64(F.lit(n), *[word(k) for k in range(n)])


def training_rows(docs: DataFrame, templates: dict[str, list[str]], max_unknown: int) -> DataFrame:
    """(label, grams, held): passages of templates by family, and of no family; held rows calibrate."""
    spark, families = docs.sparkSession, [*templates, UNKNOWN]
    label = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    whole = template_table(spark, templates).select("family", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    # each template with few words lost at either end, between other words or none
    cut = whole.withColumn("a", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(3), F.col("n") - 5))))).withColumn("b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(3), F.col("n") - 5)))))
    cut = cut.where(F.col("n") - F.col("a") - F.col("b") >= F.greatest(F.lit(4), 0.6 * F.col("n"))).withColumn("pad", F.explode(F.array(*[F.array(), F.array(F.lit("zq"), F.lit("zx"))])))
    known = cut.select("family", F.concat("pad", F.slice("w", F.col("a") + 1, F.col("n") - F.col("a") - F.col("b")), "pad").alias("words"))
    # passages that several families share name none of them
    common = whole.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 3))).select("family", F.slice("w", F.col("a") + 1, F.lit(3)).alias("words"))
    common = common.groupBy("words").agg(F.countDistinct("family").alias("k")).where("k > 1").select(F.lit(UNKNOWN).alias("family"), "words")
    # distinct paragraphs with the smallest hashes, but for those that share four n-grams with a family
    lines = docs.agg(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0
    own = F.xxhash64("words").alias("own")
    found = paragraphs(docs).select("words", own).where(least_hashes(F.xxhash64("words"), max_unknown, lines) & (F.size("words") > 1)).distinct()
    sample = written(found.orderBy("own", "words").limit(max_unknown), "unknown")
    held = spark.createDataFrame(sorted({(g, f) for g, xs in template_grams(templates).items() for f, _, _ in xs}), "gram string, family string")
    shared = sample.select("words", F.explode(F.array_distinct(grams(F.col("words")))).alias("gram")).join(F.broadcast(held), "gram")  # one row a template n-gram
    much = shared.groupBy("words", "family").count().where("count >= 4").select("words").distinct()
    sample = sample.join(much.hint("merge"), "words", "left_anti").select(F.lit(UNKNOWN).alias("family"), "words")
    rows = known.unionByName(common).unionByName(sample)
    rows = rows.select(F.element_at(label, F.col("family")).alias("label"), grams(F.col("words")).alias("grams"))
    return rows.withColumn("held", F.xxhash64("grams") % 2 == 0)


def fitted(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, max_unknown: int = MAX_UNKNOWN) -> tuple[list[str], LogisticRegressionModel, float]:
    """(n-grams in the order of the features, the regression, the temperature); families in the order of ``templates``, then unknown."""
    vocabulary = sorted(template_grams(templates))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    rows = written(training_rows(docs, templates, max_unknown).coalesce(1), "license-training")
    rows = counts.transform(rows).select("label", "features", "held").cache()
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=60, standardization=False).fit(rows.where(~F.col("held")))
    raw = vector_to_array(F.col("rawPrediction"))
    scored = model.transform(rows.where("held")).select(raw.alias("z"), F.col("label").cast("int").alias("y"))

    def loss(t: float) -> Column:
        scaled = F.transform("z", lambda z: z / t)
        top = F.array_max(scaled)
        return F.avg(top + F.log(F.aggregate(F.transform(scaled, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, x: a + x)) - F.get(scaled, F.col("y")))

    losses = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    known = [(x, t) for x, t in zip(losses, TEMPERATURES, strict=True) if x is not None]
    rows.unpersist()
    return vocabulary, model, min(known)[1] if known else 1.0


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, max_unknown: int = MAX_UNKNOWN, sure: float = SURE, confirm: float = CONFIRM, model: tuple[list[str], LogisticRegressionModel, float] | None = None) -> DataFrame:
    """One row a confirmed licence paragraph of ``docs(doc_id, text, ...)``: doc_id, paragraph (number of its first line, from 0), family, probability, template, similarity."""
    spark = docs.sparkSession
    vocabulary, regression, temperature = model or fitted(docs, templates, max_unknown)
    weights, bias = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    kinds = len(templates) + 1
    held, schema = template_grams(templates), "gram string, weights array<double>, held array<struct<family:string,template:int,size:int>>"
    table = spark.createDataFrame([(g, [float(x) for x in weights[:, i]], held[g]) for i, g in enumerate(vocabulary)], schema).coalesce(1)
    parts = F.split("gram", " ")
    key = F.when(F.size(parts) == 2, gram_key(2, lambda k: F.get(parts, F.lit(k)))).otherwise(gram_key(3, lambda k: F.get(parts, F.lit(k))))
    table = F.broadcast(table.select(key.alias("gram"), "weights", "held"))  # one row a template n-gram

    unit = ["doc_id", "text_hash", "run", "whole", "paragraph"]
    # paragraphs without a bigram have no position; a filter on their length would split every one twice
    last = F.size("words") - 2
    at = lines_and_runs(docs).select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    word = lambda k: F.get("words", F.col("at") + k)
    keys = F.array(gram_key(2, word), F.when(F.col("at") + 2 < F.size("words"), gram_key(3, word)))
    spread = at.select(*unit, F.explode(keys).alias("gram"))
    shared = spread.join(table.select("gram"), "gram").distinct().join(table, "gram")

    sums = [F.sum(F.get("weights", F.lit(k))).alias(f"z{k}") for k in range(kinds)]
    scores = shared.groupBy(*unit).agg(*sums, F.collect_list("held").alias("held"))
    z = F.array(*[(F.col(f"z{k}") + F.lit(float(bias[k]))) / temperature for k in range(kinds)])
    scores = scores.select(*unit, "held", z.alias("z"))
    top = F.array_max("z")
    place = F.array_position("z", top) - 1
    probability = 1 / F.aggregate(F.transform("z", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(f) for f in [*templates, UNKNOWN]])
    found = scores.select(*unit, "held", F.get(names, place.cast("int")).alias("family"), probability.alias("probability"))
    found = found.where((F.col("family") != UNKNOWN) & (F.col("probability") >= sure))
    # the family's templates, by the share of their n-grams that the paragraph holds
    own = found.select("*", F.explode(F.flatten("held")).alias("h")).where("h.family = family")
    similar = own.groupBy(*unit, "family", "probability", F.col("h.template").alias("template")).agg((F.count("*") / F.max("h.size")).alias("similarity"))
    best = similar.groupBy(*unit, "family", "probability").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("best"))
    sure_ones = best.where(F.col("best.similarity") >= confirm)
    by_line = F.max(~F.col("whole")).over(Window.partitionBy("doc_id", "text_hash", "run", "family"))
    told = sure_ones.withColumn("by_line", by_line).where(~(F.col("whole") & F.col("by_line")))
    return told.select("doc_id", "paragraph", "family", "probability", (-F.col("best.t")).alias("template"), F.col("best.similarity").alias("similarity"))

"""Operator 7: licence scans with a trained paragraph classifier.

Paragraphs are runs of lines between blank ones (lines without a letter or digit), and each
line by itself.  A sparse (L1) multinomial logistic regression on word n-grams names a
licence family or "unknown"; its margin over unknown is calibrated on held-out paragraphs;
a family counts only if one of its templates is found in the paragraph.  Training and
scoring are DataFrame functions and Spark ML.

Features are the listed licence words and the templates' 2-grams, but for those of function
words alone.  They follow from the templates, never from the corpus.  A paragraph without any
has no feature, so the model gives it the same answer (unknown) without being asked, and no
template could be found in it.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import literal_rows, prepare, table, written

# Public notices and first lines of the licences, by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
# Sentences that speak of licences or software without granting anything.
OTHERS = [
    "The driver lost the license after the accident.", "A licensed plumber checked the public building.",
    "Version 3 of the program is faster than version 2.", "The author has asked for permission to copy the file.",
    "General conditions of the work are published on the site.", "Apache helicopters flew over the valley.",
    "The MIT campus is free of charge for visitors.", "Copyright law differs from country to country.",
    "Source code and documentation files are in the library.", "Mozilla and GNU were named in the report.",
    "This software is not licensed for use in hospitals.", "Public domain music was played at the foundation.",
]
UNKNOWN = "unknown"
#: Bounds of the training sample: documents and paragraphs of the corpus, by least hash.
SAMPLE_DOCS = 2_000
NEGATIVES = 4_000
VARIANTS = 12
#: Template words that make a paragraph a candidate on their own.
LICENSE_WORDS = frozenset(
    "license licensed mit apache gnu lesser affero mozilla bsd 3-clause cc cc0 by-nc by-sa creative commons attribution "
    "attribution-noncommercial attribution-sharealike copyright permission hereby granted redistribution redistribute "
    "unencumbered waived".split())
#: Words that are everywhere: a 2-gram of these alone makes no candidate.
FUNCTION_WORDS = frozenset("a all and any are as by can following for free has in into is it its may not of on or that the "
                           "this to under use with without you".split())
#: A sampled paragraph with as many features is no example of an unknown one.
AMBIGUOUS = 3
#: Share of a template's 2-grams that a paragraph must hold to be confirmed.
CONFIRM = 0.6

#: From the end of a paragraph to the start of the next: at least one line without letter or digit.
BLANK = r"\n[^\p{L}\p{N}]*\n"
_WORD = r"[^\p{L}\p{N}.+-]+"


def words(text: Column) -> Column:
    """Lower-case words; dots and hyphens inside a word stay, those at its end go."""
    return F.filter(F.transform(F.split(F.lower(text), _WORD), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", "")),
                    lambda w: w != "")


def grams(ws: Column) -> Column:
    """Distinct 1- and 2-grams.  ``ws`` is bound first, so that its words are made once."""
    def made(w: Column) -> Column:
        # the last word has no next and stays alone, a 1-gram once more
        two = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(w, two))
    return F.get(F.transform(F.array(ws), made), 0)


def _python_words(text: str) -> list[str]:
    return [x for x in (re.sub(r"^[.+-]+|[.+-]+$", "", w) for w in re.split(r"[^\w.+-]+", text.lower())) if x]


def features(templates) -> list[str]:
    """The listed words of the templates, and their 2-grams that are not of function words alone."""
    found = set()
    for _, t in templates:
        ws = _python_words(t)
        found |= LICENSE_WORDS.intersection(ws)
        found |= {f"{a} {b}" for a, b in zip(ws, ws[1:]) if not {a, b} <= FUNCTION_WORDS}
    return sorted(found)


def candidate_pattern(vocabulary: list[str]) -> str:
    """Matches a text that holds one of the words or 2-grams, whatever stands between two words;
    alternatives are grouped by first character and first word."""
    first: dict[str, dict[str, list[str]]] = {}
    for g in vocabulary:
        a, _, b = g.partition(" ")
        first.setdefault(a[0], {}).setdefault(a, []).append(b)
    def word(a: str, after: list[str]) -> str:
        rest = "" if "" in after else r"[^\p{L}\p{N}]+(?:" + "|".join(map(re.escape, after)) + ")"
        return re.escape(a[1:]) + rest + r"(?![\p{L}\p{N}])"
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(
        re.escape(c) + "(?:" + "|".join(word(a, bs) for a, bs in sorted(ws.items())) + ")" for c, ws in sorted(first.items())
    ) + ")"


class Model:
    """Weights as a small table, and the calibration: all that scoring needs."""

    def __init__(self, families, weights: DataFrame, intercepts, slope: float, shift: float, pattern: str):
        self.families, self.weights, self.intercepts = families, weights, intercepts
        self.slope, self.shift, self.pattern = slope, shift, pattern


def paragraphs(docs: DataFrame) -> DataFrame:
    """(h, n, run, line, paragraph) of every non-blank line, and of every run of lines between
    blank ones (line -1; a run of one line is that line); h and n identify the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(F.xxhash64(text).alias("h"), F.length(text).alias("n"),
                       F.posexplode(F.split(text, BLANK)).alias("run", "body"))
    lines = F.split("body", r"\n")
    each = F.transform(lines, lambda l, i: F.struct(i.alias("line"), l.alias("paragraph")))
    whole = F.struct(F.lit(-1).alias("line"), F.col("body").alias("paragraph"))
    return (runs.select("h", "n", "run", F.inline(F.when(F.size(lines) > 1, F.array_append(each, whole)).otherwise(each)))
            .filter(F.length(F.trim("paragraph")) > 0))


def train(spark: SparkSession, docs: DataFrame, templates=tuple(TEMPLATES), negatives: int = NEGATIVES,
          seed: int = 7) -> Model:
    """Fit on template variants and a bounded sample of corpus paragraphs.

    A variant drops about one word in ten and may sit between corpus-like words.  An empty
    corpus trains on the templates and ``OTHERS`` alone.
    """
    vocabulary = features(templates)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = docs.select(key.alias("_key")).distinct().orderBy("_key").limit(SAMPLE_DOCS)
    sampled = docs.select("text", key.alias("_key")).join(F.broadcast(some), "_key").dropDuplicates(["_key"])
    sample = written(spark, paragraphs(sampled).filter("line >= 0").select("paragraph").distinct()
                     .orderBy(F.xxhash64("paragraph"), "paragraph").limit(negatives), "license-sample")
    pattern, listed = candidate_pattern(vocabulary), candidate_pattern([g for g in vocabulary if " " not in g])
    families = [UNKNOWN, *sorted({f for f, _ in templates})]

    base = literal_rows(spark, [(f, t, i) for i, (f, t) in enumerate(templates)], "family string, text string, no int")
    copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    kept = F.filter(words(F.col("text")), lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(
        F.lit(seed), F.col("no"), F.col("copy"), i), F.lit(10)) > 0))
    good = copies.select("family", kept.alias("ws"))
    plain = sample.filter(~F.lower("paragraph").rlike(listed)).select(
        F.lit(UNKNOWN).alias("family"), words(F.col("paragraph")).alias("ws")).filter(
        F.size(F.array_intersect(grams(F.col("ws")), F.array(*map(F.lit, vocabulary)))) < AMBIGUOUS)
    other = literal_rows(spark, [(t,) for t in OTHERS], "text string").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS * 4 - 1)))).select(
        F.lit(UNKNOWN).alias("family"), F.filter(words(F.col("text")), lambda w, i: F.pmod(F.xxhash64(
            F.lit(seed), F.col("text"), F.col("copy"), i), F.lit(6)) > 0).alias("ws"))
    rows = written(spark, good.unionAll(plain).unionAll(other).select(
        F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double").alias("place"),
        grams(F.col("ws")).alias("grams"), F.monotonically_increasing_id().alias("id")).withColumn("label", F.col("place") - 1),
        "license-train")

    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x")
    counter = counter.setMinTF(1.0)
    held = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) == 0
    lr = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", elasticNetParam=0.7,
                            regParam=2e-4, maxIter=60, standardization=False)
    vectors = counter.transform(rows)
    fitted = lr.fit(vectors.filter(~held))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    weights = literal_rows(
        spark, [(g, [float(v) for v in matrix[:, k]]) for k, g in enumerate(vocabulary) if abs(matrix[:, k]).max() > 0],
        "gram string, w array<double>")
    model = Model(families, weights, intercepts, 1.0, 0.0, pattern)
    # calibration: margin of the best family over unknown -> probability of being a licence
    margins = _margins(rows.filter(held), model, ["id"]).join(rows.select("id", "label"), "id").select(
        (F.col("label") > 0).cast("double").alias("label"), F.array("margin").alias("m"))
    from pyspark.ml.functions import array_to_vector
    cal = LogisticRegression(featuresCol="x", maxIter=50, regParam=1e-3).fit(
        margins.select("label", array_to_vector("m").alias("x")))
    if cal.numClasses == 2 and cal.coefficients[0] > 0:
        model.slope, model.shift = float(cal.coefficients[0]), float(cal.intercept)
    return model


def _margins(rows: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """``rows (key, grams)`` -> key, best family's number and its margin over unknown.

    The weight table (template n-grams, fixed size) goes to every task; sums are made in order
    of the n-grams' weights, so reruns agree.
    """
    k = len(model.families)
    hit = rows.select(*key, F.explode_outer("grams").alias("gram")).join(F.broadcast(model.weights), "gram", "left")
    sums = [F.sum(F.coalesce(F.round(F.get("w", i), 9).cast("decimal(18,9)"), F.lit(0))).cast("double")
            + F.lit(model.intercepts[i]) for i in range(k)]
    logits = hit.groupBy(*key).agg(F.array(*sums).alias("z"))
    best = F.array_max(F.transform(F.slice("z", 2, k - 1), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return logits.withColumn("best", best).select(
        *key, (F.lit(1) - F.col("best.i")).alias("family"), (F.col("best.v") - F.get("z", 0)).alias("margin"))


def scan(spark: SparkSession, docs: DataFrame, model: Model, templates=tuple(TEMPLATES)) -> DataFrame:
    """Licence paragraphs ``(h, n, run, line, family, probability, likeness, confirmed)`` of all
    texts, each distinct text once (h, n: its hash and length); unknown ones are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.filter(F.lower(text).rlike(model.pattern))
    of_templates = sorted({g for _, t in templates for ws in [_python_words(t)]
                           for g in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]})
    key = ["h", "n", "run", "line"]
    asked = written(spark, paragraphs(some).filter(F.lower("paragraph").rlike(model.pattern)).select(*key, F.array_intersect(
        grams(words(F.col("paragraph"))), F.array(*map(F.lit, of_templates))).alias("grams")), "license-paragraphs")
    asked = asked.dropDuplicates(key)
    names = F.array(*[F.lit(f) for f in model.families])
    found = _margins(asked, model, key).withColumn(
        "probability", 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift)))).filter("probability >= 0.5")
    found = found.select(*key, F.get(names, F.col("family")).alias("family"), "probability")
    known = literal_rows(spark, templates, "family string, template string").select(
        "family", F.filter(grams(words(F.col("template"))), lambda g: F.contains(g, F.lit(" "))).alias("shape"))
    like = F.size(F.array_intersect("grams", "shape")) / F.size("shape")
    judged = found.join(asked, key).join(F.broadcast(known), "family")
    return judged.groupBy(*key, "family", "probability").agg(F.max(like).alias("likeness")).withColumn(
        "confirmed", F.col("likeness") >= CONFIRM)


def document_licenses(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``licenses`` (confirmed families, sorted and
    comma-joined; empty for none), ``n_confirmed`` and ``n_unconfirmed`` paragraphs.
    A run of lines counts only for what its lines do not show: confirmed, if none of them is
    for its family (whose unconfirmed lines are then parts of it); unconfirmed, if none is named.
    Null texts are empty; repeated rows, ties and null ids are kept."""
    line, sure = F.col("line") >= 0, F.col("confirmed")
    of_family = scan(spark, docs, model).groupBy("h", "n", "run", "family").agg(
        F.count(F.when(line & sure, 1)).alias("yes"), F.count(F.when(line & ~sure, 1)).alias("no"),
        F.count(F.when(~line & sure, 1)).alias("run_yes"), F.count(F.when(~line & ~sure, 1)).alias("run_no"))
    joined = (F.col("yes") == 0) & (F.col("run_yes") > 0)
    of_run = of_family.groupBy("h", "n", "run").agg(
        F.collect_set(F.when((F.col("yes") > 0) | joined, F.col("family"))).alias("families"),
        F.sum(F.when(joined, 1).otherwise(F.col("yes"))).alias("yes"), F.sum(F.when(joined, 0).otherwise(F.col("no"))).alias("no"),
        F.sum(F.col("yes") + F.col("no")).alias("lines"), F.sum("run_no").alias("run_no"))
    found = of_run.groupBy("h", "n").agg(
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("families"))))).alias("licenses"),
        F.sum("yes").alias("n_confirmed"),
        F.sum(F.when(F.col("lines") == 0, F.col("run_no")).otherwise(F.col("no"))).alias("n_unconfirmed"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    return rows.join(found, ["h", "n"], "left").select(
        "doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return document_licenses(spark, docs, train(spark, docs))

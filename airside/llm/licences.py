"""Licence scans: a trained paragraph classifier, confirmed by templates (operator 2).

A paragraph is a line, or lines that were wrapped, without marks of comments; to the classifier
it is the set of its words and word pairs. Sparse multinomial logistic regression tells licence
families from licence talk of no known family (``unknown``) and from other text (``none``). It
is trained on variants of the templates below and on a bounded sample of the corpus's own
paragraphs as other text. Rows kept from training calibrate its probabilities (a temperature),
and the variants of whole families that a second fit never saw calibrate how probable a family
must be. A prediction is confirmed by the share of a template's word triples that the paragraph
holds; otherwise it is reported as unknown.

Main path: DataFrame operations and Spark's own estimators and models only. Each paragraph is
scored in its row, so that nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.llm.common import materialise, sample_texts

#: Corpus paragraphs in the training sample: differing ones, of least hash.
SAMPLE = 8000
#: Variants of each template; each leaves out about one word in ten.
VARIANTS = 12
VOCABULARY = 1 << 14
#: Share of a template's word triples that confirms a prediction.
CONFIRM = 0.6
#: Share of held-out rows of no known family that may pass for one.
FALSE_ACCEPTS = 0.005
#: Every so many-th family is left out of the fit that sets the least probability.
UNSEEN = 4

#: Licence notices by family, as projects print them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "Released under CC0 1.0, dedicated to the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Released under the ISC License."),
    ("unknown", "All rights reserved."),
    ("unknown", "Distributed under the terms of the license in the LICENSE file."),
    ("unknown", "This work is licensed under its own terms."),
    ("unknown", "Licensed under a custom license, version 1.0."),
    ("unknown", "Released under the house license."),
    ("unknown", "You may not copy or redistribute this software without written permission."),
    ("unknown", "Licensed for internal use only under a commercial agreement."),
    ("unknown", "Copyright the authors. Use is subject to license terms."),
]


def words(text: Column) -> Column:
    """Lower-case words; hyphens, dots and blanks separate them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: a generator, through which neither filters
    nor later expressions are pulled down. (A plain column's expression is worked out again at
    each mention, and for each element in a lambda.)"""
    return df.withColumn(name, F.explode(F.array(value)))


# The functions below take a column that holds words, not an expression that makes them.
def _pairs(a: Column, b: Column, skip: int) -> Column:
    """``a`` with, after a blank, the elements of ``b`` from number ``skip`` (from 1) on; the shorter one ends."""
    joined = F.zip_with(a, F.slice(b, F.lit(skip), F.greatest(F.size(b) - (skip - 1), F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(joined, lambda p: p.isNotNull())


def triples(w: Column) -> Column:
    """Distinct runs of three words."""
    return F.array_distinct(_pairs(_pairs(w, w, 2), w, 3))


def all_terms(w: Column) -> Column:
    """Words and pairs of neighbours, with repeats."""
    return F.concat(w, _pairs(w, w, 2))


def terms(w: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    return F.array_distinct(all_terms(w))


_MARKS = r"(?m)^[ \t]*(?:/?\*+/?|//+|#+|--+|;+|%+|<!--|>+)[ \t]*"
_WRAP = r"(?<![.!?:;\s])[ \t]*(?:\r\n|\r|\n)(?=[ \t]*\S)"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), text of every paragraph that has more than blanks.

    Marks of comments at the start of a line go. A line that ends without a stop goes on in the
    next one, unless that is blank.
    """
    whole = F.regexp_replace(F.regexp_replace("text", _MARKS, ""), _WRAP, " ")
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(whole, r"\r\n|\r|\n")).alias("paragraph", "text"))
    return lines.where(F.length(F.trim("text")) > 0)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string")


def training_rows(spark: SparkSession, lines: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """family, w (words), held: variants of the templates, and at most ``sample`` differing corpus paragraphs."""
    templates = template_table(spark).withColumn("w", words(F.col("text")))
    many = templates.select("template", "family", "w", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    kept = F.filter("w", lambda x, i: (F.col("variant") == 0) | (F.pmod(F.hash(x, i, F.col("variant"), F.col("template")), F.lit(10)) != 0))
    varied = many.select("family", "variant", kept.alias("w"))
    positive = varied.select("family", "w", (F.col("variant") % 4 == 3).alias("held"))
    drawn = sample_texts(lines, sample)
    known = F.broadcast(templates.select(F.explode(triples(F.col("w"))).alias("triple")).groupBy().agg(F.collect_set("triple").alias("known")))  # one row
    held = drawn.withColumn("w", words(F.col("text"))).withColumn("has", triples(F.col("w")))
    other = held.crossJoin(known).where(~F.arrays_overlap("has", "known"))  # a notice is no example of other text
    negative = other.select(F.lit("none").alias("family"), "w", (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(4)) == 3).alias("held"))
    blank = spark.createDataFrame([("none", [], False)], "family string, w array<string>, held boolean")  # other text even if the corpus has none
    return positive.unionByName(negative).unionByName(blank)


class Classifier:
    """A fitted model with its vocabulary and families, a temperature and the least probability."""

    def __init__(self, vectors: CountVectorizerModel, model, families: list[str]):
        self.vectors, self.model, self.families = vectors, model, families
        self.temperature, self.least = 1.0, 0.5

    def logits(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words ``w``) that have a known term, with logits (an array in the order of families)."""
        # A constant list: one hash set for all rows, where an array of terms would be hashed for each.
        known = F.array_distinct(F.filter(all_terms(F.col("w")), lambda t: t.isin(self.vectors.vocabulary)))
        held = once(rows, "known", known).where(F.size("known") > 0)
        scored = self.model.transform(self.vectors.transform(held))
        return once(scored, "logits", vector_to_array("rawPrediction")).drop("known", "features", "rawPrediction", "probability", "prediction")

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with family and probability of the best class but ``none``, and that of ``none``.

        Rows without a known term are left out; to them ``none`` is the most probable class.
        """
        scaled = self.logits(rows).withColumn("top", F.array_max("logits"))
        raised = once(scored_by(scaled, self.temperature), "total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
        names = F.array(*[F.lit(f) for f in self.families])
        best = F.array_max(F.filter(F.zip_with("p", names, lambda p, f: F.struct((p / F.col("total")).alias("p"), f.alias("f"))), lambda x: x["f"] != "none"))
        none = F.element_at("p", self.families.index("none") + 1) / F.col("total")
        found = once(raised, "best", F.struct(best.alias("b"), none.alias("none")))
        return found.select(*rows.columns, F.col("best.b.f").alias("family"), F.col("best.b.p").alias("probability"), F.col("best.none").alias("none"))


def scored_by(rows: DataFrame, temperature: float) -> DataFrame:
    """``p``: the logits raised, relative to the highest one."""
    return once(rows, "p", F.transform("logits", lambda x: F.exp((x - F.col("top")) / F.lit(temperature))))


def _fit(rows: DataFrame, vocabulary: list[str]) -> Classifier:
    """A classifier of the families in ``rows``: other text weighs as much as all licences, these alike."""
    sizes = {r[0]: r[1] for r in rows.groupBy("family").count().collect()}
    families = sorted(sizes)
    shares = {f: len(families) - 1 if f == "none" else 1 for f in families}
    number = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    balance = F.create_map(*[F.lit(x) for f, n in sizes.items() for x in (f, shares[f] * sum(sizes.values()) / sum(shares.values()) / n)])
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="known", outputCol="features", binary=True)
    ready = vectors.transform(rows.withColumn("known", terms(F.col("w")))).select("features", number[F.col("family")].alias("label"), balance[F.col("family")].alias("balance"))
    fit = LogisticRegression(maxIter=40, regParam=0.0005, elasticNetParam=0.5, family="multinomial", weightCol="balance", standardization=False, aggregationDepth=2).fit(ready)
    return Classifier(vectors, fit, families)


def _temperature(model: Classifier, held: DataFrame) -> float:
    """The temperature under which the held rows' families are most probable."""
    truth = F.create_map(*[F.lit(x) for i, f in enumerate(model.families) for x in (f, i + 1)])[F.col("truth")]
    tried = model.logits(held).withColumn("t", F.explode(F.array(*[F.lit(0.25 * 1.25**i) for i in range(16)])))
    shifted = F.transform("logits", lambda x: F.exp((x - F.array_max("logits")) / F.col("t")))
    loss = F.log(F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)) - (F.element_at("logits", truth) - F.array_max("logits")) / F.col("t")
    best = tried.groupBy("t").agg(F.avg(loss).alias("loss")).orderBy("loss", "t").first()
    return best["t"] if best else 1.0


def train(spark: SparkSession, lines: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit and calibrate the classifier; ``lines`` are the corpus's paragraphs.

    The least probability is the smallest at which at most FALSE_ACCEPTS of the rows that belong
    to no family known to the second fit (other text, and variants of the families left out of
    it) pass for a known family; rows without a known term count as passing for none.
    """
    rows = materialise(training_rows(spark, lines, sample), "licence-rows")
    # Terms of the templates only: other words can't tell a licence.
    vocabulary = sorted({r[0] for r in template_table(spark).withColumn("w", words(F.col("text"))).select(F.explode(terms(F.col("w")))).distinct().collect()})[:VOCABULARY]
    found = _fit(rows.where("NOT held").select("family", "w"), vocabulary)
    held = rows.where("held").withColumnRenamed("family", "truth")
    found.temperature = _temperature(found, held)
    unseen = [f for f in sorted({f for f, _ in TEMPLATES} - {"unknown"})[::UNSEEN]]
    second = _fit(rows.where(~F.col("held") & ~F.col("family").isin(unseen)).select("family", "w"), vocabulary)
    second.temperature = found.temperature
    strangers = rows.where(F.col("family").isin(unseen) | (F.col("held") & F.col("family").isin("none", "unknown"))).withColumnRenamed("family", "truth")
    allowed = int(strangers.count() * FALSE_ACCEPTS)
    passing = second.probabilities(strangers).where("family <> 'unknown' AND none < 0.5").orderBy(F.col("probability").desc()).limit(allowed + 1).collect()
    found.least = max(0.5, min(0.99, passing[-1]["probability"])) if len(passing) > allowed else 0.5
    return found


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, paragraph, family, probability, template_share, confirmed of every licence paragraph.

    A paragraph is reported if the classifier finds a licence more likely than other text. Its
    family is ``unknown`` if the class is, if the probability is below the calibrated one, or if
    no template of the family confirms it. Null and empty texts have no paragraphs. Each row is
    scanned by itself: repeated rows, rows of one doc_id and rows without one are each reported.
    Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs)
    model = train(spark, lines, sample)
    ready = once(lines, "w", words(F.col("text"))).drop("text")
    likely = model.probabilities(ready).where(F.col("none") < 0.5)
    known = template_table(spark).withColumn("w", words(F.col("text"))).select("family", triples(F.col("w")).alias("wanted")).groupBy("family").agg(F.collect_list("wanted").alias("templates"))
    met = once(likely.join(F.broadcast(known), "family", "left"), "has", triples(F.col("w")))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("has"))) / F.greatest(F.size(t), F.lit(1))))
    judged = once(met, "template_share", F.round(F.coalesce(share, F.lit(0.0)), 4))
    sure = (F.col("family") != "unknown") & (F.col("probability") >= model.least) & (F.col("template_share") >= CONFIRM)
    return judged.select("doc_id", "paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), F.round("probability", 4).alias("probability"), "template_share", sure.alias("confirmed"))

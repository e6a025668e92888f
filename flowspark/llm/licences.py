"""Licence scans: a trained classifier of paragraphs names licence families, and templates confirm them.

Paragraphs are runs of lines between lines without a word, comment marks stripped; of a run of several lines each single line
is judged too, since a notice may stand among lines of other text. A find of a whole run stands under the number of its
first line with ``lines`` > 1, unless one of its lines is confirmed for the family; a line has ``lines`` 1. Features are the words
and pairs of words that the notices have, and how much of a paragraph they are; multinomial logistic regression with a class for
everything else learns from the notices, whole, wrapped and with words around them, from the licences' names in usual frames, and
from all the corpus' own paragraphs, which together weigh ``OTHERS`` at most. A family is predicted if it is the likeliest class
and its probability is above what 99.9 % of the other paragraphs get for it, and at least ``LEAST``; else the paragraph is of
unknown class. A prediction is confirmed if the paragraph holds at least ``SHARE`` of the distinct words of one of the family's
templates. All of it runs in the JVM: texts are cut once, and their features written aside for training and prediction.

Cases: null and empty texts have no paragraphs; very long paragraphs are classified whole and line by line; repeated rows give repeated finds;
an empty table gives no rows (the classifier then learns from templates and a fixed contrast only); other columns play no
part, ids are only carried along.
"""

from __future__ import annotations

import math
import textwrap
from collections.abc import Callable
from functools import cache, reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stashed, table

# Notices of well-known licences, as their texts ask for them.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
               "the License for the specific language governing permissions and limitations under the License."),
    "bsd": ("Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
            "PURPOSE ARE DISCLAIMED."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License.",
              "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
              "license, visit http://creativecommons.org/licenses/by/4.0/"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.",
                 "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a "
                 "copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.",
                 "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a "
                 "copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
            "details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see "
            "https://www.gnu.org/licenses/."),
    "mit": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in "
            "the Software without restriction.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
            "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "public-domain": ("This work has been dedicated to the public domain under CC0 1.0.",
                      "This is free and unencumbered software released into the public domain.",
                      "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                      "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
                      "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                      "this work."),
    "reserved": ("All rights reserved.", "Copyright by the authors. All rights reserved.",
                 "No part of this work may be reproduced or transmitted in any form without the prior written permission of the "
                 "copyright holder."),
}
# Names that people give the licences, and what they write around them: for training.
NAMES = {
    "apache": ("Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"),
    "bsd": ("BSD 3-Clause License", "BSD license", "BSD-3-Clause"),
    "cc-by": ("Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "gpl": ("GNU General Public License", "GNU GPL, version 3", "GPL-3.0-or-later"),
    "mit": ("MIT License", "MIT licence", "MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0"),
    "public-domain": ("public domain", "CC0 1.0 Universal", "CC0-1.0"),
    "reserved": (),
}
FRAMES = ("{}", "Licensed under the {}.", "This project is licensed under the terms of the {}.", "Released under the {}, see LICENSE.",
          "SPDX-License-Identifier: {}", "License: {}", "Distributed under the {}.", "It is available under the {}.")
# Words around notices, and sentences that use their words without being notices.
BEFORE = ("", "This file is", "The code is", "Copyright 2021 The Authors.", "Content is")
AFTER = ("", "See the file for details.", "Some parts differ.")
CONTRAST = ("The driver has a licence and the car is free.", "The general public was permitted to use the work rooms.",
            "Version 2.0 of the software is used by the foundation.", "The source of the river is in the north.",
            "He was charged and then released.", "All of them reserved rooms.")
#: What the paragraphs of the corpus weigh together in training, at most; a notice weighs 25.
OTHERS = 20_000.0
LEAST = 0.6
SHARE = 0.8
#: Paragraphs of the corpus with this share of a template, or with a licence's name, teach nothing: they may be notices.
DOUBT = 0.5
WORD = r"[\p{L}\p{N}]"
# Columns at which training notices are wrapped.
WIDTHS = (70, 80)
STEPS = 30


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def marked(words: Column) -> Column:
    """The words, null for those that no notice has."""
    return F.transform(words, lambda word: F.when(word.isin(_vocabulary()[0]), word))


def paragraphs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``paragraph`` (number of the first line, from 0), ``lines`` (how many), ``run`` and ``marked``.

    There is a row for each run of lines with words, and for each line of a run of several. ``marked`` are the words in the order
    of the text, null for those that no notice has; what comment marks there are holds no word. Rows of the same run of a text
    have the same ``run``.
    """
    value = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    split = documents.select(F.col(id).alias("doc_id"), F.split(value, "\n").alias("all"), F.xxhash64(F.col(text)).alias("hash"))
    # A line without words ends a run: its number is what the lines of a run have in common.
    ends = F.filter(F.transform("all", lambda line, at: F.when(~F.rlike(line, F.lit(WORD)), at)), lambda at: at.isNotNull())
    bounds = split.withColumn("ends", F.concat(F.array(F.lit(-1)), ends, F.array(F.size("all"))))
    runs = bounds.withColumn("runs", F.filter(F.zip_with(
        F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1),
        lambda a, b: F.struct((a + 1).alias("paragraph"), (b - a - 1).alias("lines"))), lambda run: run["lines"] > 0))
    runs = runs.select("doc_id", "all", "hash", F.explode("runs").alias("run"))
    runs = runs.select("doc_id", F.xxhash64("hash", "run.paragraph").alias("id"), "run.*", F.slice("all", F.col("run.paragraph") + 1, F.col("run.lines")).alias("own"))
    runs = runs.withColumn("own", F.transform("own", lambda line: marked(words(line))))  # no word goes over the end of a line
    whole = F.struct("paragraph", "lines", F.flatten("own").alias("marked"))
    each = F.transform("own", lambda line, at: F.struct(
        (F.col("paragraph") + at).alias("paragraph"), F.lit(1).alias("lines"), line.alias("marked")))
    judged = runs.select("doc_id", F.col("id").alias("run"), F.explode(F.when(F.col("lines") > 1, F.concat(F.array(whole), each)).otherwise(
        F.array(whole))).alias("p"))
    return judged.select("doc_id", "p.paragraph", "p.lines", "run", "p.marked")


def _shares(words: Column) -> dict[str, Column]:
    """Per family the largest share of a template's distinct words that the paragraph has."""
    found = {}
    for family, texts in TEMPLATES.items():
        shares = []
        for template in texts:
            known = _distinct(template)
            shares.append(F.size(F.array_intersect(words, F.array(*map(F.lit, known)))) / F.lit(float(len(known))))
        found[family] = F.greatest(*shares) if len(shares) > 1 else shares[0]
    return found


def _distinct(text: str) -> list[str]:
    return sorted(set("".join(c.lower() if c.isalnum() else " " for c in text).split()))


def _rarest(words: list[str], among: int) -> list[str]:
    """Of ``words`` the ``among`` that the fewest templates have, long ones first."""
    return sorted(words, key=lambda word: (sum(word in _distinct(t) for group in TEMPLATES.values() for t in group),
                                           -len(word), word))[:among]


def _of(words: Column, known: list[str], least: int) -> Column:
    """Whether ``words``, all different, have ``least`` of the ``known`` ones."""
    return (F.size(words) >= least) & (F.size(F.filter(words, lambda word: word.isin(known))) >= least)


def _doubtful(words: Column) -> Column:
    """Whether a paragraph may be a notice, by its distinct words."""
    asked = [(known, math.ceil(DOUBT * len(known))) for group in TEMPLATES.values() for known in map(_distinct, group)]
    asked += [(known, len(known)) for names in NAMES.values() for known in map(_distinct, names) if len(known) > 1]

    def any_of(own: Column, some: list[tuple[list[str], int]]) -> Column:
        # Who has k of n words has one of any n - k + 1 of them: without such a word nothing else is asked.
        telling = sorted({word for known, least in some for word in _rarest(known, len(known) - least + 1)})
        return F.when(F.exists(own, lambda word: word.isin(telling)),
                      reduce(lambda a, b: a | b, [_of(own, known, least) for known, least in some])).otherwise(False)

    few = [one for one in asked if one[1] <= 4]
    return bound(words, lambda own: any_of(own, few) | any_of(own, [one for one in asked if one[1] > 4]))


@cache
def _vocabulary() -> tuple[list[str], list[str]]:
    """The words of the notices, and their pairs of neighbouring words."""
    cut = ["".join(c.lower() if c.isalnum() else " " for c in text).split() for text, _, _ in _variants(sorted(TEMPLATES))]
    return (sorted({word for own in cut for word in own}),
            sorted({f"{a} {b}" for own in cut for a, b in zip(own, own[1:])}))


#: Features beside words and pairs: the notices' words are less than this share of the words. No word has such a name.
FEW = {"<1/4": 0.25, "<1/2": 0.5, "<3/4": 0.75, "<1": 1.0}


def _featured(df: DataFrame) -> DataFrame:
    """``marked`` gives way to ``known``, the distinct words that the notices have too, and ``features``."""
    single, pairs = _vocabulary()
    both = F.zip_with("marked", F.slice("marked", 2, F.greatest(F.size("marked") - 1, F.lit(0))),
                      lambda a, b: F.concat(a, F.lit(" "), b))
    some = df.select("*", F.array_compact("marked").alias("own"), F.array_distinct(F.array_compact(both)).alias("pairs"))
    few = [F.when(F.size("own") < share * F.size("marked"), F.lit(name)) for name, share in FEW.items()]
    termed = some.withColumn("known", F.array_distinct("own")).withColumn(
        "terms", F.concat("known", "pairs", F.array_compact(F.array(*few))))
    vectors = CountVectorizerModel.from_vocabulary([*single, *pairs, *FEW], "terms", "features", binary=True)
    return vectors.transform(termed).drop("marked", "own", "pairs", "terms")


def _variants(families: list[str]) -> list[tuple[str, int, float]]:
    """Notices as they are met, with the number of their family: whole, with words around, wrapped, sentence by sentence."""
    weight, out = 25.0, set()
    for label, family in enumerate(families):
        for template in TEMPLATES[family]:
            # Long notices have words enough of their own: what stands around them changes little.
            around = [(a, b) for a in BEFORE for b in AFTER] if len(template) < 150 else [("", "")]
            out |= {(" ".join(filter(None, (a, template, b))), label) for a, b in around}
            out |= {(line, label) for width in WIDTHS if len(template) > width for line in textwrap.wrap(template, width)
                    if len(line.split()) >= 6}
        out.add((" ".join(TEMPLATES[family]), label))
        out |= {(frame.format(name), label) for name in NAMES[family] for frame in FRAMES}
    return [(text, label, weight) for text, label in sorted(out)] + [(text, len(families), weight) for text in CONTRAST]


def _likely(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Paragraphs whose likeliest class is a family with a probability above ``LEAST``: its ``number``, from 0, and ``best``."""
    # The probabilities are bound to a variable: the model is evaluated once for a paragraph, whatever is made of the result.
    told = bound(vector_to_array("probability"), lambda p: F.struct(
        F.array_max(p).alias("best"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("number")))
    judged = model.transform(rows).withColumn("told", told)
    return judged.select(*[name for name in rows.columns if name != "features"], "told.*").filter(
        (F.col("best") > LEAST) & (F.col("number") < len(TEMPLATES)))


def _learned(rows: DataFrame) -> tuple[LogisticRegressionModel, list[float], DataFrame]:
    """The classifier, the least probability of each family, and the likely paragraphs, from all featured paragraphs."""
    families = sorted(TEMPLATES)
    spark = rows.sparkSession
    notices = _featured(spark.createDataFrame(_variants(families), "line string, label int, weight double").select(
        marked(words(F.col("line"))).alias("marked"), "label", "weight"))
    others = rows.filter("NOT doubtful")
    count = others.count()
    weighed = others.select("features", F.lit(len(families)).alias("label"),
                            F.lit(min(1.0, OTHERS / max(1, count))).alias("weight"))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
                               maxIter=STEPS, regParam=1e-4).fit(weighed.unionByName(notices.select(*weighed.columns)))
    likely = stashed(_likely(rows, model), "licence-likely")
    # Probabilities up to LEAST limit nothing, so the likely ones and the count of all tell what 99.9 % stay below.
    above, plain = count - math.ceil(0.999 * count), likely.filter("NOT doubtful")
    found = {row["number"]: row["n"] for row in plain.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a family
    asked = [F.percentile_approx(F.when(F.col("number") == k, F.col("best")), 1 - above / n, 10_000).alias(f"f{k}")
             for k, n in found.items() if n > above]
    limits = plain.agg(*asked).first().asDict() if asked else {}
    return model, [limits.get(f"f{k}") or LEAST for k in range(len(families))], likely


def _judged(documents: DataFrame, id: str, text: str) -> DataFrame:
    """All paragraphs with their features, and whether they are ``doubtful``."""
    return _featured(paragraphs(documents, id, text)).withColumn("doubtful", _doubtful(F.col("known")))


def train(documents: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[LogisticRegressionModel, list[float]]:
    """The classifier and the least probability of each family, from the notices and all the documents' paragraphs."""
    model, limits, _ = _learned(stashed(_judged(documents, id, text), "licence-features"))
    return model, limits


def find(documents: DataFrame, id: str = "doc_id", text: str = "text",
         trained: tuple[LogisticRegressionModel, list[float]] | None = None) -> DataFrame:
    """Paragraphs of a predicted family: ``doc_id``, ``paragraph``, ``family``, ``probability``, ``share``, ``confirmed``."""
    families = sorted(TEMPLATES)
    if trained:
        model, limits = trained
        likely = _likely(_featured(paragraphs(documents, id, text)), model)
    else:
        model, limits, likely = _learned(stashed(_judged(documents, id, text), "licence-features"))
    least = F.element_at(F.array(*map(F.lit, limits)), F.col("number") + 1)
    named_ = likely.filter(F.col("best") > least).withColumn(
        "family", F.element_at(F.array(*map(F.lit, families)), F.col("number") + 1))
    share = bound(F.struct("family", "known"), lambda row: F.coalesce(*[
        F.when(row["family"] == name, x) for name, x in _shares(row["known"]).items()]))
    predicted = named_.withColumn("share", share)
    line = (F.col("lines") == 1) & (F.col("share") >= SHARE)
    named = F.max(line).over(Window.partitionBy("doc_id", "run", "family"))
    predicted = predicted.withColumn("named", named).filter((F.col("lines") == 1) | ~F.col("named"))
    return predicted.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"),
                            "family", F.col("best").alias("probability"), "share", (F.col("share") >= SHARE).alias("confirmed"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

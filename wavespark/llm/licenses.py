"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by templates. DataFrame functions only.

1. A multinomial logistic regression (Spark ML; word 1- and 2-grams by their slots in a table of hashes) is trained on the
   templates below, on parts of them, and on unknown paragraphs: look-alikes and half of a bounded sample of the corpus.
2. The unknown class is calibrated on the other half: a family must be more probable than ``unknown_rate`` of these
   paragraphs are for any family.
3. A prediction is confirmed if enough of the paragraph's word 3-grams are those of one of the family's templates.

Paragraphs are lines. Every paragraph of every document is scored, inside its row: the weights are a constant of the plan,
and no row is exploded, joined or shuffled.

Defined cases: null and empty texts have no paragraphs and so no licences; rows that repeat are scanned each; an empty
table gives an empty table (the classifier is then trained without the corpus's sample); other columns pass through;
``licences``, ``n_licence_paragraphs`` and ``licence_score`` replace columns of their name.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound

#: Public licence texts: notices and characteristic paragraphs of each family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. Released under the Unlicense.",
    ],
}
#: Paragraphs that talk of licences but are none.
LOOKALIKES = [
    "All rights reserved.", "He has no driver's license and needs permission to travel.", "The warranty covers parts and labor for two years.", "Copyright infringement claims may be sent to our legal department.",
    "The apache helicopter was shown to the public at the air show.", "The license fee is due every year before the end of March.", "You must accept the terms of service to use this site.", "Subject to change without notice.",
    "The gnu is an antelope of the open plains.", "The city granted a liquor license to the new restaurant.", "Public domain names are registered for one year at a time.", "We make no warranty as to the fitness of the tickets sold here.",
    "The committee will redistribute the seats after the census.", "The software is sold under a commercial licence agreement.",
]
UNKNOWN = "unknown"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(w: Column, n: int) -> Column:
    """Word n-grams in order; fewer than n words are one n-gram."""
    short = F.when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(w) < n, short).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, n))))


def paragraphs(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\R+"), lambda p: F.length(F.trim(p)) > 0)


def bound(value: Column, f) -> Column:
    """f of a column that it uses several times: computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def slots(w: Column, n: int) -> Column:
    """The slots of a paragraph's words and pairs of words (the last word stands alone once more)."""
    one = F.transform(w, lambda a: F.pmod(F.xxhash64(a), F.lit(n)).cast("int"))
    two = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int"))
    return F.concat(one, two)


def numbers(values, kind: str) -> Column:
    """A constant array (a string of numbers, read once when the query is planned)."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), F.lit(f"array<{kind}>"))


class LicenceModel:
    """The trained classifier with its calibrated threshold; ``judge`` is a column of what an array of paragraphs holds.

    most_unknown: paragraphs of the corpus that the unknown class is taken from, one half to train and the other to
    calibrate on; they come from a tenth as many documents, both in the order of a hash of their text.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame | None, text: str = "text", most_unknown: int = 2000, unknown_rate: float = 0.99, confirmed: float = 0.7, features: int = 1 << 16):
        self.families, self.features, self.confirmed = [UNKNOWN, *sorted(TEMPLATES)], features, confirmed
        rows = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in LOOKALIKES]
        parts = []
        for t, f in rows:
            w = t.split()
            parts += [(t, f), (t.upper(), f)] + [(" ".join(w[i : i + max(6, len(w) // 2)]), f) for i in (0, len(w) // 4, len(w) // 2) if len(w) >= 16]
        self.templates = [[(F.array(*[F.lit(g) for g in grams]), len(grams)) for grams in self._template_grams(spark, f)] for f in self.families[1:]]
        known = spark.createDataFrame(parts, "paragraph string, family string").withColumn("held", F.lit(False))
        if docs is not None:
            some = self._some(docs, F.col(f"`{text}`"), most_unknown)
            known = known.unionByName(some.select("paragraph", F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("paragraph", F.lit(1)), F.lit(2)) == 0).alias("held")))
        label = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        terms = F.transform(F.array_distinct(bound(words(F.col("paragraph")), lambda w: slots(w, features))), lambda i: i.cast("string"))
        data = known.select(terms.alias("terms"), label.cast("double").alias("label"), "held").coalesce(1).cache()
        taught = data.where("NOT held")
        counts = CountVectorizer(binary=True, minDF=2, vocabSize=features, inputCol="terms", outputCol="features").fit(taught)
        model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(counts.transform(taught))
        at = {int(t): i for i, t in enumerate(counts.vocabulary)}
        weights = model.coefficientMatrix.toArray().T
        self.row = numbers([at.get(i, -1) for i in range(features)], "int")
        self.weights = F.from_json(F.lit("[" + ",".join("[" + ",".join(map(repr, map(float, w))) + "]" for w in weights) + "]"), F.lit("array<array<double>>"))
        self.constant = F.array(*[F.lit(float(x)) for x in model.interceptVector])
        # Calibration, on paragraphs of no family that were not trained on: how probable the likeliest family gets there.
        p = vector_to_array(F.col("probability"))
        rival = model.transform(counts.transform(data.where("held"))).select(F.array_max(F.slice(p, 2, len(self.families) - 1)).alias("p"))
        self.threshold = max(0.5, float(rival.agg(F.percentile("p", F.lit(unknown_rate))).first()[0] or 0.0))
        data.unpersist()

    def _some(self, docs: DataFrame, body: Column, most: int) -> DataFrame:
        """A bounded sample of paragraphs that are no template's."""
        count = docs.count()  # of the files, not of the texts
        # Hashes are even: somewhat more rows than are wanted lie below this bound, and only those are sorted.
        wanted = most // 10
        most_hash = hash_bound((2 * wanted + 100) / max(1, count))
        hashed = docs.select(body.alias("text"), F.xxhash64(body).alias("h")).where(F.col("h") <= F.lit(most_hash))
        lines = hashed.orderBy("h").limit(wanted).select(F.explode(paragraphs(F.col("text"))).alias("paragraph"))
        own = bound(words(F.col("paragraph")), lambda w: F.array_distinct(ngrams(w, 3)))
        like = bound(own, lambda o: F.greatest(F.lit(0.0), *[self._likeness(o, t, n) for ts in self.templates for t, n in ts]))
        return lines.where(like < self.confirmed).select("paragraph").distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(most)

    @staticmethod
    def _likeness(own: Column, template: Column, n: int) -> Column:
        """The share of the smaller one's word 3-grams that both have."""
        return F.size(F.array_intersect(own, template)) / F.greatest(F.lit(1), F.least(F.size(own), F.lit(n)))

    @staticmethod
    def _template_grams(spark: SparkSession, family: str) -> list[list[str]]:
        rows = spark.createDataFrame([(t,) for t in TEMPLATES[family]], "t string")
        return [r[0] for r in rows.select(bound(words(F.col("t")), lambda w: F.array_distinct(ngrams(w, 3)))).collect()]

    def judge(self, lines: Column) -> Column:
        """Of an array of paragraphs: those of a family, as structs of ``family``, ``probability`` and ``likeness``."""
        add = lambda acc, i: F.zip_with(acc, F.get(self.weights, F.get(self.row, i)), lambda x, y: x + y)
        # Each step is an array of its own, so that nothing is computed twice.
        split = F.transform(lines, words)
        known = lambda w: F.array_distinct(F.filter(slots(w, self.features), lambda i: F.get(self.row, i) >= 0))
        scored = F.transform(split, lambda w: F.struct(w.alias("w"), F.aggregate(known(w), self.constant, add).alias("odds")))
        best = F.transform(scored, lambda s: F.struct(s["w"].alias("w"), s["odds"].alias("odds"), F.array_max(s["odds"]).alias("top")))
        named = F.filter(best, lambda s: s["odds"][0] < s["top"])
        chance = lambda s: 1 / F.aggregate(s["odds"], F.lit(0.0), lambda acc, x: acc + F.exp(x - s["top"]))
        told = F.transform(named, lambda s: F.struct(s["w"].alias("w"), F.array_position(s["odds"], s["top"]).cast("int").alias("at"), chance(s).alias("probability")))
        likely = F.filter(told, lambda s: s["probability"] >= self.threshold)
        own = F.transform(likely, lambda s: F.struct(F.array_distinct(ngrams(s["w"], 3)).alias("own"), s["at"].alias("at"), s["probability"].alias("probability")))

        def likeness(s: Column) -> Column:
            out = F.lit(0.0)
            for i, templates in enumerate(self.templates):
                out = F.when(s["at"] == i + 2, F.greatest(F.lit(0.0), *[self._likeness(s["own"], t, n) for t, n in templates])).otherwise(out)
            return out

        names = F.array(*map(F.lit, self.families))
        compared = F.transform(own, lambda s: F.struct(F.get(names, s["at"] - 1).alias("family"), s["probability"].alias("probability"), likeness(s).alias("likeness")))
        return F.filter(compared, lambda s: s["likeness"] >= self.confirmed)


def scan(spark: SparkSession, docs: DataFrame, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """Every document with ``licences`` (sorted families), ``n_licence_paragraphs`` and ``licence_score``."""
    docs = docs.drop("licences", "n_licence_paragraphs", "licence_score")
    model = model or LicenceModel(spark, docs, text)
    found = docs.select(F.struct("*").alias("doc"), model.judge(paragraphs(F.col(f"`{text}`"))).alias("found"))
    families = F.sort_array(F.array_distinct(F.transform("found", lambda s: s["family"])))
    score = F.coalesce(F.array_max(F.transform("found", lambda s: s["probability"])), F.lit(0.0))
    return found.select("doc.*", families.alias("licences"), F.size("found").cast("long").alias("n_licence_paragraphs"), score.alias("licence_score"))

"""Licence scan: a trained paragraph classifier with template comparison.

Texts are cut into paragraphs: lines, and long lines at sentence ends.  As a
notice may be wrapped, so are all runs of neighbouring lines that a template
could span.  Those with a licence word are classified by multinomial logistic
regression over hashed word one- to three-grams; paragraphs without any can't
be notices and are passed over.  The classes are licence families and ``unknown``, which is
trained on ordinary paragraphs of the corpus and on sentences that use licence
words otherwise.  A family is accepted from a probability on that keeps held-out
predictions precise, and only if the paragraph also holds at least 0.8 of the
distinct words of one of the family's templates.  It learns from names of
licences in running text and from other wordings of their notices, half of them
for the thresholds; the templates are kept for the comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from salestide.llm.common import content_key
from salestide.session import durable

UNKNOWN = "unknown"
SAMPLE_DOCUMENTS = 1_000
FEATURES = 1 << 12
PRECISION = 0.98
SIMILARITY = 0.8

# fixed values: short notices of each family
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License", "Distributed under AGPL-3.0"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Released under CC0 1.0 Universal", "dedicated to the public domain under CC0"],
    "gpl": [
        "licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under GPL-3.0",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License", "Distributed under LGPL-3.0"],
    "mit": [
        "Released under the MIT License", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "Distributed under MPL-2.0"],
    "proprietary": ["All rights reserved", "Copyright 2020 the company. All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
}
# fixed values: how the families are called in running text; the classifier learns from these, the templates only confirm
NAMES = {
    "agpl": ["the GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "the GNU AGPL v3", "the Affero GPL, version 3", "AGPL-3.0-only", "the GNU Affero General Public Licence"],
    "apache-2.0": ["Apache License 2.0", "the Apache-2.0 licence", "the Apache Software License, Version 2.0", "Apache License, Version 2.0"],
    "bsd": ["the 3-clause BSD license", "a BSD-style licence", "BSD-2-Clause", "the simplified BSD License", "the BSD License"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 licence", "a Creative Commons Attribution International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "the Creative Commons Attribution-NonCommercial 4.0 licence", "a Creative Commons Attribution NonCommercial License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 licence", "a Creative Commons Attribution Share Alike License"],
    "cc0": ["CC0", "CC0 1.0", "the CC0 1.0 Universal dedication", "Creative Commons Zero"],
    "gpl": ["the GNU General Public License, version 3", "GNU General Public License v2.0", "the GNU GPL v3", "GPL-3.0-only", "the GNU General Public Licence, version 2", "the GNU General Public License"],
    "isc": ["the ISC licence", "ISC License", "the ISC License"],
    "lgpl": ["the GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "the GNU LGPL v3", "LGPL-2.1-or-later", "the Lesser GPL, version 3", "the GNU Lesser General Public Licence"],
    "mit": ["the MIT licence", "MIT License", "the MIT License", "MIT"],
    "mpl-2.0": ["MPL-2.0", "the Mozilla Public Licence 2.0", "the Mozilla Public License, version 2.0", "MPL 2.0"],
    "proprietary": [],
    "unlicense": ["the Unlicense", "Unlicense"],
}
# sentences around such a name
_FRAMES = [
    "Licensed under {}", "This project is licensed under {}", "Released under {}", "The code is released under {}", "Distributed under {}",
    "License: {}", "SPDX-License-Identifier: {}", "Use of this material is governed by {}", "You may copy and change this work under {}",
    "This package is distributed under the terms of {}", "Covered by {}; see the file LICENSE", "Subject to the terms of {}",
]
# wordings of notices that don't name their licence
BODIES = {
    "apache-2.0": ["You may not use these files except in compliance with the Apache License", "Files may be used only in compliance with the License, a copy of which Apache provides"],
    "bsd": ["Redistributions in source and binary forms, with or without modification, are permitted if the following conditions are met", "Use and redistribution in binary forms and in source are permitted provided that these conditions are met"],
    "cc0": ["The authors have dedicated this work to the public domain under CC0", "Dedicated to the public domain with CC0"],
    "isc": ["Permission to use, copy, modify and distribute this program for any purpose with or without fee is granted", "Permission is granted to use, copy, modify, and distribute this software for any purpose, with or without a fee"],
    "mit": ["Permission is granted, free of charge, to any person who obtains a copy of this software and its documentation files", "Permission is hereby granted free of charge to anyone obtaining a copy of the software and associated documentation"],
    "gpl": ["You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation", "Free software under the GNU General Public License published by the Free Software Foundation"],
    "proprietary": [
        form.format(owner) for owner in ("the publisher", "the authors", "Example Ltd", "the state press", "our firm")
        for form in ("Copyright 2019 {}. All rights reserved", "(c) 2018 {}, all rights reserved", "All rights reserved by {}", "All rights reserved, {}", "All rights are reserved by {}")
    ] + ["All Rights Reserved", "All rights reserved worldwide", "No part may be copied. All rights reserved", "All rights reserved. Do not copy"],
    "unlicense": ["This is free, unencumbered software released to the public domain", "Unencumbered free software, released into the public domain"],
}
# sentences that use licence words otherwise
OTHERWISE = [
    "She lost her driving license last year", "The licence fee pays for public radio", "They reserved a table for four",
    "The court spoke of copyright in general", "A fishing license costs ten dollars", "Human rights are reserved to nobody alone",
    "The software was written at MIT in the public eye", "We ask for permission to enter the building", "The public domain of the river is wide",
    "The license plate was bent", "Version 2.0 of the report is out", "He was granted free entry to the work", "The new edition has no warranty card",
    "His licence was revoked after the trial", "Copyright disputes take years to settle", "All rooms were reserved for the guests",
    "All rights reserved seats to their owners", "He owns all rights to the film", "Permission to land was granted to the pilot free of charge",
    "Students at MIT study the General Public", "The apache helicopter landed under the bridge", "A mozilla engineer spoke of public matters", "The BSD group met in the Free Software room",
    "The licence was distributed under the door", "They released the dogs under the bridge", "All rights of way were reserved rooms for debate",
]
# ends that make a sentence out of a phrase that would be a notice alone
_GOES_ON = ["rooms were taken by the guests", "is a phrase that many people misread", "was what the old sign by the door said", "came up in the talk we heard last week", "seats are kept for members of the club"]
_CUE = r"(?i)licen[sc]|copyright|all rights|public domain|permission|redistribut|spdx|\bcc0\b|\bcc[- ]by|creative commons|unencumbered|apache|mozilla|\bgnu\b|\b[al]?gpl|\bmpl\b"
_CUE_RE = re.compile(_CUE, re.ASCII)
_PARAGRAPH = r"\n+|(?<=[.!?]) +(?=\p{Lu})"
_SENTENCE = r"(?<=[.!?]) +(?=\p{Lu})"
_WORD = r"[a-z0-9]+"
_WORD_RE = re.compile(_WORD)
# lines between the first and the last one of a wrapped notice hold fewer words than the longest template; each holds one
_MOST_WORDS = max(len(re.findall(_WORD, t.lower())) for texts in TEMPLATES.values() for t in texts)
#: lines of a notice that is wrapped
MOST_LINES = 12


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def examples() -> list[tuple[str, str, int]]:
    """(text, family, part): notices in wordings of their own and other uses of their words, dealt to the fit (0) and to
    the thresholds (1)."""
    rows = []
    for family in sorted(TEMPLATES):
        forms = [frame.format(name) for name in NAMES[family] for frame in _FRAMES]
        bodies = BODIES.get(family, [])
        forms += [lead + body for body in bodies for lead in ("", "Note: ", "This program is covered as follows: ")]
        # a word left out
        for body in bodies:
            words = body.split()
            forms += [" ".join(words[:k] + words[k + 1 :]) for k in range(0, len(words), 3) if len(words) > 9]
        # frames and wordings of both parts differ
        rows += [(f, family, i % 2) for i, f in enumerate(forms)]
    plain = OTHERWISE + [f"{phrase} {end}" for phrase in ("All rights reserved", "The MIT License", "Permission", "Copyright 2019", "The public domain", "The Apache License") for end in _GOES_ON]
    return rows + [(lead + t, UNKNOWN, i % 2) for lead in ("", "Note: ") for i, t in enumerate(plain)]


def pieces(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, paragraph) of all lines, and runs of lines without a blank one, that hold a licence word.

    Lines without a word stand for nothing, so a run holds at most
    ``MOST_LINES`` lines with words, and its ends have words.
    """
    lines = [x.strip() for x in text.split("\n")]
    found, first = [], 0
    while first < len(lines):
        last = first
        while last < len(lines) and lines[last]:
            last += 1
        sizes = [len(_WORD_RE.findall(x.lower())) for x in lines[first:last]]
        worded = [k for k, n in enumerate(sizes) if n]
        block = " ".join(lines[first + k] for k in worded)
        starts = np.cumsum([0] + [len(lines[first + k]) + 1 for k in worded]).tolist()
        cues = [m.span() for m in _CUE_RE.finditer(block)]
        cue = 0
        for i, line in enumerate(worded):
            # the first cue that starts behind the start of line i
            while cue < len(cues) and cues[cue][0] < starts[i]:
                cue += 1
            if cue == len(cues):
                break
            inner = 0
            for j in range(i, min(i + MOST_LINES, len(worded))):
                if inner >= _MOST_WORDS:
                    break
                if cues[cue][1] < starts[j + 1]:
                    found.append((first + line, first + worded[j], block[starts[i] : starts[j + 1] - 1]))
                inner += sizes[worded[j]] if j > i else 0
        first = last + 1
    return found


_PIECE = StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("paragraph", StringType())])


@F.pandas_udf(ArrayType(_PIECE))
def _pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[dict(zip(("first", "last", "paragraph"), p)) for p in pieces(t)] for t in batch])


def paragraphs(docs: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """(first, last, paragraph) of all texts that hold a licence word, beside ``kept``; the lines are counted from 0."""
    # a licence word may be wrapped itself; a sentence end parts like a blank line
    flat = F.regexp_replace(text, r"\s*\n\s*", " ")
    cut = docs.where(text.rlike(_CUE) | flat.rlike(_CUE)).select(*kept, F.regexp_replace(text, _SENTENCE, "\n\n").alias("_cut"))
    names = [c for c in cut.columns if c != "_cut"]
    return cut.select(*names, F.explode(_pieces("_cut")).alias("_piece")).select(*names, "_piece.*")


def _featured(df: DataFrame, text: str) -> DataFrame:
    """Words between marks of the paragraph's start and end, so that a phrase alone differs from one that goes on."""
    return df.withColumn("words", F.concat(F.array(F.lit("^")), _words(F.col(text)), F.array(F.lit("$"))))


def _stages() -> list:
    grams = [NGram(n=n, inputCol="words", outputCol=f"grams{n}") for n in (2, 3)]
    hashed = [HashingTF(numFeatures=FEATURES, binary=True, inputCol=c, outputCol=f"hashed_{c}") for c in ("words", "grams2", "grams3")]
    return [*grams, *hashed, VectorAssembler(inputCols=[h.getOutputCol() for h in hashed], outputCol="features")]


class Scanner:
    """The fitted pipeline, its classes and the probability from which on each is accepted."""

    def __init__(self, model: PipelineModel, classes: list[str], limits: list[float]) -> None:
        self.model, self.classes, self.limits = model, classes, limits

    def classify(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with family (``unknown`` below the limit) and probability."""
        scored = self.model.transform(_featured(df, text)).withColumn("chances", vector_to_array("probability"))
        best = F.array_max("chances")
        at = F.array_position("chances", best).cast("int")
        names, limits = (F.array(*[F.lit(x) for x in values]) for values in (self.classes, self.limits))
        family = F.when(best >= F.element_at(limits, at), F.element_at(names, at)).otherwise(UNKNOWN)
        return scored.select(*df.columns, family.alias("family"), best.alias("probability"))


def fit(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Scanner:
    """Fit on written wordings and on ordinary paragraphs of at most ``sample`` documents."""
    known = docs.where(F.col(text).isNotNull())
    total = known.count()
    share = 1.0 if total <= 2 * sample else 2 * sample / total
    place = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1_000_000))
    # rows that repeat an id are in or out together, so the limit bounds the sample
    chosen = durable(known.where(place < int(share * 1_000_000)).select(text).limit(sample))
    plain = chosen.select(F.explode(F.split(F.col(text), _PARAGRAPH)).alias("text")).where(
        ~F.col("text").rlike(_CUE) & (F.length("text") > 0)
    )
    # one paragraph in every eight of the sample is enough of the ordinary class
    plain = plain.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select(
        "text", F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)).cast("int").alias("part")
    )
    classes = sorted(TEMPLATES) + [UNKNOWN]
    rows = spark.createDataFrame(examples(), "text string, family string, part int").union(plain)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    # a small table, cut in few tasks for each of the many short jobs once it is written
    rows = durable(_featured(rows, "text").withColumn("label", number.cast("double"))).coalesce(2)
    model = Pipeline(stages=[*_stages(), LogisticRegression(maxIter=40, regParam=0.0003, family="multinomial")]).fit(rows.where("part = 0"))
    held = model.transform(rows.where("part = 1")).select("label", "prediction", vector_to_array("probability").alias("chances"))
    # a bounded sample
    found = held.select("label", "prediction", F.array_max("chances").alias("best")).toPandas()
    limits = []
    for k in range(len(classes)):
        own = found[found["prediction"] == k]
        limits.append(_limit(own["best"].to_numpy(), (own["label"] == k).to_numpy()))
    return Scanner(model, classes, limits)


def _limit(best: np.ndarray, right: np.ndarray) -> float:
    """The lowest probability, of one half or more, from which on predictions are precise; infinite where there is none."""
    order = np.argsort(-best, kind="stable")
    ranked = best[order]
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    # equal probabilities are accepted together
    ends = np.append(ranked[1:] != ranked[:-1], True) if len(ranked) else np.zeros(0, bool)
    good = np.flatnonzero((share >= PRECISION) & ends)
    return max(0.5, float(ranked[good[-1]])) if len(good) else float("inf")


def confirmed(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``found`` with ``similarity``: the largest share of a template's words that the paragraph holds, of its family's templates."""
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    # a fixed table of some thirty rows
    templates = spark.createDataFrame(rows, "template_family string, template string").select(
        "template_family", F.array_distinct(_words(F.col("template"))).alias("template_words")
    ).groupBy("template_family").agg(F.collect_list("template_words").alias("templates"))
    met = found.join(F.broadcast(templates), found["family"] == F.col("template_family"), "left")
    own = _words(F.col("paragraph"))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))
    return met.select(*found.columns, F.coalesce(share, F.lit(0.0)).alias("similarity"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row_key, first, last, paragraph, family, probability, similarity) of every line with a licence word, and of
    every run of lines that is a notice.

    Family is ``unknown`` where the classifier is not sure or no template
    confirms it.  Null and empty texts have no paragraphs.
    """
    spark = docs.sparkSession
    scanner = fit(spark, docs, key, text)
    rows = paragraphs(docs, F.col(text), F.col(key).alias("doc"), content_key(F.col(key), F.col(text)).alias("row_key"))
    found = confirmed(spark, scanner.classify(rows, "paragraph"))
    sure = F.when(F.col("similarity") >= SIMILARITY, F.col("family")).otherwise(UNKNOWN)
    return found.withColumn("family", sure).where((F.col("first") == F.col("last")) | (F.col("family") != UNKNOWN))


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, licences, notices, unknown): one row per document, with its families in order and both counts.

    Of the runs of lines that are notices those count that hold no smaller one;
    of runs of one family that overlap, the first.  A line with a licence word
    is unknown unless it belongs to a notice.
    """
    # repeated rows share a key and their paragraphs
    found = scan(docs, key, text).groupBy("row_key").agg(F.collect_set(F.struct("first", "last", "family")).alias("all"))
    found = found.select("row_key", "all", F.array_sort(F.filter("all", lambda x: x["family"] != UNKNOWN)).alias("known"))
    inside = lambda y, x: (y["first"] >= x["first"]) & (y["last"] <= x["last"])
    smaller = lambda y, x: inside(y, x) & (y["last"] - y["first"] < x["last"] - x["first"])
    found = found.select("row_key", "all", F.filter("known", lambda x: ~F.exists("known", lambda y: smaller(y, x))).alias("known"))
    meets = lambda y, x: (y["family"] == x["family"]) & (y["first"] < x["first"]) & (y["last"] >= x["first"])
    found = found.select(
        "row_key", F.filter("known", lambda x: ~F.exists("known", lambda y: meets(y, x))).alias("notices"),
        F.filter("all", lambda x: (x["family"] == UNKNOWN) & ~F.exists("known", lambda y: inside(x, y))).alias("unknown"),
    ).select(
        "row_key", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))).alias("licences"),
        F.size("notices").cast("long").alias("notices"), F.size("unknown").cast("long").alias("unknown"),
    )
    rows = docs.select(F.col(key).alias("doc"), content_key(F.col(key), F.col(text)).alias("own_key"))
    return rows.join(found, rows["own_key"] == found["row_key"], "left").select(
        "doc", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("notices", F.lit(0)).alias("notices"), F.coalesce("unknown", F.lit(0)).alias("unknown"),
    )

"""Licence scans: a sparse logistic regression on words and word pairs names the licence families of each paragraph.

Paragraphs are what stands between blank lines, with line breaks and comment marks taken out, so a wrapped notice is whole. They
are read in windows of WINDOW words, each half over the next, so a notice of up to half a window is whole in one of them however long
the paragraph is.

The classifier is trained here: on the notices below, on parts of them, and on the windows of all of the corpus' own
paragraphs, those that share words with notices included. Its features are the words and pairs of the notices that
ordinary windows seldom have; its penalty leaves few weights. Windows with the same features are one row with a weight in the fit. All that is scored is DataFrame operations: the grams of
the texts meet the few known grams in a broadcast join, and only what is met goes on. A family must be likelier than
a threshold that ordinary windows hardly ever reach, and one of its notices must confirm it: most of its grams must be there, and
most of those that tell it from each similar notice of another family (such as the version). Else the paragraph is ``unknown``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.shared import ascii_lower, written

#: Common notices of licence families, of up to half a window each.
NOTICES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License."],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "This work has been released into the public domain."],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
}

NONE, UNKNOWN = "none", "unknown"
#: Words of a window; windows begin at every half of it.
WINDOW = 80
#: Grams that a larger share of the corpus' windows have tell nothing and are no features.
COMMON = 0.02
#: In the fit a notice, or a part of one, weighs so much, and all ordinary windows together at most so many times as much as all notices.
NOTICE_WEIGHT = 4.0
ORDINARY_WEIGHT = 10.0
#: The share of ordinary windows that may reach the threshold, the least threshold, and the least overlap with a notice.
FALSE_SHARE = 0.001
LEAST = 0.5
OVERLAP = 0.7
#: Notices of two families that share so much of one are compared by what only that one has.
SIMILAR = 0.5

#: Fixed: marks of comments at the start of a line.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|<!--|dnl\b|rem\b)[ \t]*"
BLANK_LINE = r"\n[ \t\r]*\n\s*"
BETWEEN = r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+|\.(?![0-9])|(?<![0-9])\."

KEY = ("id", "text_hash", "paragraph")


class Notice(NamedTuple):
    """A notice's telling grams, and for each similar notice of another family those that only this one has."""

    family: str
    grams: list[str]
    rivals: list[list[str]]


class Fitted(NamedTuple):
    """``weights``: table of ``hash``, ``gram`` and ``weights`` by family (the first is none); what the driver holds is bounded by the notices."""

    weights: DataFrame
    intercepts: dict[str, float]
    threshold: float
    notices: list[Notice]


def words(text: Column) -> Column:
    """Words in lower case (A-Z); hyphens and points within numbers belong to them."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("t"))
    cut = F.split(F.regexp_replace("t", COMMENT, ""), BLANK_LINE)
    return rows.select("id", "text_hash", F.posexplode(cut).alias("paragraph", "p"))


def _grams(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``at`` (place of the word in column ``p``) and ``hash``, of each word and of each pair of neighbours."""
    # Exploding an array of one computes the words once for all that reads them.
    split = paragraphs.select(*keys, F.explode(F.array(words(F.col("p")))).alias("w"))
    pairs = split.select(*keys, "w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    placed = pairs.select(*keys, F.posexplode(F.arrays_zip("w", "next")).alias("at", "pair"))
    both = F.array(F.xxhash64("pair.w"), F.xxhash64("pair.w", "pair.next"))
    return placed.select(*keys, "at", F.explode(both).alias("hash"))


def _met(grams: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """``keys``, ``window`` and ``met``, the different known grams in each window that has one."""
    met = grams.join(F.broadcast(known), "hash")  # known: the notices' grams
    half = F.floor(F.col("at") / (WINDOW // 2)).cast("int")
    windows = F.explode(F.array_distinct(F.array(half, F.greatest(half - 1, F.lit(0))))).alias("window")
    others = [c for c in known.columns if c != "hash"]
    return met.select(*keys, windows, *others).groupBy(*keys, "window").agg(F.collect_set(F.struct(*others)).alias("met"))


def _window_sets(paragraphs: DataFrame, known: list[int]) -> DataFrame:
    """``h``, ``n`` (words) and ``sets``: for each window the different known hashes in it. The grams and windows of :func:`_met`, by row."""
    half = WINDOW // 2
    split = paragraphs.select("h", F.explode(F.array(words(F.col("p")))).alias("w"))
    next_words = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    hashes = F.struct(F.transform("w", lambda w: F.xxhash64(w)).alias("ones"), F.zip_with("w", next_words, lambda w, x: F.xxhash64(w, x)).alias("twos"))
    hashed = split.select("h", F.size("w").alias("n"), F.explode(F.array(hashes)).alias("g"))
    # Few of them are in a paragraph, so its windows are held against few.
    some = F.array_intersect(F.concat("g.ones", "g.twos"), F.array(*map(F.lit, known)).cast("array<long>"))
    hashed = hashed.select("h", "n", "g", F.explode(F.array(some)).alias("some"))
    within = lambda k: F.concat(*[F.slice(hashed[f"g.{c}"], k * half + 1, F.lit(WINDOW)) for c in ("ones", "twos")])
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / half).cast("int"), F.lit(0)))
    return hashed.select("h", "n", F.transform(places, lambda k: F.array_intersect(within(k), F.col("some"))).alias("sets"))


def _nth_largest(table: DataFrame, value: str, n: int) -> float | None:
    """The exact ``n``-th largest ``value``, each row counted ``n`` times by its column; null if there are fewer. 1,001 sums at most come to the driver."""
    low, high = table.agg(F.min(value), F.max(value)).head()
    while low is not None:
        place = F.floor((F.col(value) - low) / ((high - low) or 1.0) * 1000)
        within = table.filter(F.col(value).between(low, high)).groupBy(place.alias("place"))
        parts = within.agg(F.sum("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        low = None
        for part in sorted(parts, key=lambda r: -r["low"]):
            if n <= part["n"]:
                low, high = part["low"], part["high"]
                break
            n -= part["n"]
        if low == high:
            return low
    return None


def _telling_notices(common: set[str], grams_of: dict[tuple[str, int], list[str]]) -> list[Notice]:
    telling = {key: [g for g in grams if g not in common] for key, grams in grams_of.items()}
    out = []
    for (family, n), grams in telling.items():
        mine = set(grams_of[family, n])
        rivals = []
        for (other, m), theirs in grams_of.items():
            if other != family and len(mine & set(theirs)) >= SIMILAR * len(mine):
                only = [g for g in grams if g not in theirs]
                if only:
                    rivals.append(only)
        if grams:
            out.append(Notice(family, sorted(grams), rivals))
    return out


def fit_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Fitted:
    """Fit on the notices and on the different paragraphs of the corpus, all of them.

    Windows that hold a whole notice are no ordinary ones; all others are, however much they share with notices. Half of
    them, by a hash, is fitted on, the other half sets the threshold. Each of a half counts the same.
    """
    spark = docs.sparkSession
    families = [NONE, *sorted(NOTICES)]
    rows = [(family, n, notice) for family in NOTICES for n, notice in enumerate(NOTICES[family])]
    cuts = []
    for family, n, notice in rows:
        parts = notice.split()
        some = [parts] + [parts[: -k or None] for k in (1, 2)] + [parts[k:] for k in (1, 2)]
        cuts += [(family, n, k, " ".join(p)) for k, p in enumerate(some) if len(p) >= max(3, 0.6 * len(parts))]
    table = spark.createDataFrame(cuts, "family string, n int, part int, line string")
    split = table.select("family", "n", "part", F.explode(F.array(words(F.col("line")))).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    gram_sets = split.select("family", "n", "part", F.array_distinct(F.concat("w", pairs)).alias("grams")).collect()  # the notices
    grams_of = {(r["family"], r["n"]): r["grams"] for r in gram_sets if r["part"] == 0}
    every = sorted({g for grams in grams_of.values() for g in grams})
    spaced = spark.createDataFrame([(g,) for g in every], "gram string")
    word, next_word = F.split("gram", " ")[0], F.get(F.split("gram", " "), F.lit(1))
    known = written(spaced.select(F.xxhash64(word, next_word).alias("hash"), "gram"), "notice-grams")
    name = {r["hash"]: r["gram"] for r in known.collect()}  # the notices' grams

    paragraphs = _paragraphs(docs, doc_id, text).filter(F.col("p").rlike(r"[^\s]")).select(F.xxhash64("p").alias("h"), "p")
    sets = written(_window_sets(paragraphs, sorted(name)).distinct(), "licence-windows")
    half = F.greatest(F.ceil(F.col("n") / (WINDOW // 2)) - 1, F.lit(1))
    n_windows = sets.agg(F.coalesce(F.sum(half), F.lit(0))).head()[0]
    windows = sets.select("h", F.posexplode("sets").alias("window", "hashes")).filter(F.size("hashes") > 0)
    often = windows.select(F.explode("hashes").alias("hash")).groupBy("hash").count()
    common = {name[r["hash"]] for r in often.filter(F.col("count") > COMMON * max(n_windows, 1)).collect()}  # of the notices' grams
    notices = _telling_notices(common, grams_of)

    features = [g for g in every if g not in common]
    telling = F.array_except("hashes", F.array(*[F.lit(h) for h, g in name.items() if g in common]).cast("array<long>"))
    fitted_half = F.pmod(F.xxhash64("h", "window"), F.lit(2)) == 0
    kinds = windows.select(F.sort_array(telling).alias("hashes"), fitted_half.alias("fitted")).groupBy("hashes", "fitted").agg(F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[F.lit(x) for pair in name.items() for x in pair])
    kinds = kinds.select(F.transform("hashes", lambda h: names[h]).alias("grams"), "fitted", "n")
    whole = F.greatest(F.lit(0.0), *[F.size(F.array_intersect("grams", F.array(*map(F.lit, n.grams)))) / len(n.grams) for n in notices])
    ordinary = written(kinds.filter(whole < OVERLAP), "ordinary-windows")
    positive = spark.createDataFrame(
        [(float(families.index(r["family"])), [g for g in r["grams"] if g not in common], NOTICE_WEIGHT) for r in gram_sets],
        "label double, grams array<string>, weight double",
    )
    n_ordinary = ordinary.filter("fitted").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    each = min(1.0, ORDINARY_WEIGHT * NOTICE_WEIGHT * len(gram_sets) / max(n_ordinary, 1))
    # Windows that met no gram at all are alike: one row of them stands for all in the fit.
    negative = ordinary.filter("fitted").select("grams", (F.col("n") * each).alias("weight")).unionAll(
        spark.createDataFrame([([], 1.0)], "grams array<string>, weight double")
    )
    train = written(positive.unionAll(negative.select(F.lit(0.0).alias("label"), "grams", "weight")), "licence-training")
    vector = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=max(len(features), 1), binary=True).fit(train)
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=1.0, maxIter=60, weightCol="weight").fit(vector.transform(train))
    matrix = model.coefficientMatrix.toArray()
    weight = {g: matrix[:, i].tolist() for i, g in enumerate(vector.vocabulary)}
    zero = [0.0] * len(families)
    held = spark.createDataFrame([(g, weight.get(g, zero)) for g in features], "gram string, weights array<double>")
    weights = written(held.join(known, "gram").select("hash", "gram", "weights"), "licence-weights")
    intercepts = dict(zip(families, model.interceptVector.toArray().tolist(), strict=True))
    fitted = Fitted(weights, intercepts, LEAST, notices)
    rest = ordinary.filter("not fitted").select("grams", "n", F.explode("grams").alias("gram"))
    again = rest.join(F.broadcast(weights), "gram").groupBy("grams", "n").agg(F.collect_set(F.struct("gram", "weights")).alias("met"))
    reached = written(_likely(again, ["grams", "n"], fitted).groupBy("grams", "n").agg(F.max("likely").alias("likely")), "licence-likely")
    threshold = max(LEAST, _nth_largest(reached, "likely", int(FALSE_SHARE * n_windows / 2) + 1) or LEAST)
    return fitted._replace(threshold=threshold)


def _likely(met: DataFrame, keys: list[str], fitted: Fitted) -> DataFrame:
    """A row for each family that is at least as likely as none: ``family``, ``likely`` (of the two) and ``found``, the grams."""
    score = lambda i, b: F.aggregate("met", F.lit(float(b)), lambda z, x: z + x["weights"][i])
    scores = F.array(*[score(i, b) for i, b in enumerate(fitted.intercepts.values())])
    scored = met.select(*keys, F.col("met.gram").alias("found"), F.explode(F.array(scores)).alias("z"))
    named = [F.struct(F.lit(f).alias("family"), (F.lit(1.0) / (1 + F.exp(F.col("z")[0] - F.col("z")[i]))).alias("likely")) for i, f in enumerate(fitted.intercepts) if i]
    each = scored.select(*keys, "found", F.explode(F.array(*named)).alias("one"))
    return each.select(*keys, "found", "one.family", "one.likely").filter(F.col("likely") >= LEAST)


def _confirmation(fitted: Fitted) -> Column:
    """The greatest overlap with a notice of the family whose difference from similar notices is there too; 0 if there is none."""
    out = F.lit(0.0)
    share = lambda grams: F.size(F.array_intersect("found", F.array(*map(F.lit, grams)))) / len(grams)
    for family in sorted({n.family for n in fitted.notices}):
        overlaps = [F.lit(0.0)]
        for notice in fitted.notices:
            if notice.family == family:
                overlap = share(notice.grams)
                for only in notice.rivals:
                    overlap = F.when(share(only) >= OVERLAP, overlap).otherwise(0.0)
                overlaps.append(overlap)
        out = F.when(F.col("family") == family, F.greatest(*overlaps)).otherwise(out)
    return out


def licence_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: Fitted | None = None) -> DataFrame:
    """Families in windows: ``id``, ``text_hash``, ``paragraph``, ``window``, ``family``, ``likely``, ``overlap``, ``confirmed``.

    Every window of every paragraph of every whole text is scored. A window may have several families. Null and empty texts have
    none; repeated rows count as one.
    """
    fitted = fitted or fit_licences(docs, doc_id, text)
    met = _met(_grams(_paragraphs(docs, doc_id, text), *KEY), list(KEY), fitted.weights)
    found = _likely(met, [*KEY, "window"], fitted).withColumn("overlap", _confirmation(fitted))
    sure = (F.col("likely") >= fitted.threshold) & (F.col("overlap") >= OVERLAP)
    return found.select(*KEY, "window", "family", "likely", "overlap", sure.alias("confirmed"))


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: Fitted | None = None) -> DataFrame:
    """Per row of ``docs``: ``id``, ``families`` (sorted, confirmed), ``n_paragraphs`` with one of them, ``n_unknown`` paragraphs that are
    likelier a notice than not but in which no family is confirmed.

    Null ids and repeated rows are rows like others, an empty table gives none, other columns are not read.
    """
    windows = licence_windows(docs, doc_id, text, fitted)
    paragraphs = windows.groupBy(*KEY).agg(F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("f"))
    per = paragraphs.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("f")))).alias("families"),
        F.count_if(F.size("f") > 0).alias("n_paragraphs"),
        F.count_if(F.size("f") == 0).alias("n_unknown"),
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    zero = F.lit(0).cast("long")
    return rows.join(per, same, "left").select(
        "id",
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_paragraphs", zero).alias("n_paragraphs"),
        F.coalesce("n_unknown", zero).alias("n_unknown"),
    )

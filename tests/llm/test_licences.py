"""Licence scans: wrapped, unseen and neighbouring notices, a plain loop over the same weights, and time per word."""

import math
import re
import time

import pytest
from pyspark.sql import functions as F

from steploom.llm import licences as lic

SF = "/root/testdata/sf0.001"
GPL_3 = (
    "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
    "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
)
CASES = [
    ("int x;\n\n" + GPL_3, ["gpl-3.0"]),
    (GPL_3.replace("version 3", "version 2"), ["gpl-2.0"]),
    (GPL_3.replace("GNU General", "GNU Lesser General"), ["lgpl-3.0"]),
    (GPL_3.replace("GNU General", "GNU Affero General"), ["agpl-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0"]),
    ("This work is licensed under the GNU General Public License.", []),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met.", ["bsd"]),
    ("Licensed under CC BY-SA 4.0.", ["cc-by-sa"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided\n */", ["isc"]),
    ("Released under the MIT License.\nALL RIGHTS RESERVED.", ["mit", "proprietary"]),
    ("filler word " * 700 + "Released under the MIT License. " + "other filler " * 700, ["mit"]),
    ("Licensed under the terms that we like, version 7.", []),
    ("The license of the public park is under general terms of the city, version 3.", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def fitted(corpus):
    return lic.fit_licences(corpus)


def test_notices_fit_into_half_a_window():
    assert all(len(n.split()) <= lic.WINDOW // 2 for notices in lic.NOTICES.values() for n in notices)


def test_wrapped_unseen_and_neighbouring_notices(spark, fitted):
    rows = [(i, text, "x") for i, (text, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string").withColumns({"at": F.lit(1), "hash": F.lit(2)})
    got = {r["id"]: r for r in lic.licences(docs, fitted=fitted).collect()}
    assert {i: list(got[i]["families"]) for i in got} == {i: want for i, (_, want) in enumerate(CASES)}
    assert all(got[i]["n_paragraphs"] == bool(want) for i, (_, want) in enumerate(CASES))
    assert got[6]["n_unknown"] == 1


def plain_windows(text, fitted):
    """Families with their likelihoods and confirmation, by loops."""
    weights = {r["gram"]: r["weights"] for r in fitted.weights.collect()}
    biases = list(fitted.intercepts.items())
    found = set()
    for paragraph, part in enumerate(re.split(r"\n[ \t\r]*\n\s*", re.sub(lic.COMMENT, "", text or ""))):
        words = [w for w in re.split(lic.BETWEEN, "".join(c.lower() if c.isascii() else c for c in part)) if w]
        for window in range(max(1, math.ceil(len(words) / (lic.WINDOW // 2)))):
            first = window * (lic.WINDOW // 2)
            places = range(first, min(first + lic.WINDOW, len(words)))
            grams = {words[i] for i in places} | {f"{words[i]} {words[i + 1]}" for i in places if i + 1 < len(words)}
            met = grams & set(weights)
            if not met:
                continue
            z = [b + sum(weights[g][k] for g in met) for k, (_, b) in enumerate(biases)]
            for k, (family, _) in enumerate(biases):
                likely = 1 / (1 + math.exp(z[0] - z[k]))
                if k and likely >= lic.LEAST:
                    share = lambda only: len(met & set(only)) / len(only)  # noqa: E731, B023
                    ok = [n for n in fitted.notices if n.family == family and share(n.grams) >= lic.OVERLAP and all(share(r) >= lic.OVERLAP for r in n.rivals)]
                    found.add((paragraph, window, family, round(likely, 9), bool(ok) and likely >= fitted.threshold))
    return found


def test_windows_equal_plain_loop(spark, corpus, fitted):
    texts = [t for t, _ in CASES] + [r["text"] for r in corpus.orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in lic.licence_windows(docs, fitted=fitted).collect():
        got.setdefault(r["id"], set()).add((r["paragraph"], r["window"], r["family"], round(r["likely"], 9), r["confirmed"]))
    for i, text in enumerate(texts):
        assert got.get(i, set()) == plain_windows(text, fitted), i


def test_planted_lines_of_the_corpus_and_no_others(corpus, fitted):
    planted = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
    }
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    for r in lic.licences(corpus, fitted=fitted).collect():
        assert list(r["families"]) == sorted({f for line, f in planted.items() if line in texts[r["id"]]})


def test_awkward_tables(spark, fitted):
    rows = [(None, "All rights reserved."), (1, None), (1, "All rights reserved."), (1, "All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["id"]), list(r["families"]), r["n_paragraphs"]) for r in lic.licences(docs, fitted=fitted).collect())
    assert got == [("1", [], 0), ("1", ["proprietary"], 1), ("1", ["proprietary"], 1), ("None", ["proprietary"], 1)]
    empty = docs.filter("false")
    assert lic.licences(empty, fitted=fitted).collect() == []
    assert lic.licences(empty).collect() == []  # nothing to learn ordinary text from


def test_time_is_linear_in_the_words_of_a_paragraph(spark, fitted):
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 997} the license" for i in range(n // 3)))], "doc_id long, text string")
        start = time.perf_counter()
        lic.licences(docs, fitted=fitted).collect()
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(20_000) < 3 * seconds(2_000) + 2


def test_window_sets_equal_the_windows_that_are_scored(spark, corpus):
    texts = [t for t, _ in CASES if t] + [r["text"] for r in corpus.orderBy("doc_id").limit(40).collect() if r["text"]] + ["--- ...", "the " * 81]
    paragraphs = spark.createDataFrame(list(enumerate(texts)), "h long, p string")
    grams = sorted({g for notices in lic.NOTICES.values() for n in notices for g in n.lower().replace(".", "").split()} | {"general public", "the the"})
    first, second = F.split("gram", " ")[0], F.get(F.split("gram", " "), F.lit(1))
    known = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.xxhash64(first, second).alias("hash"), "gram").localCheckpoint()
    name = {r["hash"]: r["gram"] for r in known.collect()}
    sets = lic._window_sets(paragraphs, sorted(name)).collect()
    got = {(r["h"], k): {name[x] for x in found} for r in sets for k, found in enumerate(r["sets"]) if found}
    assert got == {(r["h"], r["window"]): {x["gram"] for x in r["met"]} for r in lic._met(lic._grams(paragraphs, "h"), ["h"], known).collect()}
    counts = dict(paragraphs.select("h", F.size(lic.words(F.col("p")))).collect())
    assert {r["h"]: r["n"] for r in sets} == counts


def test_every_paragraph_counts_in_the_fit(spark):
    """Those that a sample by the smallest hashes would leave out too."""
    made = spark.range(4_000).select(F.concat(F.lit("plain words of the day "), "id").alias("text"), F.lit(0).alias("kind"))
    last = made.select(F.xxhash64("text").alias("h")).orderBy("h").offset(1_600).first()["h"]
    made = made.unionAll(spark.range(4_000).select(F.concat(F.lit("the redistribution of bread number "), "id"), F.lit(1)))
    docs = made.filter((F.col("kind") == 0) | (F.xxhash64("text") > last)).withColumn("doc_id", F.monotonically_increasing_id())
    words = lambda fitted: {r["gram"] for r in fitted.weights.collect()}
    assert "redistribution" in words(lic.fit_licences(docs.filter("kind = 0")))
    assert "redistribution" not in words(lic.fit_licences(docs))


@pytest.mark.parametrize("values", [[0.5, 0.7, 0.7, 0.9, 0.7 + 1e-16, 0.9 - 1e-13], [0.8] * 5, [0.5 + i / 4_321 for i in range(2_000)], []])
def test_nth_largest_is_exact(spark, values):
    rows = [(v, 1 + i % 3) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "likely double, n long")
    ordered = sorted((v for v, n in rows for _ in range(n)), reverse=True)
    for n in (1, 2, 3, 5, 8, len(ordered), len(ordered) + 1):
        if n:
            assert lic._nth_largest(table, "likely", n) == (ordered[n - 1] if n <= len(ordered) else None)

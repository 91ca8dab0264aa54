"""License scans: MinHash bands over overlapping windows of words retrieve templates, shingle containment verifies them.

Words are runs of a-z and 0-9 of the lower-cased text.  Templates fall into size classes; a class whose templates have at
most M words cuts texts into windows of 2 M words, one every M words, so each stretch of M words lies whole in some window.  A
window and a template meet if one of the class's bands agrees (a band is one MinHash of five-word shingles).  A template
contained to ``least`` has at least Jaccard J with its window, where J follows from the sizes alone; the number of bands is
the smallest for which a hit is missed with a probability of at most ``miss``.  Then the exact share of the
template's shingles that the window holds decides.  A template of fewer than five words has its whole word sequence as its
one shingle; it has classes of its own and is met by that shingle itself, so none is missed.

Texts that hold no word of a hitting set of all templates' shingles hold no shingle either; they are left out first, and so
are windows.  DataFrame functions only; the templates are a parameter of fixed size and the only thing that is broadcast.

Null and empty texts match nothing, and texts of fewer than five words only templates as short; rows that share a doc_id are one document; null doc_ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WORDS = 5
#: Sentences by which common licenses are declared.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
}
#: Notices of fewer than five words.
SHORT_TEMPLATES = {"All-rights-reserved-line": "All rights reserved."}


def _split(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    n = min(WORDS, len(words))
    return sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


def hitting_words(templates: dict[str, str]) -> list[str]:
    """The longest word of each shingle: a text without any of them holds no shingle of a template."""
    return sorted({max(s.split(), key=lambda w: (len(w), w)) for t in templates.values() for s in _shingles(_split(t))})


def bands_for(shortest: int, most: int, least: float, miss: float) -> int:
    """Bands for a class of templates of ``shortest`` to ``most`` words."""
    s = shortest - WORDS + 1
    window = 2 * most - WORDS + 1
    need = math.ceil(least * s)
    jaccard = need / (window + s - need)
    return max(1, math.ceil(math.log(miss) / math.log(1 - jaccard))) if jaccard < 1 else 1


def size_classes(templates: dict[str, str], least: float, miss: float) -> list[tuple[int, int, list[tuple[str, list[str]]]]]:
    """(M, bands, templates) of each class; M doubles from class to class, and each length under WORDS is a class of its own, without bands."""
    classes: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for name, text in sorted(templates.items()):
        words = _split(text)
        if not words:
            raise ValueError(f"template {name} has no words")
        classes.setdefault((max(8, 1 << (len(words) - 1).bit_length()), min(WORDS, len(words))), []).append((name, words))
    return [(m, bands_for(min(len(w) for _, w in own), m, least, miss) if n == WORDS else 0, own) for (m, n), own in sorted(classes.items())]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _window_shingles(words: Column, n: int = WORDS) -> Column:
    last = F.size(words) - n
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, n))))
    return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def _minhash(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, miss: float = 1e-4) -> DataFrame:
    """doc_id, license, containment (the best of the document's windows), n_windows (that hold it), first_word (start of the first such window)."""
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    if not templates:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word long")
    anchors = hitting_words(templates)
    has_anchor = lambda words: F.exists(words, lambda w: w.isin(anchors))
    rows = shared.texts(docs).select("doc_id", _words(F.col("text")).alias("words")).where(has_anchor("words"))
    held = shared.table(rows, "license-texts")
    hits = None
    for m, bands, own in size_classes(templates, least, miss):
        n = min(WORDS, len(own[0][1]))
        keys = lambda shingles: _minhash(F.col(shingles), bands) if bands else F.col(shingles)  # noqa: B023, E731
        known = spark.createDataFrame([(n, w) for n, w in own], "license string, words array<string>").select("license", _window_shingles(F.col("words"), n).alias("template"))
        known = F.broadcast(known.select("license", "template", F.posexplode(keys("template")).alias("band", "value")))
        starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(m))
        windows = held.select("doc_id", "words", F.explode(starts).alias("start")).select("doc_id", "start", F.slice("words", F.col("start") + 1, 2 * m).alias("words"))
        windows = windows.where(has_anchor("words") & (F.size("words") >= n)).select("doc_id", "start", _window_shingles(F.col("words"), n).alias("shingles"))
        keyed = windows.select("doc_id", "start", "shingles", F.posexplode(keys("shingles")).alias("band", "value"))
        share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
        met = keyed.join(known, ["band", "value"] if bands else "value").select("doc_id", "start", "license", share.alias("share")).where(F.col("share") >= least)
        hits = met if hits is None else hits.unionByName(met)
    once = hits.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))  # several bands may agree
    return once.groupBy("doc_id", "license").agg(F.round(F.max("share"), 6).alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("start").cast("long").alias("first_word"))

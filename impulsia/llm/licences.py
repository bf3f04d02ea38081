"""Licence scans by a trained paragraph classifier, in DataFrame functions.

Features of a paragraph (a line) are the distinct words and word pairs that occur in licence notices. A multinomial
logistic regression over these sparse indicators, trained on the driver from notices (whole, cut, and set into
ordinary words) and a bounded sample of the corpus, gives each paragraph a probability for every family, for a notice
of no known family ("unknown") and for ordinary text. A temperature calibrates them: it is fitted on other wordings of
the notices (HELD) and other documents' paragraphs than training reads. A paragraph is a notice if ordinary text is the less likely half; its family stands if its probability is at
least SURE and the comparison with the family's notices confirms it (it has the share CONFIRM of one notice's word
pairs), else the notice is unknown.

Notices are wrapped: from each line that is not confirmed alone, the lines after it, up to a blank one, one confirmed
alone or as many words as the longest notice has, are joined (with the word pairs across line ends; comment marks are
no words), classified and confirmed as one paragraph. A confirmed one stands for its lines, at its first.

A paragraph without any feature is ordinary text. Training skips null ids and texts. A null or empty text has no paragraphs. Texts are read whole, each
row by itself: no shuffle, so copies and hot sources cost what they weigh; repeated rows are scanned each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Families and their usual notices.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "This project is released under the Apache 2.0 license",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This software is licensed under the MIT License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Copyright holder, all rights reserved. Unauthorized copying of this file is strictly prohibited"],
}
#: Notices of other licences, which stand for the unknown.
OTHERS = [
    "Distributed under the Boost Software License, Version 1.0",
    "Licensed under the Eclipse Public License 2.0",
    "Released under the zlib License",
    "Licensed under the Artistic License 2.0",
    "This file is licensed under the Example Community License",
    "Licensed under the European Union Public Licence",
    "Use of this source code is governed by a license that can be found in the accompanying file",
]
#: Other wordings, which neither training nor the comparison reads: they calibrate.
HELD = {
    "apache-2.0": ["This library is distributed under the terms of the Apache License, Version 2.0", "Unless required by applicable law, software distributed under the Apache License 2.0 comes without warranties"],
    "mit": ["This code is available under the MIT license", "Permission is granted, free of charge, to any person obtaining a copy of this program under the MIT License"],
    "gpl": ["You may redistribute this program under the terms of the GNU General Public License as published by the Free Software Foundation", "This file is part of a program licensed under the GNU GPL version 3"],
    "bsd": ["This software is distributed under the BSD 3-Clause License", "Redistribution and use in source and binary forms are permitted provided that the conditions of the BSD license are met"],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0", "Distributed under the Mozilla Public License 2.0"],
    "cc-by-nc": ["This text is available under CC BY-NC 4.0", "Made available under a Creative Commons Attribution-NonCommercial licence"],
    "cc-by-sa": ["This article is available under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by": ["This article is distributed under CC BY 4.0", "This is an open access article under the terms of the Creative Commons Attribution License"],
    "public-domain": ["This work is in the public domain under CC0 1.0", "The author has dedicated this work to the public domain"],
    "proprietary": ["All rights reserved by the copyright holder", "Unauthorized copying of this document is strictly prohibited. All rights reserved"],
}
HELD_OTHERS = ["Distributed under the Eclipse Public License", "This program is licensed under the Open Software License 3.0", "Released under the ISC License", "Licensed under the Academic Free License version 3.0"]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [*NOTICES, UNKNOWN, NONE]
SURE, CONFIRM = 0.5, 0.6
#: Documents of the corpus, paragraphs of each and characters of these that training reads as examples of ordinary text
#: at most, from anywhere in a text and in a paragraph, as hashes fall.
SAMPLE, EACH, CHARS = 400, 4, 600
COPIES, STEPS, DECAY = 30, 300, 1e-4
#: Words of the longest notice.
LONGEST = max(len(re.findall(r"[^\W_]+", n)) for ns in NOTICES.values() for n in ns)
#: Words of notices that ordinary text has as often are no features by themselves.
CUT = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams(ws: list[str]) -> set[tuple[str, ...]]:
    return {*((w,) for w in ws), *zip(ws, ws[1:])}


def examples(notices: dict[str, list[str]], others: list[str], background: list[list[str]], seed: int) -> list[tuple[set, int]]:
    """Notices with words dropped or cut off and set into ordinary words, scraps of notices, and ordinary paragraphs."""
    rng, out = random.Random(seed), []
    plain = [w for ws in background for w in ws] or ["word"]
    sources = [(CLASSES.index(f), words(n)) for f, ns in notices.items() for n in ns] + [(CLASSES.index(UNKNOWN), words(n)) for n in others]
    none = CLASSES.index(NONE)
    for label, ws in sources:
        for k in range(COPIES):
            own = [w for w in ws if rng.random() > 0.05 * (k % 3)] or ws
            own = own[: max(3, round(len(own) * rng.uniform(0.7, 1)))] if k % 4 == 3 else own
            around = [rng.choice(plain) for _ in range(rng.choice([0, 0, 4, 30]))]
            cut = rng.randrange(len(around) + 1)
            out.append((grams(around[:cut] + own + around[cut:]), label))
        for _ in range(COPIES // 2):  # single words of notices in ordinary text
            scraps = [rng.choice(ws) if rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randrange(2, 30))]
            out.append((grams(scraps), none))
    return out + [(grams(ws), none) for ws in background]


class Sparse:
    """Indicator rows: the features of each, and the rows of each feature."""

    def __init__(self, rows: list[tuple[set, int]], features: dict):
        own = [sorted(features[g] for g in gs if g in features) for gs, _ in rows]
        counts = np.array([len(x) for x in own], np.int64)
        self.feature = np.array([i for x in own for i in x], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(self.feature, kind="stable")
        self.row = np.repeat(np.arange(len(rows)), counts)[order]
        self.begin = np.searchsorted(self.feature[order], np.arange(len(features) + 1))
        self.labels = np.array([label for _, label in rows], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of the weights of each row's features."""
        return _sums(w[self.feature], self.bounds)

    def back(self, g: np.ndarray) -> np.ndarray:
        """The sum over each feature's rows."""
        return _sums(g[self.row], self.begin)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return run[bounds[1:]] - run[bounds[:-1]]


def fit(x: Sparse, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature and class, and biases, by gradient steps with momentum over all rows, every class weighing the same."""
    y = np.eye(len(CLASSES))[x.labels]
    per_row = (y / np.maximum(y.sum(0), 1)).sum(1)
    per_row /= per_row.sum()
    w, b = np.zeros((n_features, len(CLASSES))), np.zeros(len(CLASSES))
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        z = x.times(w) + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - y) * per_row[:, None]
        vw, vb = 0.9 * vw - 2 * (x.back(g) + DECAY * w), 0.9 * vb - 2 * g.sum(0)
        w, b = w + vw, b + vb
    return w, b


def temperature(x: Sparse, w: np.ndarray, b: np.ndarray) -> float:
    """The divisor of scores under which the left-out rows are likeliest, every class weighing the same."""
    z = x.times(w) + b
    share = 1 / np.maximum(np.bincount(x.labels, minlength=len(CLASSES)), 1)[x.labels]

    def loss(t: float) -> float:
        s = z / t
        top = s.max(1)
        return float((share * (np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), x.labels])).sum())

    return min((0.25 * 1.15**k for k in range(30)), key=loss)


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> dict:
    """The model. docs: doc_id, text; of which a bounded sample, the smallest hashed ids, gives ordinary paragraphs: every third document's to calibration, the others' to training."""
    rank = F.xxhash64("doc_id")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    ids = known.select("doc_id").orderBy(rank, "doc_id").limit(sample).distinct()
    # Rows of one id, however many, give sample rows at most.
    some = known.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(rank, F.xxhash64("text")).limit(sample)
    dealt = F.sort_array(F.transform(F.filter(F.split("text", r"\n+"), lambda p: p != ""), lambda p: F.struct(F.xxhash64(p, F.col("doc_id")).alias("h"), p.alias("p"))))
    start = F.pmod("h", F.greatest(F.length("p") - CHARS, F.lit(0)) + 1).cast("int") + 1
    paragraphs = some.select("doc_id", F.explode(F.slice(dealt, 1, EACH)).alias("x")).select("doc_id", "x.*").select("doc_id", F.col("p").substr(start, F.lit(CHARS)).alias("p")).collect()
    fronts = [set(zip(ws, ws[1:])) for ns in (*NOTICES.values(), *HELD.values()) for ws in map(words, ns)]
    background: tuple[list, list] = ([], [])
    turn = {d: k for k, d in enumerate(sorted({r["doc_id"] for r in paragraphs}))}
    for r in sorted(paragraphs, key=lambda r: (turn[r["doc_id"]], r["p"])):
        ws = words(r["p"])
        pairs = set(zip(ws, ws[1:]))
        if ws and all(len(pairs & f) < 0.3 * len(f) for f in fronts):  # a notice is no ordinary text
            background[turn[r["doc_id"]] % 3 == 2].append(ws)
    common = {w for ws in background[0] for w in ws}
    features: dict[tuple[str, ...], int] = {}
    for n in [n for ns in NOTICES.values() for n in ns] + OTHERS:
        for g in sorted(grams(words(n))):
            if len(g) == 2 or g[0] not in common:
                features.setdefault(g, len(features))
    w, b = fit(Sparse(examples(NOTICES, OTHERS, background[0], seed), features), len(features))
    held = Sparse(examples(HELD, HELD_OTHERS, background[1], seed + 1), features)
    return {"features": list(features), "weights": w, "bias": b, "temperature": temperature(held, w, b)}


def _hash_of(a: Column, b: Column | None = None) -> Column:
    return F.xxhash64(a) if b is None else F.xxhash64(a, b)


def _longs(values) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _hashes(spark: SparkSession, features: list[tuple[str, ...]]) -> list[int]:
    """What the scan's hash gives for each feature."""
    both = F.split(F.col("g"), " ")
    rows = spark.range(1).select(F.explode(F.split(F.lit("\n".join(" ".join(g) for g in features)), "\n")).alias("g"))
    rows = rows.select("g", F.when(F.size(both) == 2, _hash_of(F.element_at(both, 1), F.try_element_at(both, F.lit(2)))).otherwise(_hash_of(F.element_at(both, 1))).alias("h"))
    found = {r["g"]: r["h"] for r in rows.collect()}
    return [found[" ".join(g)] for g in features]


def _slots(hashes: list[int]) -> tuple[int, int]:
    """A shift and a number of bits by which the hashes fall into different slots."""
    bits = 13
    while True:
        mask = (1 << bits) - 1
        for shift in range(64 - bits):
            if len({(h >> shift) & mask for h in hashes}) == len(hashes):
                return shift, bits
        bits += 1


def scan(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with an array of the notices found: paragraph (from 0), family, probability and whether the comparison confirmed it. Columns of the names used are replaced."""
    docs = docs.drop("notices", "_words", "_all", "_lines", "_scored", "_odds", "_judged", "_alone", "_joined")
    hashes = _hashes(docs.sparkSession, model["features"])
    shift, bits = _slots(hashes)
    mask = (1 << bits) - 1
    table, number = [0] * (mask + 1), [0] * (mask + 1)
    for i, h in enumerate(hashes):
        table[(h >> shift) & mask], number[(h >> shift) & mask] = h, i
    by = dict(zip(model["features"], hashes, strict=True))
    keys, index = _longs(table), _longs(number).cast("array<int>")
    weights = [_doubles(row / model["temperature"]) for row in model["weights"].T]
    bias = [float(v) / model["temperature"] for v in model["bias"]]
    none = len(CLASSES) - 1

    def slot(g: Column) -> Column:
        return F.shiftright(g, shift).bitwiseAND(F.lit(mask)).cast("int") + 1

    def known(gs: Column) -> Column:
        return F.filter(gs, lambda g: F.element_at(keys, slot(g)) == g)

    def hits(ws: Column) -> Column:
        pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), _hash_of)
        return known(F.concat(F.transform(ws, lambda w: _hash_of(w)), pairs))

    def link(ws: Column, after: Column) -> Column:
        """The word pair across the line end, if known."""
        pair = F.array(_hash_of(F.try_element_at(ws, F.lit(-1)), F.try_element_at(after, F.lit(1))))
        return F.when((F.size(ws) > 0) & (F.size(after) > 0), known(pair)).otherwise(F.lit([]).cast("array<bigint>"))

    split = F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda line: F.filter(F.split(line, CUT), lambda w: w != ""))
    rows = docs.select("*", split.alias("_words"))
    lines = F.transform("_words", lambda ws, i: F.struct(i.alias("paragraph"), i.alias("end"), F.array_distinct(hits(ws)).alias("hits"), F.size(ws).alias("n"), link(ws, F.get("_words", i + 1)).alias("link")))
    rows = rows.select("*", lines.alias("_all")).drop("_words")

    def logits(x: Column) -> Column:
        at = F.transform(x["hits"], lambda g: F.element_at(index, slot(g)) + 1)

        def total(w: Column, b: float) -> Column:
            return F.aggregate(at, F.lit(b), lambda s, i: s + F.element_at(w, i))

        return F.array(*map(total, weights, bias))

    def share(hit: Column, family: str) -> Column:
        """The largest share of a notice's word pairs among the hits."""
        sets = [[by[p] for p in set(zip(ws, ws[1:]))] for ws in map(words, NOTICES[family])]
        return F.greatest(*[F.size(F.array_intersect(hit, _longs(s))) / F.lit(float(len(s))) for s in sets], F.lit(0.0))

    def judge(x: Column) -> Column:
        total = F.aggregate(x["e"], F.lit(0.0), lambda s, e: s + e)
        licence = F.slice(x["e"], 1, none)
        best = F.array_position(licence, F.array_max(licence)).cast("int")
        return F.struct(
            x["paragraph"].alias("paragraph"), x["end"].alias("end"), x["hits"].alias("hits"), F.element_at(F.array(*map(F.lit, CLASSES)), best).alias("family"),
            (F.array_max(licence) / total).alias("probability"), (F.element_at(x["e"], none + 1) / total).alias("ordinary"),
        )

    def confirm(x: Column) -> Column:
        alike = F.coalesce(*(F.when(x["family"] == f, share(x["hits"], f)) for f in NOTICES), F.lit(0.0))
        sure = (x["probability"] >= SURE) & (alike >= CONFIRM)
        return F.struct(x["paragraph"].alias("paragraph"), F.when(sure, x["family"]).otherwise(F.lit(UNKNOWN)).alias("family"), x["probability"].alias("probability"), sure.alias("confirmed"), x["end"].alias("end"), alike.alias("alike"))

    def judged(rows: DataFrame, name: str) -> DataFrame:
        """rows with the notices among the paragraphs of _lines, which goes."""
        step = F.transform("_lines", lambda x: F.struct(x["paragraph"].alias("paragraph"), x["end"].alias("end"), x["hits"].alias("hits"), logits(x).alias("z")))
        rows = rows.select("*", step.alias("_scored")).drop("_lines")
        step = F.transform("_scored", lambda x: F.struct(x["paragraph"].alias("paragraph"), x["end"].alias("end"), x["hits"].alias("hits"), F.transform(x["z"], lambda z: F.exp(z - F.array_max(x["z"]))).alias("e")))
        rows = rows.select("*", step.alias("_odds")).drop("_scored")
        rows = rows.select("*", F.filter(F.transform("_odds", judge), lambda x: x["ordinary"] < 0.5).alias("_judged")).drop("_odds")
        return rows.select("*", F.transform("_judged", confirm).alias(name)).drop("_judged")

    rows = judged(rows.select("*", F.filter("_all", lambda x: F.size(x["hits"]) > 0).alias("_lines")), "_alone")

    def own(x: Column) -> Column:
        return F.exists("_alone", lambda a: a["confirmed"] & (a["paragraph"] == x["paragraph"]))

    def add(a: Column, x: Column) -> Column:
        more = a["open"] & (a["n"] < LONGEST) & (x["n"] > 0) & ~own(x)
        gained = F.struct(F.array_union(a["hits"], F.concat(a["link"], x["hits"])).alias("hits"), x["link"].alias("link"), (a["n"] + x["n"]).alias("n"), F.lit(True).alias("open"), x["paragraph"].alias("end"))
        return F.when(more, gained).otherwise(F.struct(a["hits"].alias("hits"), a["link"].alias("link"), a["n"].alias("n"), F.lit(False).alias("open"), a["end"].alias("end")))

    def join(x: Column) -> Column:
        start = F.struct(x["hits"].alias("hits"), x["link"].alias("link"), F.lit(0).alias("n"), F.lit(True).alias("open"), x["end"].alias("end"))
        # Lines with words have one each at least: no more than LONGEST can be joined.
        return F.aggregate(F.slice("_all", x["paragraph"] + 2, LONGEST), start, add, lambda a: F.struct(x["paragraph"].alias("paragraph"), a["end"].alias("end"), a["hits"].alias("hits")))

    begin = F.filter("_all", lambda x: ((F.size(x["hits"]) > 0) | (F.size(x["link"]) > 0)) & ~own(x))
    rows = rows.select("*", F.transform(begin, join).alias("_lines")).drop("_all")
    rows = rows.withColumn("_lines", F.filter("_lines", lambda x: (x["end"] > x["paragraph"]) & (F.size(x["hits"]) > 1)))
    rows = judged(rows, "_joined")

    def merge(a: Column, x: Column) -> Column:
        """Of overlapping joined paragraphs of a family the likest stands for all."""
        last = F.try_element_at(a, F.lit(-1))
        best = F.when(x["alike"] >= last["alike"], x).otherwise(last)
        both = F.struct(*(best[c].alias(c) for c in ("paragraph", "family", "probability", "confirmed")), F.greatest(last["end"], x["end"]).alias("end"), best["alike"].alias("alike"))
        over = (F.size(a) > 0) & (last["family"] == x["family"]) & (last["end"] >= x["paragraph"])
        return F.when(over, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(a, F.array(x)))

    sure = F.filter("_joined", lambda x: x["confirmed"])
    rows = rows.withColumn("_joined", F.aggregate(sure, F.filter("_joined", lambda x: F.lit(False)), merge))
    rest = F.filter("_alone", lambda s: s["confirmed"] | ~F.exists("_joined", lambda m: (m["paragraph"] <= s["paragraph"]) & (s["paragraph"] <= m["end"])))
    notices = F.transform(F.array_sort(F.concat(rest, F.col("_joined"))), lambda x: F.struct(*(x[c].alias(c) for c in ("paragraph", "family", "probability", "confirmed"))))
    return rows.select("*", notices.alias("notices")).drop("_alone", "_joined")


def _doubles(values) -> Column:
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def scanned(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, its paragraphs, its notices' families in order of appearance, and the surest notice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(rows, train(rows))
    first = F.try_element_at(F.sort_array(F.transform("notices", lambda x: F.struct(x["confirmed"].alias("confirmed"), x["probability"].alias("probability"), (-x["paragraph"]).alias("back"), x["family"].alias("family"))), asc=False), F.lit(1))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    return found.select("doc_id", F.size(lines).cast("long").alias("n_paragraphs"), F.size("notices").cast("long").alias("n_notices"), F.array_join(F.transform("notices", lambda x: x["family"]), ",").alias("families"), first["family"].alias("licence"), first["probability"].alias("probability"), F.coalesce(first["confirmed"], F.lit(False)).alias("confirmed"))

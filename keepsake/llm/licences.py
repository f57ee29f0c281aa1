"""Licence scans (5), native: which paragraphs state a licence, and of which family?

Each line is judged, and so are paragraphs, which end at blank lines, for notices that run over lines. For
each family a sparse logistic regression over word unigrams and bigrams is trained on the driver: positives
are the family's templates and worn copies of them, negatives the other families, phrases that only sound
like licences, and lines of a bounded sample of documents. The lasso leaves a few n-grams a family. A
paragraph's families are all confirmed ones, else the likeliest, or `unknown` below a threshold. That is calibrated in two folds, on worn copies of every other
template and on every other line, by regressions that saw neither. A prediction is confirmed when the words of
one of the family's templates stand in the paragraph to a sufficient share.

Scoring is column expressions over the lines of a text: no shuffle, no Python. Only lines that hold the
rarest word of at least one n-gram are scored; all others have no feature, so their scores are the
intercepts, which are unknown.

Defined results: a null or empty text has no licence; a text of any length is read wholly; an empty table gives an empty result; repeated rows
and null ids are scanned each; other columns are not read; no documents to sample leave the phrases as
negatives.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import lasso_logistic, sigmoid
from .shared import let, table

# Notices of licence families.
TEMPLATES = {
    "agpl": ("GNU Affero General Public License version 3", "licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "released under the BSD 3-Clause License", "distributed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY-SA 4.0", "This work is licensed under CC BY 4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the GPL version 2"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC License", "SPDX-License-Identifier: ISC"),
    "lgpl": ("GNU Lesser General Public License version 2.1", "licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the MIT license", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
}
# Phrases that sound like licences and state none.
PHRASES = (
    "a driving license is required for this job", "he lost his license in the crash", "the software license fee is due in march", "all rights reserved",
    "terms and conditions apply to this offer", "permission was refused by the school", "released under the bridge at night", "the general public is welcome",
    "a free copy of the book", "licensed to sell wine", "published by the foundation for public health", "version 2.0 of the plan is ready",
    "the apache people of the plains", "students at mit found a way", "this work is under way", "copyright notice and disclaimer of warranty",
)
UNKNOWN = "unknown"
#: Sampled documents, their lines at most, worn copies of a template, penalty, least share of a template's words.
SAMPLE, LINES, COPIES, PENALTY, CONFIRM = 300, 3000, 40, 0.002, 0.6
#: Words of a run that training takes for a line.
RUN = 60
BREAK = "[^a-z0-9.]+"
#: The end of a line before a blank one.
BLANK_LINE = "\n(?=[ \\t\\r]*(?:\n|$))"


def line_words(line: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(BREAK, line.lower())) if w]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class Family:
    name: str
    intercept: float
    weights: tuple[tuple[str, float], ...]
    templates: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Model:
    families: tuple[Family, ...]
    threshold: float
    gates: tuple[str, ...]


def _worn(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """A copy of which words were lost, and which stands among others."""
    kept = [w for w in words if rng.random() > 0.12] or words
    around = [rng.choice(filler) for _ in range(rng.randint(0, 8))]
    at = rng.randint(0, len(around))
    return around[:at] + kept + around[at:]


def train(lines: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 7) -> Model:
    """lines: paragraphs taken for negatives unless they hold a template."""
    rng = random.Random(seed)
    cut = {f: tuple(tuple(line_words(t)) for t in ts) for f, ts in templates.items()}
    own = [set(t) for ts in cut.values() for t in ts]
    plain = [w for w in map(line_words, lines) if not any(len(t & set(w)) >= 0.5 * len(t) for t in own)] + [line_words(p) for p in PHRASES for _ in range(8)]
    filler = sorted({w for ws in plain for w in ws})
    rows = [(None, i % 2, ws) for i, ws in enumerate(plain)]
    rows += [(f, i % 2, _worn(list(t), rng, filler) if k else list(t)) for f, ts in cut.items() for i, t in enumerate(ts) for k in range(COPIES)]
    rng.shuffle(rows)
    found = [(f, fold, grams(ws)) for f, fold, ws in rows]
    best = np.zeros(len(found))
    for k in (0, 1):  # for the threshold alone
        part = _families([(f, gs) for f, fold, gs in found if fold != k], cut)
        best += [max(_chance(gs, f) for f in part) if fold == k else 0.0 for _, fold, gs in found]
    is_plain = np.array([f is None for f, _, _ in found])
    cuts = np.linspace(0.05, 0.95, 91)
    errors = [(best[is_plain] >= c).mean() + (best[~is_plain] < c).mean() for c in cuts]
    good = cuts[np.array(errors) <= min(errors) + 1e-12]
    families = _families([(f, gs) for f, _, gs in found], cut)
    common = Counter(g for f, _, gs in found if f is None for g in gs)
    rarest = {min(g.split(" "), key=lambda w: (common[w], w)) for f in families for g, w in f.weights if w > 0}
    return Model(families, float(max(good.mean(), *(sigmoid(np.array([f.intercept]))[0] + 0.01 for f in families))), tuple(sorted(rarest)))


def _families(found: list[tuple[str | None, set[str]]], cut: dict[str, tuple[tuple[str, ...], ...]]) -> tuple[Family, ...]:
    """A regression for each family against all other rows; rows of no family have None."""
    common = Counter(g for f, gs in found if f is None for g in gs)
    n_plain = sum(f is None for f, _ in found)
    seen = Counter(g for f, gs in found if f is not None for g in gs)
    features = sorted(g for g, c in seen.items() if c >= COPIES // 4 and common[g] <= 0.02 * n_plain)
    at = {g: j for j, g in enumerate(features)}
    x = np.zeros((len(found), len(features)))
    for i, (_, gs) in enumerate(found):
        x[i, [at[g] for g in gs if g in at]] = 1
    out = []
    for name, ts in cut.items():
        w, b = lasso_logistic(x, np.array([f == name for f, _ in found], float), PENALTY, 600)
        out.append(Family(name, b, tuple((g, float(w[j])) for j, g in enumerate(features) if abs(w[j]) > 1e-3), ts))
    return tuple(out)


def _chance(gs: set[str], f: Family) -> float:
    return float(sigmoid(np.array(f.intercept + sum(w for g, w in f.weights if g in gs))))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE, lines: int = LINES) -> Model:
    """Negatives come from the lines of `most` documents, long ones in runs of RUN words, of which at most `lines` are
    taken, both by a hash; everything else is fixed."""
    taken = docs.select(F.col(key).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(key).alias("id"), F.explode(F.split(F.col(text), "\n")).alias("line")).join(F.broadcast(taken), "id").where("line <> ''")
    words = rows.select(F.split("line", "\\s+").alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(RUN))
    runs = words.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(RUN)), " "))).alias("run"))
    return train([r.run for r in runs.orderBy(F.xxhash64("run"), "run").limit(lines).collect()])


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _words(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), BREAK), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _judge(words: Column, model: Model) -> Column:
    """(family, probability, similarity, confirmed) of words: every confirmed family, or else the likeliest one."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    scores = let(F.concat(words, pairs), lambda g: F.array(*[_family(g, f) for f in model.families]))

    def of(b: Column) -> Column:
        held = F.coalesce(*[F.when(b["name"] == f.name, _held(words, f)) for f in model.families])
        return let(held, lambda h: named(b, h["similarity"], h["held"]))

    def named(b: Column, similarity: Column, held: Column) -> Column:
        name = F.when(b["p"] >= model.threshold, b["name"]).otherwise(UNKNOWN)
        return F.struct(name.alias("family"), b["p"].alias("probability"), similarity.alias("similarity"), ((b["p"] >= model.threshold) & (similarity >= CONFIRM)).alias("confirmed"), held.alias("held"))

    def all_of(found: Column) -> Column:
        sure = F.filter(F.transform(F.filter(found, lambda b: b["p"] >= model.threshold), of), lambda j: j["confirmed"])
        return let(let(sure, own), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(of(F.array_max(found)))))

    def own(js: Column) -> Column:
        # a family whose words all belong to a likelier one's template isn't stated by them
        return F.filter(js, lambda j: ~F.exists(js, lambda o: (o["probability"] > j["probability"]) & (F.size(F.array_except(j["held"], o["held"])) == 0)))

    return let(scores, all_of)


def _held(words: Column, f: Family) -> Column:
    """(similarity, held): the template of which the words hold the largest share, and what they hold of it."""

    def of(t: tuple[str, ...]) -> Column:
        return let(F.array_intersect(words, _strings(t)), lambda h: F.struct((F.size(h) / len(set(t))).alias("similarity"), h.alias("held")))

    return F.array_max(F.array(*map(of, f.templates)))


def _family(g: Column, f: Family) -> Column:
    total = F.lit(f.intercept)
    for gram, weight in f.weights:
        total = total + F.when(F.array_contains(g, gram), weight).otherwise(0.0)
    return F.struct((1 / (1 + F.exp(-total))).alias("p"), F.lit(f.name).alias("name"))


FOUND = ("family", "probability", "similarity", "confirmed")


def _wrapped(lines: Column, own: Column, text: Column, model: Model) -> Column:
    """Confirmed families that no line of a paragraph states by itself. Its words are judged in windows of twice the
    longest template, from every such length on, so any run of words as long as a template is in one of them."""
    step = max(len(t) for f in model.families for t in f.templates)

    def judged(words: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step)), lambda at: F.slice(words, at + 1, 2 * step))
        gated = F.filter(cut, lambda w: F.arrays_overlap(w, _strings(model.gates)))
        return F.filter(F.flatten(F.transform(gated, lambda w: _judge(w, model))), lambda j: j["confirmed"] & ~F.exists(own, lambda o: o["confirmed"] & (o["family"] == j["family"])))

    def best(js: Column) -> Column:
        rank = lambda j: F.struct(j["probability"], j["similarity"])
        return F.array_distinct(F.filter(js, lambda j: ~F.exists(js, lambda o: (o["family"] == j["family"]) & (rank(o) > rank(j)))))

    found = let(let(F.flatten(F.transform(lines, lambda x: x["words"])), judged), best)
    rows = F.transform(found, lambda j: F.struct(F.lit(0).alias("line"), text.alias("text"), *[j[c].alias(c) for c in FOUND]))
    return F.when(F.size(F.filter(lines, lambda x: F.size(x["words"]) > 0)) > 1, rows).otherwise(F.slice(own, 1, 0))


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, paragraphs: array of (line, text, family, probability, similarity, confirmed): each line that was scored, once
    for every family it states, and paragraphs that state a family over several lines, at their first line."""

    def piece(p: Column) -> Column:
        lines = F.transform(F.split(p, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"), _words(x).alias("words")))

        def of(ls: Column) -> Column:
            gated = F.filter(ls, lambda s: F.arrays_overlap(s["words"], _strings(model.gates)))
            own = F.flatten(F.transform(gated, lambda s: F.transform(_judge(s["words"], model), lambda j: F.struct(s["line"].alias("line"), s["text"].alias("text"), *[j[c].alias(c) for c in FOUND]))))
            return let(own, lambda o: F.concat(o, _wrapped(ls, o, p, model)))

        return let(lines, of)

    def numbered(pieces: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.size(F.split(p, "\n")))
        return F.flatten(F.transform(pieces, lambda p, k: F.transform(piece(p), lambda s: F.struct((s["line"] + before(k)).alias("line"), *[s[c].alias(c) for c in ("text", *FOUND)]))))

    return docs.select(F.col(key), let(F.split(F.coalesce(F.col(text), F.lit("")), BLANK_LINE), numbered).alias("paragraphs"))


def op5_licences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs)).select("doc_id", F.filter("paragraphs", lambda p: p["confirmed"]).alias("sure"), F.filter("paragraphs", lambda p: ~p["confirmed"]).alias("other"))
    families = F.array_sort(F.array_distinct(F.transform("sure", lambda p: p["family"])))
    return found.select("doc_id", F.concat_ws(",", families).alias("families"), F.size("sure").cast("long").alias("n_licences"), F.size("other").cast("long").alias("n_unconfirmed"), F.concat_ws(",", F.transform("sure", lambda p: p["line"].cast("string"))).alias("lines"), F.round(F.array_max(F.transform("sure", lambda p: p["probability"])), 6).alias("probability"))

"""Licence scans: a trained passage classifier confirmed by comparison with templates.

A passage is a run of words that passes GATE, out of lines joined as far as a sentence goes on
inside a paragraph: the whole of it, or a window of a long one. No passage that shares half of
a template's word triples fails GATE, so none of a family is lost by it. A passage's features are hashed words and word pairs; a multinomial logistic regression with
the classes of the licence families, `unknown` (a licence, none of these) and `none` gives
calibrated probabilities. A family is reported when it is the most probable, probable enough,
and the passage shares enough word triples with one of the family's templates; otherwise a
passage that is probably a licence counts as unknown.

The scan itself is DataFrame operations only: the model is a small table that is joined with
the features. Fitting happens on the driver, on the templates and a bounded sample.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.sampling import sample_texts
from corpusq.session import cut_lineage

# Notices as they are commonly worded.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
        "this file except in compliance with the License"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation",
        "Released under the GPL license version 2 or later"],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation"],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3."],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted",
        "Released under the ISC License."],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License"],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Licensed under CC0 1.0 Universal, dedicated to the public domain."],
}
# `{}` stands for an arbitrary word.
OTHER_NOTICES = [
    "All rights reserved.", "Copyright {} {}. All rights reserved.",
    "This software is proprietary and confidential.",
    "Licensed under the {} license.", "Released under the {} {} License, version 1.",
    "Use of this content is subject to the license agreement.",
    "No permission is granted to copy or redistribute this document.",
    "You may not use this work without written permission of {}."]
# Ids and short forms, two or three words each; confirmed by that pair or triple alone.
SHORT_FORMS = {
    "MIT": ["license identifier mit", "mit licensed", "mit license", "under mit"],
    "Apache-2.0": ["license identifier apache", "apache 2.0", "apache licensed"],
    "GPL": ["license identifier gpl", "gpl 2.0", "gpl 3.0", "gpl licensed"],
    "LGPL": ["license identifier lgpl", "lgpl 2.1", "lgpl 3.0", "lgpl licensed"],
    "AGPL": ["license identifier agpl", "agpl 3.0", "agpl licensed"],
    "BSD": ["license identifier bsd", "bsd 2 clause", "bsd 3 clause", "bsd licensed",
            "bsd license"],
    "MPL": ["license identifier mpl", "mpl 2.0", "mpl licensed"],
    "ISC": ["license identifier isc", "isc licensed", "isc license"],
    "CC-BY": ["cc by 4.0", "cc by 3.0"],
    "CC-BY-SA": ["cc by sa"],
    "CC-BY-NC": ["cc by nc"],
    "public-domain": ["license identifier cc0", "license identifier unlicense", "cc0 1.0"],
}
# Every template has one of these words.
EVIDENCE = ["license", "licensed", "licence", "licenced", "copyright", "permission",
            "redistribution", "gpl", "public", "reserved", "proprietary", "cc", "cc0"]
# Words that let a passage through GATE besides, and are not evidence by themselves.
HINTS = ["software", "documentation", "granted", "charge", "obtaining", "apache", "mozilla",
         "distributed", "agreement", "confidential", "creative", "commons", "dedicated",
         "permitted", "conditions", "provided", "purpose", "terms", "under mit", "the bsd",
         "source", "subject", "compliance"]
# Holds for the lower-cased text or joined words of whatever may be a notice.
GATE = (r"licen[cs]|spdx|gpl|permi[ts]|p(?:ublic|ropriet|rovided|urpose)|reserved|"
        r"c(?:opyright|opyleft|c0|harge|onditions|onfidential|ommons|ompliance|reative)|"
        r"d(?:istribut|ocumentation|edicated)|granted|obtaining|mozilla|"
        r"a(?:pache|greement)|s(?:oftware|ource|ubject)|terms|unencumbered|"
        r"(?<![a-z0-9])(?:cc|bsd|mpl|isc|gnu)(?![a-z0-9])|"
        r"(?:under|the)[^a-z0-9]+mit(?![a-z0-9])|mit[^a-z0-9]+(?:style|x11)")
UNKNOWN, NONE = "unknown", "none"
CLASSES = [*TEMPLATES, UNKNOWN, NONE]

WINDOW, STRIDE = 48, 24         # words
DIM = 4096                      # hashed features
SAMPLE_DOCS, SAMPLE_CHARS = 800, 300
VARIANTS = 14                   # training passages made of each template
LEAST_PROBABILITY = 0.5
LEAST_SHARED = 0.5              # share of a template's word triples

WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Parts of hyphened words are words; only version numbers keep their points.
PART = r"[a-z0-9]+(?:\.[0-9]+)*"
# A line that ends a sentence, or one without letters and digits, ends a run of lines.
RUN_END = (r"(?<=[.!?])(?<![\s(][vV]\.)[^\p{L}\p{N}\n]*\n|\n[^\p{L}\p{N}\n]*\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PART), F.lit(0))


def features(word: Column) -> Column:
    """Distinct hashed words and pairs of neighbours."""
    singles = F.transform(word, lambda w: F.pmod(F.xxhash64(w), F.lit(DIM)))
    pairs = F.transform(
        F.slice(word, 2, F.greatest(F.size(word), F.lit(1))),
        lambda w, i: F.pmod(F.xxhash64(F.get(word, i), w), F.lit(DIM)))
    return F.array_distinct(F.concat(singles, pairs))


def triples(word: Column) -> Column:
    """Distinct hashes of three words in a row."""
    return F.array_distinct(F.transform(
        F.slice(word, 3, F.greatest(F.size(word), F.lit(1))),
        lambda w, i: F.xxhash64(F.get(word, i), F.get(word, i + 1), w)))


def pairs(word: Column) -> Column:
    """Distinct hashes of two words in a row."""
    return F.array_distinct(F.transform(
        F.slice(word, 2, F.greatest(F.size(word), F.lit(1))),
        lambda w, i: F.xxhash64(F.get(word, i), w)))


def windows(word: Column) -> Column:
    """A short run as it is; a long one as overlapping windows."""
    return F.when(F.size(word) <= WINDOW, F.array(word)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1)), F.lit(STRIDE)),
        lambda at: F.slice(word, at, WINDOW)))


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as constants of the plan."""
    return spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


# --- fitting -------------------------------------------------------------------------------

def training_texts(plain: list[str], seed: int = 5) -> list[tuple[str, str]]:
    """(class, passage): templates with words left out and plain words around them, short
    forms, and plain passages."""
    dice = random.Random(seed)
    vocabulary = sorted({w for t in plain for w in t.split()}) or ["word"]
    some = lambda n: [dice.choice(vocabulary) for _ in range(dice.randint(0, n))]
    out = []
    sources = [(k, t) for k, ts in TEMPLATES.items() for t in ts]
    sources += [(UNKNOWN, t) for t in OTHER_NOTICES]
    short = {t for ts in SHORT_FORMS.values() for t in ts}
    sources += [(k, f"spdx {t}" if t.startswith("license identifier") else t)
                for k, ts in SHORT_FORMS.items() for t in ts]
    for kind, template in sources:
        for n in range(VARIANTS):
            line = [dice.choice(vocabulary) if "{}" in w else w for w in template.split()]
            if n and kind == UNKNOWN:
                line = [w for w in line if dice.random() > 0.05]
            elif n and template not in short and not template.startswith("spdx "):
                line = [w for w in line if dice.random() > 0.03]
            out.append((kind, " ".join([*some(12), *line, *some(12)] if n % 2 else line)))
    out += [(NONE, t) for t in plain]
    out += [(NONE, w) for w in EVIDENCE + HINTS for _ in range(3)]
    out += [(NONE, " ".join([*some(9), w, *some(9)])) for w in EVIDENCE + HINTS
            for _ in range(8)]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.5,
        decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (DIM, classes), intercepts, and the temperature that fits a held-out third."""
    x = np.zeros((len(rows), DIM), np.float32)
    for i, (_, found) in enumerate(rows):
        x[i, found] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[[CLASSES.index(k) for k, _ in rows]]
    balance = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)]
    balance = (balance / balance.mean()).astype(np.float32)[:, None]
    test = np.arange(len(rows)) % 3 == 2

    def descend(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(x[on].any(0))
        part = x[on][:, used]
        w, b = np.zeros((len(used), len(CLASSES)), np.float32), np.zeros(len(CLASSES))
        seen = np.full_like(w, 1e-6)
        for _ in range(rounds):
            off = (softmax(part @ w + b) - y[on]) * balance[on] / on.sum()
            slope = part.T @ off + decay * w
            seen += slope ** 2
            w -= rate * slope / np.sqrt(seen) * 0.2
            b -= rate * off.sum(0)
        full = np.zeros((DIM, len(CLASSES)))
        full[used] = w
        return full, b

    w, b = descend(~test)
    scores, truth = x[test] @ w + b, y[test].argmax(1)
    heat = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
            if len(truth) else abs(math.log(t)) for t in heat]
    w, b = descend(np.ones(len(rows), bool))
    return w, b, heat[int(np.argmin(loss))]


def learn_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                   ) -> tuple[DataFrame, DataFrame]:
    """(feature, weights) and (family, triples): the model and the templates as tables. The
    intercepts are feature -1; weights are divided by the temperature."""
    spark = docs.sparkSession
    plain = sample_texts(docs, id_col, text_col, SAMPLE_DOCS, SAMPLE_CHARS)
    plain = [t for t in plain if not any(e in t.lower() for e in EVIDENCE[:7])]
    rows = [{"kind": k, "text": t} for k, t in training_texts(plain)]
    table = inline_table(spark, rows, "kind: string, text: string").select(
        "kind", features(F.slice(words(F.col("text")), 1, WINDOW)).alias("f"))
    w, b, heat = fit([(r["kind"], r["f"]) for r in table.collect()])
    used = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    weights = [{"feature": -1, "weights": (b / heat).round(6).tolist()}]
    weights += [{"feature": int(f), "weights": (w[f] / heat).round(6).tolist()} for f in used]
    model = inline_table(spark, weights, "feature: bigint, weights: array<double>")
    templates = inline_table(
        spark, [{"family": k, "text": t} for ts in (TEMPLATES, SHORT_FORMS)
                for k in ts for t in ts[k]],
        "family: string, text: string").withColumn("word", words(F.col("text"))).select(
        "family", F.when(F.size("word") > 2, triples(F.col("word"))).otherwise(
            pairs(F.col("word"))).alias("template"))
    return model, templates


# --- scanning -----------------------------------------------------------------------------

def passages(text: Column) -> Column:
    """array<struct<run: int, at: int, word: array<string>>>: the windows of a text's runs of
    lines that pass GATE. Texts without any are told apart by a single search."""
    runs = F.transform(F.split(text, RUN_END), lambda run, i: F.struct(
        i.alias("run"), run.alias("text")))
    held = F.filter(runs, lambda x: F.lower(x["text"]).rlike(GATE))
    found = F.flatten(F.transform(held, lambda x: F.transform(
        windows(words(x["text"])), lambda w, i: F.struct(
            x["run"].alias("run"), i.alias("at"), w.alias("word")))))
    return F.when(F.lower(text).rlike(GATE), F.filter(
        found, lambda p: F.array_join(p["word"], " ").rlike(GATE)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_probability: float = LEAST_PROBABILITY,
                  least_shared: float = LEAST_SHARED) -> DataFrame:
    """doc_id, families, n_families, unknown: one row per input row.

    `families` are the distinct licence families of a document, by name, comma-joined; empty
    for a null or empty text or one without licence. `unknown` says that some passage looks like
    a licence but none of these is confirmed in it or in one that overlaps it. Rows that repeat an id, or have none, are scanned each by
    itself; other columns are not looked at.
    """
    model, templates = learn_licenses(docs, id_col, text_col)
    held = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id()
                                   .alias("row"), passages(F.col(text_col)).alias("found")))
    any_found = F.coalesce(F.size("found") > 0, F.lit(False))
    each = held.where(any_found).select("row", F.posexplode("found").alias("n", "p")).select(
        "row", "n", "p.run", "p.at", "p.word")
    key = ["row", "run", "at", "n"]
    scored = (each.select(*key, F.explode(F.concat(features(F.col("word")), F.array(F.lit(
        -1).cast("bigint")))).alias("feature")).join(F.broadcast(model), "feature")
        .groupBy(*key).agg(*[F.sum(F.get("weights", F.lit(i))).alias(f"s{i}")
                             for i in range(len(CLASSES))]))
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(CLASSES))])
    total = sum((F.exp(F.col(f"s{i}") - top) for i in range(1, len(CLASSES))),
                F.exp(F.col("s0") - top))
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(c).alias("c"))
                                 for i, c in enumerate(CLASSES[:-2])]))
    none = F.col(f"s{len(CLASSES) - 1}")
    judged = scored.select(*key, best["c"].alias("family"),
                           (F.exp(best["s"] - top) / total).alias("p"),
                           (F.exp(none - top) / total).alias("p_none"))
    shared = (each.select(*key, F.concat(triples(F.col("word")), pairs(F.col("word"))).alias(
        "own"))
              .join(judged.where(F.col("p") >= least_probability), key)
              .join(F.broadcast(templates), "family")
              .groupBy(*key).agg(F.max(F.size(F.array_intersect("own", "template"))
                                       / F.size("template")).alias("shared")))
    sure = F.coalesce(F.col("shared") >= least_shared, F.lit(False))
    of_run = judged.join(shared, key, "left").groupBy("row", "run").agg(
        F.collect_set(F.when(sure, F.col("family"))).alias("families"),
        F.collect_list(F.when(sure, F.col("at"))).alias("sure"),
        F.collect_list(F.when(F.col("p_none") < 0.5, F.col("at"))).alias("likely"))
    result = of_run.groupBy("row").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ","
                     ).alias("families"),
        F.max(F.exists("likely", lambda i: ~F.exists("sure", lambda k: F.abs(k - i) <= 1))
              ).alias("unknown"))
    with_some = held.where(any_found).join(result, "row", "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("unknown", F.lit(False)).alias("unknown"))
    without = held.where(~any_found).select("doc_id", F.lit("").alias("families"),
                                            F.lit(False).alias("unknown"))
    return with_some.union(without).select(
        "doc_id", "families",
        F.when(F.col("families") == "", 0).otherwise(F.size(F.split("families", ","))
                                                     ).cast("bigint").alias("n_families"),
        "unknown")

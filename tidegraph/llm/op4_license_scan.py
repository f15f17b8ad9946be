"""Licence scan with a trained paragraph classifier; DataFrame functions only.

A sparse multinomial logistic regression over word n-grams (n = 1, 2) tells licence
families and "unknown" apart. It is trained in the driver on a fixed, bounded set of
labelled paragraphs that are built from the families' wordings, from the wordings of
licences outside the families and from plain prose (``training_set``). Temperature
scaling on paragraphs of other frames and other foreign licences calibrates it. Only the
wordings' own n-grams carry weight. A paragraph without any of the wordings' marking
words (``STEMS``, by which n-grams become features at all) has no feature but the bias.

A prediction must be sure enough, and is confirmed by comparison with the
family's template: the share of the template's n-grams that the paragraph holds.

A paragraph ends at a blank line or at a line that ends a sentence, so that wrapped lines
are judged together. Scoring is a row-local expression: no shuffle, no Python. A null or
empty text has no paragraph of any family; repeated rows give equal rows. Columns of any
name pass untouched (they travel in a struct), but ``licenses`` is replaced.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "unknown"
#: Canonical wording by family; {0} is filled with names and years.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "distributed under the apache 2.0 license", "spdx license identifier apache 2.0"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "spdx license identifier mit"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "released under the agpl version 3", "spdx license identifier agpl 3.0 only"],
    "epl-2.0": ["this program is made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0", "spdx license identifier epl 2.0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx license identifier isc"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense"],
    "cc-by-nd": ["licensed under cc by nd 4.0", "licensed under a creative commons attribution noderivatives license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "released under the gpl version 3", "spdx license identifier gpl 3.0 or later"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "released under the gpl version 2", "spdx license identifier gpl 2.0 only"],
    "lgpl": ["licensed under the gnu lesser general public license", "released under the lgpl version 2.1", "spdx license identifier lgpl 2.1 or later"],
    "bsd": ["licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "released under the 3 clause bsd license", "spdx license identifier bsd 3 clause"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license", "spdx license identifier mpl 2.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike license"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "no rights reserved public domain dedication", "spdx license identifier cc0 1.0"],
    "proprietary": ["all rights reserved", "copyright {0} all rights reserved", "no part of this work may be reproduced without written permission"],
}
#: Plain sentences, some with licence words in another sense.
PROSE = [
    "the driver renewed a license before the trip", "poetic license is granted to every novelist", "he was licensed to practise medicine in two states",
    "public opinion was divided on the general question", "the bill was released under pressure from the public", "permission to enter the garden was granted at noon",
    "copyright law is taught in the second year", "rights were reserved for the first people in line", "the terms of the agreement were never published",
    "general practice and public health in the city", "the version of the story told by his sister", "a fishing license costs ten crowns a year",
    "apache helicopters flew over the valley", "the mozilla foundation held a meeting", "students at mit built the machine", "the creative use of common words",
    "free charge for every person who came", "source and binary stars were observed", "the weather was fine and the road was empty", "she wrote the letter and sent it the same day",
]
#: Licences outside the families: they are unknown. The first half trains, the second calibrates.
FOREIGN = [
    "licensed under the zlib license", "distributed under the boost software license version 1.0", "licensed under the european union public licence version 1.2", "released under the open data commons license",
    "spdx license identifier zlib", "licensed under the microsoft public license", "driver license renewed under the general rules", "all rights to the driver are reserved for the day",
    "licensed under the artistic license 2.0", "released under the sil open font license", "licensed under the common development and distribution license", "spdx license identifier bsl 1.0",
]
#: A word that starts so makes a paragraph a candidate, and an n-gram a feature.
STEMS = ["licen[cs]", "copyright", "gpl", "lgpl", "apache", "mit$", "bsd", "mozilla", "mpl", "cc$", "cc0", "creative", "redistribut", "permission", "permitted", "reserved", "public$", "gnu", "compliance", "reproduced", "affero", "agpl", "eclipse", "epl$", "isc$", "unlicense", "unencumbered", "spdx"]

TRAINED_ON, EPOCHS, RATE, L1, L2, SEED = 3000, 200, 2.0, 2e-4, 1e-4, 4
#: Least calibrated probability, and least share of the best template.
SURE, CONFIRM = 0.6, 0.6

#: Ends of paragraphs: a line's end after a sentence's, or a blank line.
PARAGRAPH = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
_STEM = re.compile("(?:" + "|".join(STEMS) + ")")


def grams(text: str) -> list[str]:
    """Words and word pairs of a paragraph."""
    words = re.findall(WORD, text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905


def has_stem(text: str) -> bool:
    return any(_STEM.match(w) for w in re.findall(WORD, text.lower()))


def built(families: list[str], foreign: list[str], prose: list[str], n: int, rng: random.Random) -> list[tuple[str, str]]:
    """(paragraph, family) rows: wordings with a word dropped or framed by other words, and prose."""
    words_of = sorted({w for p in prose for w in p.split()})
    rows = []
    for k in range(n):
        family = families[k // 2 % len(families)] if k % 2 == 0 else UNKNOWN
        if family == UNKNOWN and k % 3 == 0:
            words = rng.choice(foreign).split()
        elif family == UNKNOWN:
            words = rng.choice(prose).split() if rng.random() < 0.6 else rng.choices(words_of, k=rng.randint(3, 25))
        else:
            words = rng.choice(TEMPLATES[family]).format(rng.choice(["2019", "2021 acme inc", "the authors"])).split()
            if rng.random() < 0.3 and len(words) > 8:
                del words[rng.randrange(len(words))]
        if rng.random() < 0.5:
            extra = rng.choices(words_of, k=rng.randint(1, 12))
            words = extra + words if rng.random() < 0.5 else words + extra
        rows.append((" ".join(words), family))
    return rows


def training_set(n: int = TRAINED_ON, seed: int = SEED) -> list[tuple[str, str]]:
    """Four fifths train, the last fifth calibrates: with frames, prose and foreign licences of its own."""
    rng, families = random.Random(seed), sorted(TEMPLATES)
    half, cut = len(FOREIGN) * 2 // 3, len(PROSE) * 3 // 4
    return built(families, FOREIGN[:half], PROSE[:cut], n * 4 // 5, rng) + built(families, FOREIGN[half:], PROSE[cut:], n - n * 4 // 5, rng)


class Model:
    """Weights of n-grams by family, the temperature, and the templates' n-grams."""

    def __init__(self):
        rows = training_set()
        cut = len(rows) * 4 // 5
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t.replace("{0} ", ""))})
        number = {g: k for k, g in enumerate(self.vocabulary)}

        def matrix(part):
            x, y = np.zeros((len(part), len(number) + 1)), np.zeros(len(part), int)
            for i, (p, f) in enumerate(part):
                for g in set(grams(p)):
                    if g in number:
                        x[i, number[g]] = 1
                x[i, -1] = 1
                y[i] = self.families.index(f)
            return x, y

        x, y = matrix(rows[:cut])
        w = np.zeros((x.shape[1], len(self.families)))
        goal = np.eye(len(self.families))[y]
        for _ in range(EPOCHS):
            p = softmax(x @ w)
            w -= RATE * (x.T @ (p - goal) / len(x) + L2 * w)
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - RATE * L1)  # sparse
        held, truth = matrix(rows[cut:])
        scores = held @ w
        self.temperature = min((0.25 * 2 ** (k / 4) for k in range(17)), key=lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).sum())
        self.accuracy = float((scores.argmax(1) == truth).mean())
        used = np.abs(w[:-1]).max(1) > 0
        self.vocabulary = [g for g, u in zip(self.vocabulary, used, strict=True) if u]
        self.weights, self.bias = w[:-1][used], w[-1]
        self.templates = {f: [sorted(set(grams(t.replace("{0} ", "")))) for t in ts] for f, ts in TEMPLATES.items()}

    def predict(self, paragraph: str) -> tuple[str, float, bool]:
        """(family, probability, confirmed): the same as the expression gives, for tests."""
        if not has_stem(paragraph):  # no feature: the bias alone
            return UNKNOWN, 1.0, False
        found = set(grams(paragraph))
        hit = [k for k, g in enumerate(self.vocabulary) if g in found]
        p = softmax((self.bias + self.weights[hit].sum(0))[None] / self.temperature)[0]
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < SURE:
            return UNKNOWN, float(p[k]), False
        share = max(len(found.intersection(t)) / len(t) for t in self.templates[family])
        return family, float(p[k]), share >= CONFIRM


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def _sql(value) -> str:
    """A SQL literal: one parsed expression instead of thousands of calls."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return f"array({', '.join(map(_sql, value))})"
    return f"{float(value)!r}D"


def _texts(values: list[str]) -> Column:
    return F.expr(_sql(values))


def paragraph_grams(line: Column) -> Column:
    """Distinct words and word pairs."""
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), 0)
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))))


def scan(docs: DataFrame) -> DataFrame:
    """All of ``docs``'s columns and ``licenses``: array of (paragraph, family, probability, confirmed), one for each paragraph of a family."""
    m = model()
    stem = r"(?i)(?<![a-z0-9])(?:" + "|".join(s.replace("$", "(?![a-z0-9])") for s in STEMS) + ")"
    parts = F.split(F.coalesce("text", F.lit("")), PARAGRAPH, -1)
    numbered = F.filter(F.transform(parts, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: x["text"].rlike(stem))
    names = [c for c in docs.columns if c != "licenses"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), numbered.alias("lines"))
    df = df.withColumn("grams", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), paragraph_grams(x["text"]).alias("g"))))
    weight = F.map_from_arrays(_texts(m.vocabulary), F.expr(_sql(m.weights.tolist())))
    bias = F.expr(_sql(m.bias.tolist()))

    none = F.expr(_sql([0.0] * len(m.families)))

    def scored(x: Column) -> Column:
        total = F.aggregate(x["g"], bias, lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(weight, g), none), lambda a, b: a + b))
        return F.struct(x["line"].alias("line"), x["g"].alias("g"), total.alias("z"))

    df = df.withColumn("scored", F.transform("grams", scored))

    def chosen(x: Column) -> Column:
        top = F.array_max(x["z"])
        p = 1 / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp((z - top) / m.temperature))
        return F.struct(x["line"].alias("line"), x["g"].alias("g"), F.get(_texts(m.families), (F.array_position(x["z"], top) - 1).cast("int")).alias("family"), p.alias("probability"))

    df = df.withColumn("chosen", F.filter(F.transform("scored", chosen), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= SURE)))

    def confirmed(x: Column) -> Column:
        shares = [F.when(x["family"] == f, F.size(F.array_intersect(x["g"], _texts(t))) / len(t)).otherwise(0.0) for f, ts in m.templates.items() for t in ts]
        share = F.greatest(*shares)
        return F.struct(x["line"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), (share >= CONFIRM).alias("confirmed"))

    return df.select(*[F.col(f"row.`{c}`") for c in names], F.transform("chosen", confirmed).alias("licenses"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return df.select("doc_id", F.size("licenses").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"), F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))

"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of text, read alone and, as notices are wrapped, with the lines about it up to blank ones (words and
comment marks apart, REACH words each way). Lines that have a word which the classifier itself holds to tell of a licence, and lines near one of the sequences without some of which
no template can be covered, are described by their word n-grams (one to three words), a row for each, so a long line is linear work; a sparse logistic regression over the families and a class for unknown gives probabilities; a temperature
calibrated on held-out examples makes them honest, and below a threshold the family is unknown. A family is confirmed
if the paragraph holds enough of the two-word sequences of one of its templates. Training is numpy on the driver,
over the templates below and distortions of them; scoring is DataFrame functions alone.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import named

UNKNOWN = "unknown"
#: Wording of licence notices by family, in the lower-case words that WORD finds.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under gpl v3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1.0 universal"),
    ("proprietary", "copyright all rights reserved"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission of the publisher"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("cc0", "dedicated to the public domain"),
    ("cc-by", "creative commons attribution 4.0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4.0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4.0 international"),
    *((family, wording.format(name)) for family, name in (("mit", "mit"), ("apache-2.0", "apache 2.0"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd"), ("mpl-2.0", "mpl 2.0")) for wording in ("{} license", "licence {}", "licencia {}", "{}-lizenz")),
    *((family, name) for family, name in (("apache-2.0", "apache 2.0"), ("apache-2.0", "apache license 2.0"), ("cc-by", "cc by 4.0"), ("cc-by", "cc-by 4.0"), ("cc-by-nc", "cc by-nc 4.0"), ("cc-by-sa", "cc by-sa 4.0"), ("cc0", "cc0 1.0"), ("gpl", "gpl v3"), ("mpl-2.0", "mpl 2.0"))),
    *((family, f"spdx-license-identifier {name}") for family, names in (
        ("mit", "mit"), ("apache-2.0", "apache-2.0"), ("gpl", "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later"),
        ("lgpl", "lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later"), ("agpl", "agpl-3.0 agpl-3.0-only agpl-3.0-or-later"), ("bsd", "bsd-2-clause bsd-3-clause"),
        ("mpl-2.0", "mpl-2.0"), ("cc-by", "cc-by-4.0"), ("cc-by-nc", "cc-by-nc-4.0"), ("cc-by-sa", "cc-by-sa-4.0"), ("cc0", "cc0-1.0"),
    ) for name in names.split()),
)
#: Words of the longest template: so far about a line do windows reach.
REACH = max(len(t.split()) for _, t in TEMPLATES)
#: Sentences with key words that are no licence.
OTHER = (
    "he lost his driving license in the city", "she studied at mit for three years", "the apache tribe lived in the plains", "the copyright debate goes on in parliament", "a license to practise medicine is required here",
    "the terms of the agreement were not published", "permission to enter was granted by the guard", "the free software movement began long ago", "a fishing licence costs more this year", "the public domain of the crown was sold",
    "cc me on the mail please", "he reserved all rooms in the hotel", "the license plate was stolen", "version 2.0 of the game is out", "the mozilla office moved", "the bsd conference was in ottawa", "gnu are large animals of africa",
    "licensed taxis wait outside the station", "they redistribute wealth by taxes", "under the bridge a general was waiting",
)
_WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Between blocks of lines: a line without words, comment marks or not.
_BLANK = r"\n[^A-Za-z0-9\n]*\n"


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    grams: dict[str, list[float]]
    bias: list[float]
    least: float


def grams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def pairs(template: str) -> set[str]:
    """The two-word sequences of a template, or its word if it has one only."""
    words = re.findall(_WORD, template)
    return {" ".join(p) for p in zip(words, words[1:])} or {*words}


def _distorted(r: random.Random, words: list[str]) -> list[str]:
    filler = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(0, 6))]
    kept = [w for w in words if r.random() > 0.06] or words
    cut = r.randint(0, len(filler))
    return filler[:cut] + kept + filler[cut:]


@lru_cache(maxsize=1)
def trained(rounds: int = 200, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """The classifier, from a fixed seed: weights of n-grams by family, divided by the calibrated temperature."""
    r = random.Random(31)
    families = (UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES))
    examples = [(families.index(f), _distorted(r, re.findall(_WORD, t))) for f, t in TEMPLATES for _ in range(30)]
    every = [w for _, t in TEMPLATES for w in t.split()]
    for k in range(900):
        words = r.choice(OTHER).split() if k % 3 else [r.choice(every) for _ in range(r.randint(3, 14))]
        examples.append((0, _distorted(r, words)))
    r.shuffle(examples)
    known = sorted({g for _, t in TEMPLATES for g in grams(re.findall(_WORD, t))} | {g for t in OTHER for g in grams(t.split())})
    place = {g: k for k, g in enumerate(known)}
    x, y = np.zeros((len(examples), len(known)), np.float32), np.array([c for c, _ in examples])
    for row, (_, words) in enumerate(examples):
        own = [place[g] for g in grams(words) if g in place]
        x[row, own] = 1
    split = len(x) * 3 // 4
    w, b, goal = np.zeros((len(known), len(families))), np.zeros(len(families)), np.eye(len(families))[y[:split]]
    for _ in range(rounds):
        p = _softmax(x[:split] @ w + b)
        w -= rate * (x[:split].T @ (p - goal) / split + decay * w)
        b -= 0.25 * rate * (p - goal).mean(axis=0)
    margin = x[split:] @ w + b
    loss = {t: -np.log(_softmax(margin / t)[np.arange(len(margin)), y[split:]] + 1e-12).mean() for t in np.geomspace(0.2, 5, 40)}
    t = min(loss, key=loss.get)
    p = _softmax(margin / t)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[split:]
    order = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99)
    least = max(0.5, float(best[order][fine[-1]])) if len(fine) else 1.0
    return Model(families, {g: [round(float(v), 5) for v in w[k] / t] for g, k in place.items()}, [round(float(v), 5) for v in b / t], least)


#: Telling words of a template, and letters of a word at least.
TELLING, LETTERS = 2, 3


@lru_cache(maxsize=1)
def telling() -> tuple[str, ...]:
    """Words by which candidates are found: of each template those that the classifier holds to speak most for its family against unknown."""
    model, out = trained(), set()
    for family, template in TEMPLATES:
        k = model.families.index(family)
        words = sorted({w for w in re.findall(_WORD, template) if len(w) >= LETTERS}, key=lambda w: (model.grams[w][0] - model.grams[w][k], w))
        out.update(words[:TELLING])
    return tuple(sorted(out))


def candidate() -> str:
    """A pattern for lines with a telling word, by first characters, so that a word of another one is passed over at once."""
    return _any_of((w[0], re.escape(w[1:])) for w in telling())


@lru_cache(maxsize=8)
def signs(least_cover: float) -> tuple[str, ...]:
    """Two-word sequences of which every text that covers so much of a template has one: so many of each template that the others are too few. The longest, as these are rare elsewhere."""
    out = set()
    for _, template in TEMPLATES:
        own = sorted(pairs(template), key=lambda p: (-len(p), p))
        out.update(own[: len(own) - ceil(least_cover * len(own) - 1e-9) + 1])
    return tuple(sorted(out))


def sign_pattern(least_cover: float, more: tuple[str, ...] = ()) -> str:
    """A pattern for texts with one of the signs, whatever parts their words, or with one of more words."""
    return _any_of((p[0], re.escape(p[1:].split(" ")[0]) + "".join(f"[^a-z0-9]+{re.escape(w)}" for w in p.split(" ")[1:])) for p in (*more, *signs(least_cover)))


def _any_of(patterns: Iterable[tuple[str, str]]) -> str:
    by: dict[str, list[str]] = {}
    for first, rest in patterns:
        by.setdefault(first, []).append(rest)
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items())) + r")(?![a-z0-9])"


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _literal(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table from one literal."""
    rows = F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _sequences(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces. Words are taken by their place; slices of an array would copy it for each run."""
    more = lambda i: [x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))]
    return F.array_compact(F.transform(words, lambda w, i: F.concat(w, *more(i))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cover: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, cover): a row for each paragraph with a telling word, and for each other one that is sure.

    family is unknown if the classifier says so, is not sure, or no template of the family is covered; template and cover
    tell the best template of the most probable family. The line alone decides if that is sure, else the smallest window about it
    that is and whose template the line has a part of. Lines without a telling word are read wherever a template can be covered; one of them
    that is sure has no row of its own if a line with a telling word in the same window names the same family, as the notice has its row there.
    Paragraphs are numbered from 0. Texts that are null, or have neither a telling word nor a template so far covered,
    give no rows; equal paragraphs and repeated rows give rows each. Lines of any length are linear work. Other columns of docs are not looked at.
    least_cover is over 0, 1 at most.
    """
    if not 0 < least_cover <= 1:
        raise ValueError("least_cover must be over 0, 1 at most")
    model, spark, pattern, sign = trained(), docs.sparkSession, candidate(), sign_pattern(least_cover)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), F.lower(named(text_col).cast("string")).alias("text"))
    lines = docs.where(F.col("text").rlike(sign_pattern(least_cover, telling()))).select("doc_id", F.split("text", "\n").alias("lines"), F.col("text").rlike(sign).alias("signed")).withColumn("origin", F.monotonically_increasing_id())
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    told = lambda i: F.get("lines", i).rlike(pattern)
    at = F.transform(F.filter(numbers, told), lambda i: F.struct(i.alias("paragraph"), F.lit(True).alias("told")))
    # Other lines: those with a sign so near that a window may hold it. A sign may begin in one line and end in the next.
    near = F.transform(numbers, lambda i: F.when(F.concat_ws("\n", F.get("lines", i), F.get("lines", i + 1)).rlike(sign), i))
    about = F.filter(F.array_distinct(F.flatten(F.transform(F.array_compact(near), lambda i: F.sequence(F.greatest(i - REACH, F.lit(0)), F.least(i + 1 + REACH, F.size("lines") - 1))))), lambda i: F.get("lines", i).rlike("[a-z0-9]") & ~told(i))
    also = F.transform(about, lambda i: F.struct(i.alias("paragraph"), F.lit(False).alias("told")))
    # Outer, as for others Spark first asks if there are any, which computes them twice.
    at = F.explode_outer(F.when(F.col("signed"), F.concat(at, also)).otherwise(at)).alias("at")
    lines = lines.select("doc_id", "origin", "lines", at).where("at is not null").select("doc_id", "origin", "lines", "at.*")
    found_words = lambda c: F.regexp_extract_all(c, F.lit(f"({_WORD})"), 1)
    first = F.greatest(F.col("paragraph") - REACH, F.lit(0))
    above = F.concat(F.array_join(F.slice("lines", first + 1, F.col("paragraph") - first), "\n"), F.lit("\n"))
    below = F.concat(F.lit("\n"), F.array_join(F.slice("lines", F.col("paragraph") + 2, F.lit(REACH)), "\n"))
    above, below = F.element_at(F.split(above, _BLANK), -1), F.element_at(F.split(below, _BLANK), 1)
    # Lines that REACH words upwards or downwards take, for those that may have their row elsewhere.
    sizes = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.size(found_words(x))), lambda n: n > 0)
    taken = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words")), lambda a, n: F.struct((a["lines"] + (a["words"] < REACH).cast("int")).alias("lines"), (a["words"] + n).alias("words")))["lines"]
    far = lambda c: F.when(~F.col("told"), taken(c))
    parts = lines.select(
        "doc_id", "paragraph", "origin", "told", found_words(F.get("lines", F.col("paragraph"))).alias("line"), F.reverse(F.slice(F.reverse(found_words(above)), 1, REACH)).alias("above"), F.slice(found_words(below), 1, REACH).alias("below"),
        far(F.reverse(sizes(above))).alias("up"), far(sizes(below)).alias("down"),
    )
    # A window's n-grams; the words of the line and the pairs that begin or end in it are its own, and `touch` tells them.
    window = lambda k, a, b: F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"))
    up, down, none = F.size("above") > 0, F.size("below") > 0, F.array().cast("array<string>")
    windows = F.array(window(0, none, none), F.when(down, window(1, none, F.col("below"))), F.when(up, window(2, F.col("above"), none)), F.when(up & down, window(3, F.col("above"), F.col("below"))))
    key = "doc_id", "paragraph", "origin", "told", "up", "down"
    nearer = lambda a, b: F.concat(F.reverse(F.slice(F.reverse(a), 1, 1)), "line", F.slice(b, 1, 1))
    touching = lambda near: F.array_distinct(F.concat("line", _sequences(near, 2)))
    # Of the lines without a telling word, those that have a part of a template which the widest window covers.
    kept = F.from_json(F.lit(json.dumps([{"pairs": sorted(pairs(t))} for _, t in TEMPLATES])), "array<struct<pairs: array<string>>>")
    parts = parts.withColumn("touching", F.when(~F.col("told"), F.array_intersect(touching(nearer("above", "below")), F.array_distinct(F.flatten(F.transform(kept, lambda t: t["pairs"]))))))
    widest = F.concat("above", "line", "below")
    widest = F.concat(widest, _sequences(widest, 2))
    able = F.exists(F.filter(kept, lambda t: F.arrays_overlap(t["pairs"], F.col("touching"))), lambda t: F.size(F.array_intersect(t["pairs"], widest)) / F.size(t["pairs"]) >= least_cover)
    read = F.when(F.col("told") | ((F.size("touching") > 0) & able), F.array_compact(windows))
    wide = parts.select(*key, "line", F.explode_outer(read).alias("w")).where("w is not null").select(*key, "line", "w.*")
    wide = wide.select(*key, "k", "line", nearer("a", "b").alias("near"), F.concat("a", "line", "b").alias("words"))
    grams_of = F.array_distinct(F.concat("words", _sequences(F.col("words"), 2), _sequences(F.col("words"), 3)))
    gram = lambda touch, every: F.transform(every, lambda g: F.struct(g.alias("gram"), F.lit(touch).alias("touch")))
    # An empty n-gram, which is always known, keeps the windows that have no other known one.
    every = F.concat(gram(False, F.array(F.lit(""))), gram(False, grams_of), F.when(F.col("k") > 0, gram(True, touching(F.col("near")))).otherwise(F.array()))
    rows = wide.select(*key, "k", F.explode_outer(every).alias("x")).select(*key, "k", "x.*")

    pairs_of: dict[str, list[int]] = {}
    sizes = [len(pairs(t)) for _, t in TEMPLATES]
    for k, (_, t) in enumerate(TEMPLATES):
        for p in pairs(t):
            pairs_of.setdefault(p, []).append(k)
    n = len(model.families)
    known = F.broadcast(_literal(spark, [{"gram": g, "weights": w, "templates": pairs_of.get(g, [])} for g, w in (model.grams | {"": [0.0] * n}).items()], "gram: string, weights: array<double>, templates: array<int>"))
    zero = F.array(*[F.lit(0.0)] * n)
    hits = rows.join(known, "gram").select(*key, "k", "touch", F.when(~F.col("touch"), F.col("weights")).otherwise(zero).alias("weights"), "templates")
    sums = [(F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)) + model.bias[k]).alias(f"m{k}") for k in range(n)]
    # Pairs of templates that a window has, by template; at most as many as all templates have.
    seen = F.flatten(F.collect_list(F.when(F.size("templates") > 0, F.transform("templates", lambda t: F.struct(t.alias("t"), F.col("touch").alias("touch")))))).alias("seen")
    scored = hits.groupBy(*key, "k").agg(*sums, seen)
    # The greatest margin first; of equal ones the family that comes last.
    best = F.array_max(F.array(*[F.struct(F.col(f"m{k}").alias("margin"), F.lit(k).alias("family")) for k in range(n)]))
    scored = scored.withColumn("best", best).withColumn("probability", 1 / sum(F.exp(F.col(f"m{k}") - F.col("best.margin")) for k in range(n)))
    guessed = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.col("best.family") + 1)
    kinds = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(f).alias("guess"), F.lit(t).alias("template"), F.lit(size).alias("size")) for k, ((f, t), size) in enumerate(zip(TEMPLATES, sizes))])
    of_guess = F.filter(kinds, lambda x: x["guess"] == F.col("guess"))
    count = lambda x, touch: F.size(F.filter("seen", lambda s: (s["t"] == x["t"]) & (s["touch"] == touch)))
    compared = F.transform(of_guess, lambda x: F.struct((count(x, False) / F.greatest(x["size"], F.lit(1))).alias("cover"), x["template"].alias("template"), ((F.col("k") == 0) | (count(x, True) > 0)).alias("part")))
    found = scored.select(*key, "k", guessed.alias("guess"), "probability", "seen").withColumn("t", F.array_max(compared)).withColumn("t", F.coalesce("t", F.struct(F.lit(0.0).alias("cover"), F.lit(None).cast("string").alias("template"), F.lit(False).alias("part"))))
    sure = (F.col("probability") >= model.least) & (F.col("t.cover") >= least_cover) & F.col("t.part")
    # The smallest sure window first, then the line alone.
    chosen = found.withColumn("unsure", ~sure).withColumn("row", F.struct("unsure", "k", "guess", "probability", "t"))
    chosen = chosen.groupBy(*key).agg(F.min("row").alias("c"))
    chosen = chosen.select(*key, F.col("c.guess").alias("guess"), F.col("c.unsure").alias("unsure"), "c").where(F.col("told") | ~F.col("unsure"))
    # The nearest lines above and below with a telling word and the same family: has the window one?
    by = Window.partitionBy("origin", "guess")
    naming = F.when(F.col("told") & ~F.col("unsure"), F.col("paragraph"))
    over, under = (F.last(naming, True).over(by.orderBy(order)) for order in (F.asc("paragraph"), F.desc("paragraph")))
    here = (F.col("c.k").isin(2, 3) & (F.col("paragraph") - over <= F.col("up"))) | (F.col("c.k").isin(1, 3) & (under - F.col("paragraph") <= F.col("down")))
    return chosen.withColumn("elsewhere", F.coalesce(here, F.lit(False))).where(F.col("told") | ~F.col("elsewhere")).select(
        "doc_id", "paragraph", F.when(~F.col("unsure"), F.col("guess")).otherwise(UNKNOWN).alias("family"), F.round("c.probability", 6).alias("probability"), "c.t.template", F.round("c.t.cover", 6).alias("cover")
    )

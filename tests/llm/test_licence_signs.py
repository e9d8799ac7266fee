"""Lines that cover a template without a word that tells of a licence."""

from __future__ import annotations

import random
import re
from math import exp

import pytest

from ledgerweave.llm import licences


def sure(words, line, near):
    """The family of words if the classifier and a template confirm it."""
    model = licences.trained()
    margin = [b + sum(model.grams[g][k] for g in licences.grams(words) if g in model.grams) for k, b in enumerate(model.bias)]
    k = max(range(len(margin)), key=lambda i: (margin[i], i))
    own, touching = {*words, *map(" ".join, zip(words, words[1:]))}, {*line, *map(" ".join, zip(near, near[1:]))}
    templates = [(len(licences.pairs(t) & own) / len(licences.pairs(t)), t) for f, t in licences.TEMPLATES if f == model.families[k]]
    cover, template = max(templates, default=(0, ""))
    return model.families[k] if 1 / sum(exp(m - margin[k]) for m in margin) >= model.least and cover >= 0.6 and licences.pairs(template) & touching else None


def every_line(text):
    """(line, has a telling word, family of the smallest sure window, lines of that) of every line, whatever its words."""
    lines = [re.findall(licences._WORD, x.lower()) for x in text.split("\n")]
    for i, line in enumerate(lines):
        if not line:
            continue
        block = []
        for step in (-1, 1):
            block.append([])
            j = i + step
            while 0 <= j < len(lines) and lines[j]:
                block[-1] += [(j, w) for w in lines[j][::step]]
                j += step
        above, below = block[0][: licences.REACH][::-1], block[1][: licences.REACH]
        family, at = None, {i}
        for k, (a, b) in enumerate((([], []), ([], below), (above, []), (above, below))):
            words = [*(w for _, w in a), *line, *(w for _, w in b)]
            near = [*(w for _, w in a[-1:]), *line, *(w for _, w in b[:1])]
            if (k == 0 or a or b) and (found := sure(words, line, words if k == 0 else near)):
                family, at = found, {i, *(j for j, _ in a), *(j for j, _ in b)}
                break
        yield i, bool(re.search(licences.candidate(), text.split("\n")[i])), family, at


def expected(text):
    rows = list(every_line(text))
    named = {(i, f) for i, told, f, _ in rows if told and f}
    return [(i, f or "unknown") for i, told, f, at in rows if told or f and not any((j, f) in named for j in at)]


def test_a_notice_without_telling_words(spark):
    rows = [
        (1, "No part of this publication may be reproduced without permission of the publisher."),
        (2, "Permission is hereby granted, free of cost, to a person obtaining a copy of this software"),
        (3, "text\n# no part of this publication may be\n# reproduced without permission\n# of the publisher\nmore"),
    ]
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(i, n, f) for i, t in rows for n, f in expected(t)]
    assert {i: f for i, _, f in found} == {1: "proprietary", 2: "mit", 3: "proprietary"}


def test_against_every_line(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(1, 3)):
            words += [w for w in r.choice(licences.TEMPLATES)[1].split() if r.random() > 0.12] + r.choices(["the", "river", "of", "any", "zz"], k=r.choice((0, 3, 40)))
        rows.append((i, "".join(w + r.choice((" ", " ", " ", "\n", "\n# ", ", ", "\n\n")) for w in words)))
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, rows[0][1].upper()), (302, None)]
    found = sorted((x["doc_id"], x["paragraph"], x["family"]) for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted((i, n, f) for i, t in rows if t for n, f in expected(t))


@pytest.mark.parametrize("least", [0.0, 1.1])
def test_cover_out_of_range(spark, least):
    with pytest.raises(ValueError):
        licences.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), least_cover=least)


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_signs_leave_too_few_others(least):
    for _, template in licences.TEMPLATES:
        own = licences.pairs(template)
        assert len(own - {*licences.signs(least)}) < least * len(own)

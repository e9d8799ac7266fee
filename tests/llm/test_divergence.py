from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerweave.llm import divergence


def brute(rows, least=30, first=50):
    """What the contract says, term by term."""
    number, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        number[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: {t: number[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(x[t] for x in of.values()) for t in kept}
        share = lambda x: {t: 1 + 10**9 * (c + 5) // (sum(x.values()) + 5 * len(kept)) for t, c in x.items()}
        p, q = {s: share(x) for s, x in of.items()}, share(whole)
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in of if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if of[source][t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, first)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def documents(seed, n, sources, words):
    r = random.Random(seed)
    names = [f"s{k}" for k in range(sources)]
    own = {s: r.sample(words, max(1, len(words) // 3)) for s in names}
    rows = []
    for k in range(n):
        s = names[min(int(r.expovariate(0.3)), sources - 1)]
        text = r.choice([" ", ", ", "1", "\n"]).join(r.choices(own[s] if r.random() < 0.8 else words, k=r.randint(0, 40)))
        rows.append((text, r.choice(["en", "de"]), s))
    return rows + [(None, "en", "s0"), ("", "fr", "s1"), (None, "fr", None), ("only here", None, "s1"), ("ÉA éa ÉA", "en", "mute")]


def found(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)


WORDS = [a + b for a in ("ab", "Zé", "日", "x", "Q") for b in ("c", "dd", "É", "eee", "f", "gh")]


@pytest.mark.parametrize("seed, sources, least", [(1, 6, 5), (2, 14, 30), (3, 25, 1), (4, 3, 1000)])
def test_against_brute_force(spark, seed, sources, least):
    rows = documents(seed, 400, sources, WORDS)
    assert found(divergence.audit(frame(spark, rows), least_docs=least)) == brute(rows, least)


@pytest.mark.parametrize("light", [1, 3, 100])
def test_any_split_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(divergence, "LIGHT", light)
    rows = documents(5, 300, 12, WORDS)
    assert found(divergence.audit(frame(spark, rows), least_docs=3, first_terms=4)) == brute(rows, 3, 4)


def test_more_sources_than_a_tile(spark):
    r = random.Random(7)
    rows = [(" ".join(r.choices(WORDS, k=6)), "en", f"s{k % 150}") for k in range(450)]
    assert divergence.GROUPS < 150
    assert found(divergence.audit(frame(spark, rows), least_docs=40)) == brute(rows, 40)


def test_more_terms_than_a_tile(spark):
    words = ["".join(chr(97 + k // 26**e % 26) for e in range(3)) for k in range(3 * divergence.TERMS)]
    rows = [(" ".join(words[k % 7 :: 2]), "en", f"s{k % 12}") for k in range(24)]
    assert found(divergence.audit(frame(spark, rows), least_docs=2)) == brute(rows, 2)


def test_counts_beyond_64_bits(spark):
    got = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "c long, n long, v long").select(divergence.share("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_long_texts_and_empty_tables(spark):
    long = "word other " * (divergence.BYTES // 8)
    rows = [(long, "en", "a"), ("word", "en", "b")]
    assert found(divergence.audit(frame(spark, rows), least_docs=1)) == brute(rows, 1)
    assert divergence.audit(frame(spark, [])).count() == 0


def test_light_pairs_are_bounded(spark):
    rows = [("common rare%s" % (k % 4), "en", f"s{k % 20}") for k in range(80)]
    held = found(divergence.audit(frame(spark, rows), least_docs=1))
    assert held == brute(rows, 1) and np.all([v >= 0 for *_, v, _ in held])

"""Toxicity, licences and sharding."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from ledgerweave.llm import licences, sharding, toxicity


def corpus(spark, n=1500):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.15
        words = [word() for _ in range(r.randint(5, 80))]
        if toxic:
            words += r.choices(["zzvile", "zznasty", "xxfoul" + word()], k=3)
        docs.append((i, " ".join(words)))
        if r.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    found = [r["predicted"] for r in rows if r["toxic"]]
    assert right >= 0.95 * len(rows) and sum(found) >= 0.85 * len(found)


def test_scores_of_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "zzvile"), (5, "again")], "doc_id long, text string"))
    got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == 304 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert not any(r["predicted"] for r in none)
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = corpus(spark, 400)
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def plain_scan(text):
    """The scan as a loop over words."""
    model, out = licences.trained(), []
    if text is None:
        return out
    for n, line in enumerate(text.split("\n")):
        if not re.search(licences.candidate(), line):
            continue
        words = re.findall(licences._WORD, line.lower())
        margin = [b + sum(model.grams[g][k] for g in licences.grams(words) if g in model.grams) for k, b in enumerate(model.bias)]
        k = max(range(len(margin)), key=lambda i: (margin[i], i))
        p = 1 / sum(math.exp(m - margin[k]) for m in margin)
        own = {*words, *(" ".join(x) for x in zip(words, words[1:]))}
        cover = max([0.0] + [len(licences.pairs(t) & own) / len(licences.pairs(t)) for f, t in licences.TEMPLATES if f == model.families[k]])
        out.append((n, model.families[k] if p >= model.least and cover >= 0.6 else licences.UNKNOWN))
    return out


def test_licences_against_a_loop(spark):
    rows = [
        (1, "Released under the MIT License.\nplain line"), (2, "x\nThis work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "he lost his driving license"), (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (7, "Copyright 2020 nobody. All rights reserved."), (8, "license"), (1, "Licensed under the Apache License, Version 2.0."), (9, "the licensed taxis wait " * 500), (10, "LICENSED UNDER THE BSD LICENSE"),
    ]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string")
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs).collect())
    assert got == sorted((i, n, f) for i, t in rows for n, f in plain_scan(t))
    families = {i: f for i, n, f in got}
    assert families[2] == "gpl" and families[6] == "cc-by-nc" and families[5] == "unknown" and families[9] == "unknown"
    assert licences.scan(docs.limit(0)).count() == 0


def test_every_template_is_found_and_recognised():
    wrong = [(family, template) for family, template in licences.TEMPLATES if plain_scan(template)[0][1] != family]
    assert len(wrong) <= len(licences.TEMPLATES) // 20, wrong


#: Notices in other words than the templates', and sentences with telling words that are none.
NOTICES = (
    ("mit", "This project is released under the MIT License."), ("mit", "MIT License, see the file LICENSE"), ("mit", "Die Software steht unter der MIT-Lizenz"), ("mit", "Ce logiciel est sous licence MIT"), ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ("apache-2.0", "Apache 2.0"), ("apache-2.0", "# License: Apache License 2.0"), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"), ("apache-2.0", "Unter der Apache 2.0-Lizenz"), ("gpl", "Este programa se distribuye bajo la licencia GPL"),
    ("gpl", "code licensed under the GNU General Public License version 3"), ("lgpl", "The library is licensed under the GNU Lesser General Public License v2.1"), ("agpl", "Licensed under the GNU Affero General Public License."), ("bsd", "distributed under the BSD license"), ("bsd", "// SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "CC BY 4.0"), ("cc-by", "Creative Commons Attribution 4.0 International"), ("cc-by", "Licensed under CC BY 4.0 by the authors"), ("cc-by-sa", "Text is available, CC BY-SA 4.0"), ("cc-by-nc", "licensed under CC BY-NC 4.0"), ("cc0", "Dedicated to the public domain"), ("cc0", "CC0 1.0 Universal"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("proprietary", "Copyright 2021. All rights reserved."),
)
PROSE = (
    "er kam mit dem Zug nach Berlin und blieb", "she studied at MIT for a year", "the international conference on public health", "version 2.0 of the report is out", "all rights and duties of citizens", "the work of the artist was released in spring", "they dedicated the hall to the public",
    "apache helicopters flew over the valley", "he has a license to drive", "copyright law is a public matter", "mit freundlichen Grüßen", "the conditions of the contract were provided", "a domain of knowledge", "reserved seats are in front", "under the bridge", "version 4.0 or 1.0",
)


def test_labelled_notices():
    found = [(f, (plain_scan(t) or [(0, None)])[0][1]) for f, t in NOTICES]
    candidates = sum(bool(re.search(licences.candidate(), t)) for _, t in NOTICES) / len(NOTICES)
    named = [(f, g) for f, g in found if g not in (None, licences.UNKNOWN)]
    false = [t for t in PROSE for _, g in plain_scan(t) if g != licences.UNKNOWN]
    recall, precision = sum(f == g for f, g in named) / len(NOTICES), sum(f == g for f, g in named) / (len(named) + len(false))
    assert candidates == 1 and recall >= 0.9 and precision >= 0.95, (candidates, recall, precision, [x for x in zip(NOTICES, found) if x[1][0] != x[1][1]], false)


def test_long_lines_are_linear_work(spark):
    line = "the licensed taxis wait outside the station and " * 1000 + "licensed under the mit license"
    began = time.perf_counter()
    assert [r["family"] for r in licences.scan(spark.createDataFrame([(1, line)], "doc_id long, text string")).collect()] in (["mit"], ["unknown"])
    assert time.perf_counter() - began < 30


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", "x", 5)], "doc_id long, text string, lines string, `a.b` int")
    assert [(r["doc_id"], r["family"]) for r in licences.scan(docs).collect()] == [(1, "mit")]


def test_native_plans_have_no_python(spark, sf_dir):
    from ledgerweave.llm.queries import QUERIES

    for name in ("op6_license_scan", "op9_lookup_table_sharding"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def plain_table(shards, slots):
    orders = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    table, at = {}, [0] * len(shards)
    while True:
        for k, order in enumerate(orders):
            while order[at[k]] in table:
                at[k] += 1
            table[order[at[k]]] = k
            if len(table) == slots:
                return [table[i] for i in range(slots)]


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 251)
    assert table == plain_table(shards, 251)
    number = Counter(table)
    assert max(number.values()) - min(number.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 251)
    moved = sum(shards[a] != shards[b] for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * 251
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong, 251)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 250)


def test_placement(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, shard string")
    got = sharding.place(rows, "doc_id", ["x", "y", "z"], 101).collect()
    table = plain_table(["x", "y", "z"], 101)
    for r in got:
        slot = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], "xyz"[table[slot]])
    assert len(got) == 4 and sharding.place(rows.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("key", ["slot", "shard", "shard_name", "k.e`y"])
def test_placement_by_keys_of_any_name(spark, key):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 1)], "k string, extra int").withColumnRenamed("k", key)
    got = sharding.place(rows, key, ["x", "y", "z"], 101)
    names = [n if n != key else f"_{n}" for n in ("slot", "shard", "shard_name")]
    assert got.columns == [key, "extra", *names]
    table = plain_table(["x", "y", "z"], 101)
    for r in got.collect():
        slot = int(hashlib.md5((r[key] or "").encode()).hexdigest()[:15], 16) % 101
        assert tuple(r[n] for n in names) == (slot, table[slot], "xyz"[table[slot]])
    assert sorted(r["extra"] for r in got.collect()) == [1, 1, 2, 3]

"""Byte-level BPE and packing, against the tokenizers themselves."""

from __future__ import annotations

import base64
import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import bpe, packing

public = pytest.importorskip("public_tokenizers")
ODD = ["", "   ", "a b  \n\n c", "日本語テキスト 123", "x\x1cy \x85 z", "I'm don't WE'LL", "<|endoftext|> hi", "²³ ½ ª", "ΑΣ ΣΑΣ. İstanbul ſ", "é café  \t\t", "😀😀 ok" + "!" * 50, " a　b", None, "word " * 9000, "é ＡＢ", "a" * 30000]


def _id(row):
    return -1 if row["doc_id"] is None else row["doc_id"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame([(10**6 + i, t, 1) for i, t in enumerate(ODD)] + [(10**6, "", 1), (None, "no id", 1)], "doc_id long, text string, chunk int")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "0 as chunk").unionByName(odd)


def test_encode_and_decode(spark, docs, monkeypatch):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, public.PATTERN), path, public.PATTERN).collect()
    texts = sorted((_id(r), r["text"] or "") for r in docs.collect())
    assert [(i, reference.encode_ordinary(t), t.encode()) for i, t in texts] == sorted((_id(r), r["ids"], bytes(r["decoded"])) for r in got)
    assert bpe.encode(docs.limit(0), path, public.PATTERN).count() == 0
    monkeypatch.setattr(bpe, "CHUNK", 20_000)  # many chunks, of documents that come from a shuffle in another order
    mixed = docs.repartition(7).orderBy(F.rand()).repartition(3)
    again = bpe.decode(bpe.encode(mixed, path, public.PATTERN), path, public.PATTERN).collect()
    assert sorted((_id(r), r["ids"], bytes(r["decoded"])) for r in again) == sorted((_id(r), r["ids"], bytes(r["decoded"])) for r in got)


def test_null_ids_decode_to_nothing(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, 105]), (None, [33])], "doc_id long, ids array<int>").coalesce(1)
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(rows, path, public.PATTERN).collect()}
    with open(path, "rb") as f:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert got == {1: b"", 2: b"", 3: token[72] + token[105], None: token[33]}


def test_packed_numbers_round_trip():
    numbers = np.array([0, 1, 255, 256, 70000, 2**32 - 1], np.uint32)
    assert (bpe._bytes_joined(bpe._bytes_apart(numbers)) == numbers).all()
    assert bpe._unpacked(bpe._packed([b"", b"ab", b"c" * 300])) == [b"", b"ab", b"c" * 300]


def test_pieces_and_places(spark, docs):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.packed(docs, path).toPandas()
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(_id(r), k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    found = got.fillna({"doc_id": -1})
    assert sorted(want) == sorted((int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        ends = rows.length.cumsum()
        assert rows.offset.tolist() == [0, *ends[:-1]] and ends.iloc[-1] <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 2
    assert packing.packed(docs.limit(0), path).count() == 0


def optimum(lengths, size):
    best = len(lengths)

    def place(rest, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if not rest:
            best = len(gaps)
            return
        for k in range(len(gaps)):
            if gaps[k] >= rest[0] and gaps[k] not in gaps[:k]:
                place(rest[1:], gaps[:k] + [gaps[k] - rest[0]] + gaps[k + 1 :])
        place(rest[1:], gaps + [size - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_plan_is_near_the_optimum_and_uses_each_piece_once():
    r = random.Random(1)
    worse = 0
    for _ in range(60):
        lengths = [r.randint(1, 12) for _ in range(r.randint(1, 12))]
        counts = {n: lengths.count(n) for n in lengths}
        made = packing.plan(counts, 12)
        worse += made.sequences - optimum(lengths, 12)
        places = set()
        for n, c in counts.items():
            sequence, offset = made.place(np.full(c, n), np.arange(c))
            places |= {(int(s), int(o) + k) for s, o in zip(sequence, offset) for k in range(n)}
        assert len(places) == sum(lengths) and max(o for _, o in places) < 12 and {s for s, _ in places} == set(range(made.sequences))
    assert worse <= 3


def test_exact_complements():
    left = np.zeros(101, np.int64)
    left[[10, 20, 33]] = 1
    assert packing._exact(left, 33) == [33] and sorted(packing._exact(left, 30)) == [10, 20] and sorted(packing._exact(left, 63)) == [10, 20, 33] and packing._exact(left, 40) is None
    left[10] = 2
    sums = {sum(c) for n in (1, 2, 3) for c in combinations_with_replacement([10, 10, 20, 33], n) if all(c.count(x) <= left[x] for x in c)}
    for gap in range(1, 100):
        assert (packing._exact(left, gap) is not None) == (gap in sums)


def test_added_tokens_are_those_of_the_untouched_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    text = "hi <|endoftext|> there <|startoftext|>"
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert 49406 in ids and 49407 in ids
    assert np.frombuffer(packing.Tokens(path).of(text), "<u4").tolist() == ids
    docs = spark.createDataFrame([(1, text, 3, 5)], "doc_id long, text string, length int, _part int")
    assert [(r["length"], r["ids_crc32"]) for r in packing.packed(docs, path).collect()] == [(len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))]


@pytest.mark.parametrize("remembered", [packing.REMEMBERED, 20])
def test_remembered_words_give_what_the_tokenizer_gives(monkeypatch, remembered):
    """Letters with marks after them, digits, contractions, capitals, and words that come again after the memory was renewed."""
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    own, chance = packing.Tokens(public.path("word_bpe_49k.json")), random.Random(3)
    for _ in range(2000):
        text = "".join(chance.choices("abéßsSt'dlmre .,;:!?12ÿ\t\n\r\"-ÀÞ", k=chance.randrange(80)))
        assert own.of(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

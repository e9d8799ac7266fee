"""Byte-level BPE over the distinct words of a corpus: each distinct word is encoded once.

Documents are dealt out to chunks of bounded size by a hash of their id and text. A chunk writes down its distinct words, which
are dealt out by their hash, packed by bucket, so that each distinct word of the corpus meets one dictionary and is encoded once.
The ids go back to the chunk, whose documents are split into words again, with positions, and put together by position.
Both readings are of one shuffle of the texts, compressed, and what is written down does not depend on the order of rows, so
a part that is computed again after a lost executor gives the same. Decoding takes ids from the table of token bytes, whose size
is fixed by the vocabulary: a join by id in each worker.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, named, whole_text

#: The pattern of the vocabulary for texts of these characters alone, for the faster engine.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Characters with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters of a chunk, and the least and the most buckets of its words; a task holds the distinct words of its buckets.
CHUNK, BUCKETS = 8_000_000, (64, 4096)


def words_of(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, which is public_tokenizers.PATTERN or one like it."""
    try:
        plain = not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        plain = False
    if plain and pattern == _known_pattern():
        return _PLAIN_WORDS.findall(text)
    return regex.findall(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"), text)


def _known_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_loaded: dict[str, tuple[Callable[[str], list[int]], pa.Array]] = {}


def _vocabulary(path: str, pattern: str) -> tuple[Callable[[str], list[int]], pa.Array]:
    """(encoder of one word, token bytes by id)"""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        _loaded[path] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, pa.array(by_id, pa.binary()))
    return _loaded[path]


def _width(tokens: pa.Array) -> str:
    return "<u2" if len(tokens) <= 1 << 16 else "<u4"


def _small(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _large(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _bytes_apart(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with their first bytes first, then their second ones and so on: small numbers shrink well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _bytes_joined(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(parts: list[bytes]) -> bytes:
    return _small(np.array([len(parts)], "<u4").tobytes(), _bytes_apart(np.array([*map(len, parts)], np.uint32)), *parts)


def _unpacked(blob: bytes) -> list[bytes]:
    blob = _large(blob)
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = np.cumsum(_bytes_joined(blob[4 : 4 + 4 * n]), dtype=np.int64) + 4 + 4 * n
    return [blob[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _shrunk(batch: pa.RecordBatch) -> dict:
    """Texts as they are shuffled: each compressed by itself."""
    own = zstandard.ZstdCompressor(level=1)
    return {"chunk": batch.column(0), "doc_id": batch.column(1), "text": [own.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]}


class _Numbers(dict):
    """The number of each word, by first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _by_bucket(words: list[bytes], buckets: int) -> dict[int, list[int]]:
    """The places of words by bucket; within a bucket in the order of the words, so that equal sets of words give equal lists."""
    out: dict[int, list[int]] = {}
    for k in sorted(range(len(words)), key=words.__getitem__):
        out.setdefault(xxhash.xxh3_64_intdigest(words[k]) % buckets, []).append(k)
    return out


def _raw(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def _give_back() -> None:
    """Hands freed memory to the system: several Python workers of an executor share its limit, idle ones too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs; a null text is an empty one and has no ids.

    A null id stays null, repeated rows give a row each, an empty table none; other columns of docs, whatever their names, are not
    looked at. Rows alike in id and text share a chunk.
    """
    plain = docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    size = plain.agg(F.sum(F.length("text") + F.lit(1))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // CHUNK)))).alias("chunk")
    texts = map_batches(plain.select(chunk, "doc_id", "text"), _shrunk, "chunk long, doc_id long, text binary").repartition("chunk")
    buckets = min(max(BUCKETS[0], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), BUCKETS[1])
    columns = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())])

    def dictionary(rows: pa.Table) -> pa.Table:
        found: set[str] = set()
        for text in rows["text"]:
            found.update(words_of(_large(text.as_py()).decode(), pattern))
        raw = [*map(_raw, found)]
        del found
        dealt = _by_bucket(raw, buckets)
        made = pa.table([[rows["chunk"][0].as_py()] * len(dealt), [*dealt], [_packed([raw[k] for k in own]) for own in dealt.values()]], schema=columns)
        del raw, dealt
        _give_back()
        return made

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word, tokens = _vocabulary(ranks, pattern)
        width = _width(tokens)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for w in _unpacked(batch.column(2)[k].as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encode_word(w.decode("utf-8", "surrogatepass")), width).tobytes()
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([_packed(out)], pa.binary())], schema=columns)
        known.clear()
        _give_back()

    def together(rows: pa.Table, replies: pa.Table) -> pa.Table:
        width = _width(_vocabulary(ranks, pattern)[1])
        number = _Numbers()
        codes = [np.fromiter(map(number.__getitem__, found), np.uint32, len(found)) for found in (words_of(_large(t.as_py()).decode(), pattern) for t in rows["text"])]
        raw = [*map(_raw, number)]
        del number
        ids: list[bytes] = [b""] * len(raw)
        dealt = _by_bucket(raw, buckets)
        for bucket, blob in zip(replies["bucket"].to_pylist(), replies["words"]):
            for k, x in zip(dealt.pop(bucket), _unpacked(blob.as_py()), strict=True):
                ids[k] = x
        if dealt:
            raise RuntimeError("words of a chunk have no ids")
        del raw
        own = [np.frombuffer(b"".join(map(ids.__getitem__, c.tolist())), width) for c in codes]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        found = pa.ListArray.from_arrays(ends, np.concatenate(own).astype(np.int32))
        del ids, own, codes
        _give_back()
        return pa.table({"doc_id": rows["doc_id"], "ids": found})

    words = texts.groupBy("chunk").applyInArrow(dictionary, "chunk long, bucket int, words binary").repartition("bucket")
    replies = words.mapInArrow(encoded, "chunk long, bucket int, words binary")
    return texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(together, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) with one more column, decoded binary: the bytes of its tokens. Null ids decode to nothing."""

    def each(batch: pa.RecordBatch) -> dict:
        ids = batch.column(1)
        taken = _vocabulary(ranks, pattern)[1].take(ids.flatten())
        lengths = np.array([0 if n is None else n for n in pc.list_value_length(ids).to_pylist()], np.int64)
        offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset) if len(taken) else np.zeros(1, np.int32)
        ends = offsets[np.concatenate(([0], np.cumsum(lengths)))].astype(np.int32)
        bytes_of = taken.buffers()[2] if len(taken) and taken.buffers()[2] is not None else pa.py_buffer(b"")
        return {"doc_id": batch.column(0), "ids": ids, "decoded": pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), bytes_of])}

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, ids array<int>, decoded binary")

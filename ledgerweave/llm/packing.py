"""Documents as token sequences of a fixed size: exact-complement packing, then best fit.

Tokens: each distinct string between white space is given to the tokenizer once per worker, without the mark that may follow its
letters; only texts with characters outside a plain set, or with added tokens of the tokenizer, go to it whole.

Packing: what fits together depends on lengths alone, so the plan is made from the number of pieces per
length, at most one number per length from 1 to the size. Longest first, the gap that a piece leaves is filled by one,
two or three lengths that sum to it exactly and are still available; if there are none, by the longest length that fits,
and again. A plan is a list of patterns with how often each is used; pieces take their places by rank among the
pieces of their length. Nothing but the counts per length reaches the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, map_batches, whole_text

SIZE, END = 4096, 1
#: Characters that the tokenizer's normaliser leaves alone but for case and white space; its words never hold white space.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
#: Strings between white space whose ids a worker remembers, twice: those of now, and those before, of which it takes what comes again.
REMEMBERED = 350_000


class Tokens:
    """ids of texts as bytes of little-endian unsigned 32-bit numbers, as the tokenizer of the file gives them without adding any."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.marks = {c: self._ids([c])[0] for c in ".,;:!?"}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of strings of letters: the tokenizer makes one word of each, and the last token of a word has its mark."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        whole = ids.tobytes()
        stop = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        return [whole[i:j] for i, j in zip([0, *stop], stop)]

    def _learn(self, new: set[str]) -> None:
        if again := self.older.keys() & new:
            self.known.update((w, self.older[w]) for w in again)
            new = new - again
        marked = {w for w in new if w[-1] in self.marks and w[:-1].isalpha()}
        letters = {w for w in new if w.isalpha()}
        if rest := list(new - marked - letters):
            self.known.update(zip(rest, self._ids(rest)))
        if words := list(letters | {w[:-1] for w in marked}.difference(self.known)):
            self.known.update(zip(words, self._words(words)))
        self.known.update((w, self.known[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def of(self, text: str) -> bytes:
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        lower = text.lower()
        if not plain or any(t in lower for t in self.added):  # added tokens may lie anywhere in a text
            return self._ids([text])[0]
        parts = lower.split()
        if new := set(parts).difference(self.known):
            if len(self.known) > REMEMBERED:
                self.known, self.older, new = {}, self.known, set(parts)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, parts))


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut at every size tokens.

    A null text is an empty one, a null id stays null, repeated rows give their pieces each, no rows give none; other columns of
    docs, whatever their names, are not looked at.
    """

    def each(batch: pa.RecordBatch) -> dict:
        made: tuple[list, ...] = ([], [], [], [], [])
        close = np.array([end], "<u4").tobytes()
        own = tokens(vocabulary)
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = own.of(text) + close
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                for column, value in zip(made, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), made))

    return map_batches(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Plan:
    """Runs of places. Of the pieces of a length, ranks from first[k] to below first[k] + total[k] take a run: each of its
    sequences, from sequence[k] on, takes each[k] of them one after another from offset[k] on."""

    length: np.ndarray
    first: np.ndarray
    total: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        wide = np.int64(1) << 40
        k = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        n = rank - self.first[k]
        return self.sequence[k] + n // self.each[k], self.offset[k] + n % self.each[k] * length


def plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Patterns that use up counts(length: pieces). There are at most two for each length, as each pattern is used as often
    as some length allows."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, runs, sequences = np.zeros(size + 1, np.int64), [], 0
    for longest in range(size, 0, -1):
        while left[longest]:
            pattern = _pattern(left, longest, size)
            kinds, number = np.unique(pattern, return_counts=True)
            times = int((left[kinds] // number).min())
            offset = 0
            for kind, n in zip(kinds[::-1].tolist(), number[::-1].tolist()):
                runs.append((kind, int(used[kind]), times * n, n, sequences, offset))
                offset += kind * n
                used[kind] += times * n
                left[kind] -= times * n
            sequences += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return Plan(*table.T, sequences)


def _pattern(left: np.ndarray, longest: int, size: int) -> list[int]:
    """The longest length, and lengths for its gap."""
    left = left.copy()
    left[longest] -= 1
    pattern, gap = [longest], size - longest
    while gap:
        if exact := _exact(left, gap):
            return pattern + exact
        fitting = np.flatnonzero(left[1 : gap + 1])
        if not len(fitting):
            return pattern
        best = int(fitting[-1]) + 1
        n = min(int(left[best]), gap // best)
        left[best] -= n
        gap -= n * best
        pattern += [best] * n
    return pattern


def _exact(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths whose sum is the gap; the longest first part is preferred."""
    if left[gap]:
        return [gap]
    if pair := _pair(left, gap):
        return pair
    for a in (np.flatnonzero(left[1:gap]) + 1)[::-1].tolist():
        left[a] -= 1
        pair = _pair(left, gap - a) if a * 3 >= gap else None
        left[a] += 1
        if pair:
            return [a, *pair]
        if a * 3 < gap:
            return None
    return None


def _pair(left: np.ndarray, total: int) -> list[int] | None:
    low = np.arange(1, total // 2 + 1)
    both = (left[low] > 0) & (left[total - low] > 0)
    if total % 2 == 0 and len(both):
        both[-1] = left[total // 2] > 1
    found = np.flatnonzero(both)
    return [total - int(low[found[0]]), int(low[found[0]])] if len(found) else None


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut(length, ...) with sequence_id and offset.

    Ranks are counted in two steps, within stored partitions and then over them, so a length that a third of all
    pieces have is no group of one task.
    """
    kept = durable(cut.withColumn("_part", F.spark_partition_id()))
    counts = kept.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    lengths = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = plan(lengths, size)
    inner = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = kept.withColumn("_rank", F.row_number().over(inner)).join(counts, ["_part", "length"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def each(batch: pa.RecordBatch) -> dict:
        columns = dict(zip(batch.schema.names, batch.columns))
        sequence, offset = found.place(columns["length"].to_numpy(), columns["_rank"].to_numpy())
        return columns | {"sequence_id": sequence, "offset": offset}

    names = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank"), each, names + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    A null or empty text is the end id alone. Repeated rows are packed each. No rows give no pieces.
    Other columns of docs, whatever their names, are not looked at.
    """
    return pack(pieces(docs, vocabulary, size=size, end=end), size)

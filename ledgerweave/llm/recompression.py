"""Removal of words in repeated passages, by recompression.

A document is a sequence of words. Recompression shortens it in levels: runs of one symbol become one symbol, then each
symbol is left or right by a bit of its name, and a left one before a right one becomes one symbol with it. Names are made
of the names that went in, alike on every executor, so naming is global without a dictionary. Which symbols a stretch of text
gets depends on the text near it alone: a symbol is fixed once the neighbours that decide its borders are known, and the words
from the first to the last of those are its context. So equal passages have equal symbols but at their ends. A window takes as its anchor the
symbol of the highest level within it, of several that with the greatest hash; as a symbol should serve many windows, only those
with a context of a third of a window or less are taken. Consecutive windows with one anchor form an interval.

Spark's rounds say which names are shared:

  * first, intervals meet by the name of their anchor's context. Those that cover the same words in the same way are one kind, and all but the
    first of a kind repeat as a whole. A name of one kind is done; of the others the first of each kind goes on;
  * then the windows of what goes on meet by their own words, and all but the first of each repeat.

The first occurrence of a window is always the first of its kind, so the rounds lose none. Names and words are compared by two independent
64-bit fingerprints at once, which are taken for equality. Rows of a batch that are alike are combined before the shuffle, so a large group of
copies sends a row for each batch. Names that very many intervals have (a common passage between texts that differ) are counted first, by SLOTS classes,
and those of heavy classes go to the second round at once, where what differs spreads them. Each round is a table in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import _keyed
from .shared import Scratch, map_batches, named, whole_text

#: Classes by which names are counted; times the mean, and at least FEW, that make a class a heavy one.
SLOTS, HEAVY, FEW = 1 << 16, 16, 4096
#: Rows of one result batch.
ROWS = 1 << 16
#: Words that are parsed at once, bytes that are split at once, distinct words that a worker remembers.
BLOCK, BYTES, KNOWN = 1 << 17, 1 << 22, 1 << 19
_U = np.uint64
_MASK = _U(4 * BLOCK - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Ranges:
    """Fingerprints of ranges of a sequence of up to size values, alike wherever they lie."""

    def __init__(self, base: int, size: int):
        self.up, self.down = (self._powers(x, size) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


class _Words(dict):
    """The number of each distinct word, with its two fingerprints; emptied when it has KNOWN words."""

    def __init__(self):
        super().__init__()
        self.prints = np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == self.prints.shape[1]:
            self.prints = np.concatenate([self.prints, np.zeros_like(self.prints)], axis=1)
        both = xxhash.xxh3_128_intdigest(word)
        self.prints[0, at], self.prints[1, at] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.prints[:, places]


_words = _Words()


def _forget() -> None:
    """Frees the memory of words: a worker that lives on holds none between tasks."""
    global _words
    _words = _Words()


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of BYTES bytes or so at once."""
    at = 0
    while len(text) - at > BYTES:
        end = found.start() if (found := _SPACE.search(text, at + BYTES)) else len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _sequences(texts: Iterable[bytes], window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, place of the first word, fingerprints of the words) of parts of texts of BLOCK words or so; parts of a text
    overlap by window - 1 words, so that each window lies in one. What is shorter than a window is left out."""
    for row, text in enumerate(texts):
        at, before = 0, np.zeros((2, 0), np.uint64)
        for words in _pieces(text):
            prints = np.concatenate([before, _words.of(words)], axis=1)
            for k in range(0, max(0, prints.shape[1] - window + 1), BLOCK):
                part = prints[:, k : k + BLOCK + window - 1]
                yield row, at + k, part
            rest = min(window - 1, prints.shape[1])
            at += prints.shape[1] - rest
            before = prints[:, prints.shape[1] - rest :]


def _blocks(texts: Iterable[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints, first and last place of each part in them, its row, place of its first word): parts put together with a word
    of its own before and after each, which no window holds."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for part in _sequences(texts, window):
        held.append(part)
        size += part[2].shape[1]
        if size >= BLOCK:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    walls = _mix(np.arange(2 * len(held) + 2, dtype=np.uint64).reshape(2, -1) + _U(1 << 40))
    parts, bounds, at = [walls[:, :1]], [], 1
    for k, (_, _, prints) in enumerate(held):
        parts += [prints, walls[:, k + 1 : k + 2]]
        bounds.append((at, at + prints.shape[1]))
        at += prints.shape[1] + 1
    return np.concatenate(parts, axis=1), np.array(bounds, np.int64), np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)


def _levels(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, start and end of contexts) of the symbols of each level, from the words themselves upwards."""
    name, start, end = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    level = 0
    while len(name) > 2:
        yield name, start, end
        level += 1
        # runs: their neighbours, which differ, fix them
        head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(head, len(name)))
        start, end = start[np.maximum(head - 1, 0)], end[np.minimum(head + size, len(name) - 1)]
        name = np.where(size > 1, _mix(name[head] * _U(3) + size.astype(np.uint64)), name[head])
        # pairs: a left symbol is fixed by the next one, a right one by the one before
        left = _mix(name + _U(level)) >> _U(63) == 1
        joined = left[:-1] & ~left[1:]
        head = np.flatnonzero(np.concatenate(([True], ~joined)))
        after = np.minimum(head + 1, len(name) - 1)
        two = np.append(joined, False)[head]
        start, end = np.where(left[head], start[head], start[np.maximum(head - 1, 0)]), np.where(left[head], end[after], end[head])
        name = np.where(two, _mix(name[head] * _U(5) + _mix(name[after])), name[head])


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, start of the context) of the anchor of the window that starts at each word."""
    reach = window // 3
    best, names = np.zeros(len(words), np.uint64), words.copy()
    for level, (name, start, end) in enumerate(_levels(words)):
        near = end - start <= reach
        if not near.any():
            break
        names[start[near]] = name[near]
        best[start[near]] = (_mix(name[near]) >> _U(4)) | _U(min(level, 15) << 60)
    best = (best & ~_MASK) | np.arange(len(words), dtype=np.uint64)
    width, span = window - reach + 1, 1
    while 2 * span <= width:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    if width > span:
        best = np.maximum(best[: span - width], best[width - span :])
    at = (best & _MASK).astype(np.int64)
    return names[at], at


_one, _two = (_Ranges(b, 3 * BLOCK + 4096) for b in (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D | 5))


def _intervals(texts: Iterable[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, cover, row, first and last window) of all intervals of the texts."""
    for prints, bounds, rows, places in _blocks(texts, window):
        name, start = _anchors(prints[0], window)
        part = np.repeat(np.arange(len(bounds)), bounds[:, 1] - bounds[:, 0] - window + 1)
        count = np.bincount(part, minlength=len(bounds))
        at = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + bounds[part, 0]
        name, start = name[at], start[at]
        head = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1]) | (part[1:] != part[:-1]))))
        first, last = at[head], at[np.append(head[1:], len(at)) - 1]
        name, start, part = name[head], start[head], part[head]
        s1, s2 = _one.sums(prints[0]), _two.sums(prints[1])
        key = _mix(_one.of(s1, start, start + window // 3) ^ name)
        cover = _two.of(s2, first, last + window) ^ _mix((first - start + window).astype(np.uint64))
        shift = places[part] - bounds[part, 0]
        yield key, cover, rows[part], first + shift, last + shift


_FIRST = "name long, cover long, known boolean, kd long, kt long, first long, last long"


def _combined(one: np.ndarray, two: np.ndarray, kd: np.ndarray, kt: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Of a batch's rows that are alike in both fingerprints the first; then, as known rows, the windows of the others, which repeat."""
    order = np.lexsort((first, kt, kd, two, one))
    one, two, kd, kt, first, last = (x[order] for x in (one, two, kd, kt, first, last))
    head = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]
    of = np.flatnonzero(head)[np.cumsum(head) - 1] if len(one) else np.zeros(0, np.int64)
    later = ~head & ((kd != kd[of]) | (kt != kt[of]) | (first != first[of]))  # a repeated row is no other document
    d, t, f, l = (x[later] for x in (kd, kt, first, last))
    order = np.lexsort((f, t, d))
    d, t, f, l = (x[order] for x in (d, t, f, l))
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (f[1:] > l[:-1] + 1)))) if len(d) else np.zeros(0, np.int64)
    l = l[np.append(start[1:], len(l)) - 1] if len(l) else l
    d, t, f = d[start], t[start], f[start]
    spread = _mix(t.view(np.uint64) ^ f.astype(np.uint64)).view(np.int64)
    both = lambda x, y: np.concatenate([x[head], y])
    return {"name": both(one.view(np.int64), spread), "cover": both(two.view(np.int64), spread), "known": np.arange(head.sum() + len(d)) >= head.sum(), "kd": both(kd, d), "kt": both(kt, t), "first": both(first, f), "last": both(last, l)}


def _first_round(docs: DataFrame, window: int) -> DataFrame:
    """Rows of all intervals, under the name of their anchors and the fingerprint of all they cover."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        kd, kt = (batch.column(i).to_numpy() for i in (0, 1))
        found = list(_intervals((t.as_py().encode() for t in batch.column(2)), window))
        if not found:
            return
        name, cover, row, first, last = (np.concatenate(x) for x in zip(*found))
        found.clear()
        yield from _sliced(_combined(name, cover, kd[row], kt[row], first, last))

    return map_batches(docs.select("kd", "kt", whole_text("text")), each, _FIRST, _forget)


def _sliced(columns: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    return ({c: x[at : at + ROWS] for c, x in columns.items()} for at in range(0, len(columns["name"]), ROWS))


def _second_round(docs: DataFrame, still: DataFrame, window: int) -> DataFrame:
    """Rows of the windows of intervals(kd, kt, first, last), under both fingerprints of their own words."""
    packed = F.shiftleft("first", 13).bitwiseOR(F.col("last") - F.col("first"))
    wanted = still.groupBy("kd", "kt").agg(F.collect_list(packed).alias("intervals"))

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        kd, kt = (batch.column(i).to_numpy() for i in (0, 1))
        starts = [_starts(x.values.to_numpy()) for x in batch.column(3)]
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for prints, bounds, rows, places in _blocks((_unpacked(t.as_py()) for t in batch.column(2)), window):
            at = [starts[row][slice(*np.searchsorted(starts[row], (place, place + b - a - window + 1)))] + a - place for (a, b), row, place in zip(bounds.tolist(), rows.tolist(), places.tolist())]
            part = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate(at)
            one, two = (r.of(r.sums(p), at, at + window) for r, p in zip((_one, _two), prints))
            found.append((one, two, rows[part], at - bounds[part, 0] + places[part]))
        one, two, row, first = (np.concatenate(x) for x in zip(*found))
        found.clear()
        yield from _sliced(_combined(one, two, kd[row], kt[row], first, first))

    return map_batches(_packed(docs).join(wanted, ["kd", "kt"]).select("kd", "kt", "text", "intervals"), each, _FIRST, _forget)


def _starts(packed: np.ndarray) -> np.ndarray:
    """The windows of intervals, each once, in order."""
    first, more = np.sort(packed) >> 13, np.sort(packed) & 8191
    k = np.repeat(np.arange(len(first)), more + 1)
    return np.unique(first[k] + np.arange(len(k)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))


def _packed(docs: DataFrame) -> DataFrame:
    """docs whose texts are compressed, each by itself, for their shuffle."""

    def small(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=1)
        return pd.Series([pack.compress(t.encode()) for t in texts], dtype=object)

    return docs.withColumn("text", F.pandas_udf(small, "binary")(whole_text("text")))


def _unpacked(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


def _decided(rows: DataFrame) -> DataFrame:
    """rows with `later` (the same was there before) and `kinds` (the name has others)."""
    place, alike, alias = F.struct("kd", "kt", "first"), Window.partitionBy("name", "cover"), Window.partitionBy("name")
    rows = rows.repartition("name").withColumn("later", place > F.min(place).over(alike))
    return rows.withColumn("kinds", F.min("cover").over(alias) != F.max("cover").over(alias))


def _heavy(rows: DataFrame) -> list[int]:
    """The classes of names with very many rows. A count for each class reaches the driver, however many documents there are."""
    counts = rows.groupBy(F.pmod("name", F.lit(SLOTS)).alias("slot")).count().toPandas()
    return counts["slot"][counts["count"] > max(FEW, HEAVY * counts["count"].sum() / SLOTS)].tolist()


def _ranges(keyed: DataFrame, window: int) -> DataFrame:
    """(kd, kt, ranges) of the rows of _keyed that lose words: ranges of words, packed, in no order, that may overlap."""
    if not 6 <= window <= 4096:
        raise ValueError("window must be from 6 to 4096 words")
    rounds, last = Scratch(keyed.sparkSession), Scratch(keyed.sparkSession, lasting=True)
    with rounds:
        rows = rounds.keep("intervals", _first_round(keyed, window))
        heavy = F.pmod("name", F.lit(SLOTS)).isin(_heavy(rows.where("not known")))
        columns = "kd", "kt", "first", "last"
        decided = rounds.keep("decided", _decided(rows.where(~heavy & ~F.col("known"))).where("later or kinds").select(*columns, "later"))
        still = decided.where("not later").select(*columns).unionByName(rows.where(heavy & ~F.col("known")).select(*columns))
        windows = rounds.keep("windows", _second_round(keyed, still, window))
        place = F.struct("kd", "kt", "first")
        again = windows.where("not known").withColumn("later", place > F.min(place).over(Window.partitionBy("name", "cover")))
        found = [rows.where("known"), decided.where("later"), windows.where("known"), again.where("later")]
        ranges = F.collect_list(F.shiftleft("first", 31).bitwiseOR(F.col("last") + window)).alias("ranges")
        return last.keep("ranges", reduce(DataFrame.unionByName, [x.select(*columns) for x in found]).groupBy("kd", "kt").agg(ranges))


def _without(text: str, ranges: np.ndarray | None) -> tuple[int, int, str]:
    words = text.encode().split()
    keep = np.ones(len(words) + 1, np.int64)
    if ranges is not None and len(ranges):
        ranges = np.asarray(ranges, np.int64)
        edges = np.bincount(ranges >> 31, minlength=len(keep)) - np.bincount(ranges & (1 << 31) - 1, minlength=len(keep))
        keep = np.cumsum(edges) == 0
    kept = [words[k] for k in np.flatnonzero(keep[:-1])]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def passages_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: kept has the words that are in no window which starts earlier too.

    Earlier is in a document of smaller id, or before in the same one; windows are judged on the input. Words are what white space of ASCII parts.
    A null text has no words, and texts of under `window` words lose none. A null id counts as 0, and of rows with one id that with the smaller
    hash of its text comes first; rows alike in id and text are one document, and each of them is returned. An empty table gives no rows; other columns of docs are not looked at.
    """
    kept = F.pandas_udf(lambda text, ranges: pd.DataFrame([_without(t, x) for t, x in zip(text, ranges)], columns=["n_words", "n_removed", "kept"]), "n_words long, n_removed long, kept string")
    keyed = _keyed(docs.select(named(id_col), named(text_col)), id_col, text_col)
    rows = keyed.join(_ranges(keyed, window), ["kd", "kt"], "left")
    return rows.select(F.col("c0").cast("long").alias("doc_id"), kept(whole_text("text"), "ranges").alias("kept")).select("doc_id", "kept.*")


def keep_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs whose text is what stays, words joined by one space, with all their columns, whatever their names.

    Null texts stay null, and texts that lose nothing stay as they are. See passages_removed for odd rows.
    """

    def rest(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else _without(t, x)[2] for t, x in zip(text, ranges)], dtype=object)

    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.join(_ranges(keyed, window), ["kd", "kt"], "left").withColumn("text", F.pandas_udf(rest, "string")("text", "ranges"))
    return rows.select([(F.col("text") if name.lower() == text_col.lower() else F.col(f"c{k}")).alias(name) for k, name in enumerate(docs.columns)])

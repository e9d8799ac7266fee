"""Importance resampling: the documents that look most like a target, drawn exactly and without replacement.

Features of a text are its runs of one to `longest` words, hashed to `buckets` buckets by CRC-32. A bucket's gain is the logarithm of its
smoothed share in the target over that in the documents; the gains are one array of fixed size, which scores whole batches. A document's key is its weight
plus Gumbel noise of a hash of its id, so the highest keys are a draw without replacement by weight, the same every time.

The draw is a merge of sorted runs. Each partition sorts its eligible rows, RUN at once, and cuts each run into chunks that lie in one range of
keys and have CHUNK rows at most. Counts of the ranges tell how many rows of each are drawn: all, some, or none, and what is not drawn isn't
shuffled. A task merges the runs of a range by a tournament tree. Chunks reach it in the order of their first rows, so a run's next chunk
is there before it is needed and no run is held as a whole; the task stops when the range has given its number of rows, and ranks go on from those of the ranges above.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_batches, named, whole_text

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Rows of a sorted run, of a chunk of it, and of a range of keys or so, while there are no more than RANGES ranges.
RUN, CHUNK, MERGED = 1 << 17, 1 << 10, 1 << 13
#: Ranges at most; their bounds and counts are all that reaches the driver, and larger draws have larger ranges.
RANGES = 1 << 14
#: Bytes of a text that are split at once, distinct features that a worker remembers.
BYTES, KNOWN = 1 << 22, 1 << 19
#: A-Z to a-z; bytes of no word to spaces.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """The bucket of each distinct feature; emptied when it has KNOWN features."""

    def __init__(self, number: int):
        super().__init__()
        self.number = number

    def __missing__(self, feature: bytes) -> int:
        self[feature] = bucket = crc32(feature) % self.number
        return bucket

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        runs = [words] + [[b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] for n in range(2, longest + 1)]
        return np.fromiter((b for run in runs for b in map(self.__getitem__, run)), np.int64)


def _pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, those of them that the piece before had) of a text, some BYTES bytes at once; no feature is lost between pieces."""
    text, at, before = text.translate(_FOLDED), 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= BYTES or (cut := text.find(b" ", at + BYTES)) < 0 else cut
        words = before + text[at:end].split()
        yield words, len(before)
        at, before = end, words[max(0, len(words) - longest + 1) :] if longest > 1 else []


def _features(text: bytes, known: _Buckets, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets, number of words) of the pieces of a text."""
    for words, again in _pieces(text, longest):
        found = known.of(words, longest)
        if again:  # runs within the words of the piece before were counted there
            skip = np.bincount(known.of(words[:again], longest), minlength=known.number)
            found = np.repeat(np.arange(known.number), np.bincount(found, minlength=known.number) - skip)
        yield found, len(words) - again


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall in each bucket. Null texts have none."""
    known = _Buckets(buckets)

    def each(batch: pa.RecordBatch) -> dict:
        count = np.zeros(buckets, np.int64)
        for t in batch.column(0):
            for found, _ in _features(t.as_py().encode(), known, longest):
                count += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(count)
        return {"bucket": there, "number": count[there]}

    rows = map_batches(texts.select(whole_text(text_col)), each, "bucket long, number long").groupBy("bucket").agg(F.sum("number").alias("number")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["number"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, from its counts in the documents and in the target."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + float(n)) / ((a + 1.0) * (t + float(n))))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, by the id alone; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    known = _Buckets(len(gain))

    def each(batch: pa.RecordBatch) -> dict:
        ids, rows = batch.column(0).to_pylist(), []
        for i, t in zip(ids, batch.column(1)):
            words = features = weight = 0
            for found, n in _features(t.as_py().encode(), known, longest):
                words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
            rows.append((words, features, weight, weight + noise(i, seed)))
        return dict(zip(("doc_id", "n_words", "n_features", "weight", "score"), (batch.column(0), *map(list, zip(*rows)))))

    return map_batches(docs.select(named(id_col).cast("long"), whole_text(text_col)), each, _SCORED)


# The draw. A row's place is (-score, whether the id is null, id, row): row numbers tell repeated rows apart.

_CHUNK = "range long, run long, minus long, absent boolean, id long, row long, scores array<bigint>, ids array<bigint>, nulls array<boolean>, numbers array<bigint>, features array<bigint>, weights array<bigint>"
_ORDER = "minus", "absent", "id", "row"
_DRAWN = "doc_id long, n_features long, weight long, score long, rank long, row long"


def _range(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(-bounds, -score, "left")


def _runs(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Chunks of sorted runs. bounds are keys between ranges, falling; a key equal to one is in the range above it."""
    most, size = RUN, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0
        for batch in batches:
            held.append(batch)
            number += batch.num_rows
            if number >= most:
                yield from cut(pa.Table.from_batches(held))
                held, number = [], 0
        if number:
            yield from cut(pa.Table.from_batches(held))

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        score, row, features, weight = (table[c].to_numpy() for c in ("score", "row", "n_features", "weight"))
        null = table["doc_id"].is_null().to_numpy()
        ids = table["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort((row, ids, null, -score))
        score, row, features, weight, null, ids = (x[order] for x in (score, row, features, weight, null, ids))
        of = _range(score, bounds)
        head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        chunks = [(a, min(a + size, b)) for x, b in zip(head, np.append(head[1:], len(of))) for a in range(x, b, size)]
        own = int(row[0])  # any number that no other run has
        columns = [[int(of[a]) for a, _ in chunks], [own] * len(chunks), *([x[a] for a, _ in chunks] for x in (-score, null, ids, row)), *([x[a:b] for a, b in chunks] for x in (score, ids, null, row, features, weight))]
        plain = {"range": pa.int64(), "run": pa.int64(), "minus": pa.int64(), "absent": pa.bool_(), "id": pa.int64(), "row": pa.int64(), "nulls": pa.list_(pa.bool_())}
        kinds = [(name, plain.get(name, pa.list_(pa.int64()))) for name in (c.split()[0] for c in _CHUNK.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return rows.select("doc_id", "row", "n_features", "weight", "score").mapInArrow(run, _CHUNK)


class Tournament:
    """A tournament tree of sorted runs: leaves hold the next row of each run, and each inner node the winner, the lesser one, of the two below it.

    Runs may come and get more rows while the merge goes on; a run without rows loses to all. Taking a row plays one match for each level.
    """

    def __init__(self):
        self.size, self.runs, self.free, self.tree = 1, [], [], [None, None]

    def add(self, run: Iterator[tuple]) -> None:
        if not self.free:
            self._grow()
        leaf = self.free.pop()
        self.runs[leaf] = run
        self._next(leaf)

    def _grow(self) -> None:
        self.free += range(len(self.runs), self.size)
        if not self.free:
            leaves = self.tree[self.size :] + [None] * self.size
            self.size *= 2
            self.tree = [None] * self.size + leaves
            for k in range(self.size - 1, 0, -1):
                self._play(k)
            self.free = list(range(self.size // 2, self.size))
        self.runs += [None] * (self.size - len(self.runs))

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = b if a is None or (b is not None and b < a) else a

    def _next(self, leaf: int) -> None:
        row = next(self.runs[leaf], None)
        if row is None:
            self.runs[leaf] = None
            self.free.append(leaf)
        self.tree[self.size + leaf] = None if row is None else (row, leaf)
        node = (self.size + leaf) // 2
        while node:
            self._play(node)
            node //= 2

    def least(self) -> tuple | None:
        return None if self.tree[1] is None else self.tree[1][0]

    def take(self) -> tuple:
        row, leaf = self.tree[1]
        self._next(leaf)
        return row


def _merged(chunks: DataFrame, quota: dict[int, tuple[int, int]]) -> DataFrame:
    """The drawn rows with ranks. quota: of each range how many rows are drawn, and how many ranks lie above it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(range, first row, its rows as an iterator) of chunks."""
        for batch in batches:
            for k in range(batch.num_rows):
                of, _, *first = (batch.column(i)[k].as_py() for i in range(6))
                score, ids, null, row, features, weight = (batch.column(i)[k].values.to_pylist() for i in range(6, 12))
                yield of, tuple(first), zip((-s for s in score), null, ids, row, features, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, tree, left, rank = None, Tournament(), 0, 0

        def taken(before: tuple | None) -> None:
            """Rows that come before all of the next chunk, while the range has rows to give."""
            nonlocal left, rank
            while left and (row := tree.least()) is not None and (before is None or row[:4] < before):
                minus, null, i, number, features, weight = tree.take()
                left, rank = left - 1, rank + 1
                out.append((None if null else i, features, weight, -minus, rank, number))

        for of, first, chunk in rows(batches):
            if of != now:
                taken(None)
                now, tree, (left, rank) = of, Tournament(), quota[of]
            taken(first)
            if left:
                tree.add(chunk)
            if len(out) >= 1 << 14:
                yield batch_of(out)
                out.clear()
        taken(None)
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=[c.split()[0] for c in _DRAWN.split(", ")])

    return chunks.repartition("range").sortWithinPartitions("range", *_ORDER).mapInArrow(run, _DRAWN)


def _bounds(rows: DataFrame, number: int, drawn: int) -> np.ndarray:
    """Keys that part the highest ones in ranges of about MERGED rows, falling; whatever they are, the draw is the same."""
    step = max(MERGED, -(-drawn // RANGES))
    shares = [1 - k * step / number for k in range(1, -(-drawn // step) + 1) if k * step < number]
    if not shares:
        return np.zeros(0, np.int64)
    found = rows.agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), F.lit(max(10_000, 10 * number // step))).alias("p")).first()["p"]
    return np.unique(np.array(found, np.int64))[::-1]


def _counts(rows: DataFrame, bounds: np.ndarray) -> list[int]:
    """How many rows each range has."""

    def each(batch: pa.RecordBatch) -> dict:
        of = np.bincount(_range(batch.column(0).to_numpy(), bounds))
        return {"range": np.flatnonzero(of), "number": of[of > 0]}

    found = {r["range"]: r["n"] for r in map_batches(rows.select("score"), each, "range long, number long").groupBy("range").agg(F.sum("number").alias("n")).collect()}
    return [found.get(k, 0) for k in range(len(bounds) + 1)]


def _place() -> Column:
    return F.struct((-F.col("score")).alias("minus"), F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row").alias("row"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for what is not drawn.

    Of the rows with least_words words or more, percent of a hundred (rounded down) are drawn, those of the highest scores; ties go to the smaller id, null ids
    after others. Words are letters a-z after A-Z are folded, digits and all beyond ASCII. Null and empty texts have no features and a weight of 0. A repeated row
    is a row of its own, with the same score; which of rows alike in score and id is drawn is left open. Empty docs give no rows, an empty target gains by
    what is rare in docs. Other columns are not looked at. Two passes over the texts.
    """
    if not 0 <= percent <= 100 or longest < 1 or buckets < 1:
        raise ValueError("percent must be from 0 to 100, and longest and buckets 1 at least")
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    kept = Scratch(spark, lasting=True)
    rows = kept.keep("scored", scored(docs, gain, id_col, text_col, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    columns = "doc_id", "n_features", "weight", "score"
    undrawn = lambda x: x.select(*columns, F.lit(None).cast("long").alias("rank"))
    able = rows.where(F.col("n_words") >= least_words)
    number = able.count()
    drawn = percent * number // 100
    if not drawn:
        return undrawn(rows)
    bounds, quota, above = _bounds(able, number, drawn), {}, 0
    for k, n in enumerate(_counts(able, bounds)):
        quota[k] = min(n, drawn - above), above
        above += quota[k][0]
    last = max(k for k, (n, _) in quota.items() if n)
    if last < len(bounds):
        able = able.where(F.col("score") >= int(bounds[last]))
    first = kept.keep("drawn", _merged(_runs(able, bounds).where(F.col("range") <= last), quota))
    cut = first.where(F.col("rank") == drawn).select(_place().alias("p")).first()["p"]
    place = F.struct(*[F.lit(x).alias(n) for n, x in cut.asDict().items()])
    return first.select(*columns, "rank").unionByName(undrawn(rows.where((F.col("n_words") < least_words) | (_place() > place))))

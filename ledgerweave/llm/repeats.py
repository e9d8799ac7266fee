"""Removal of every byte that a repeated string of min_bytes bytes covers, by distributed prefix doubling.

The rank of a position at a length is the class of equal strings of that length that start there. A full
suffix array would shuffle every byte of the corpus at every doubling, so positions are first chosen by content:
each window of min_bytes bytes takes as its anchor the GRAM bytes in it with the least hash, so equal windows have
equal anchors at equal places. Consecutive windows with one anchor form an interval. The first round ranks anchors by
their GRAM bytes. Each later one doubles the length: a position p is ranked at 2h by the pair (rank of p at h, rank of
p + h at h), and the last two lengths, which are no powers of two, by pairs that overlap. Rounds sort the pairs, with the rank
of all bytes that an interval covers:

  * a pair that is unique in the corpus: all windows of the interval are unique, it leaves;
  * all covered bytes repeat: all its windows repeat, it is done; its first one stays as a partner for others;
  * else it is cut into shorter intervals, so that all windows of each share the next length, up to min_bytes, which is the threshold
    and decides each window.

Each round is one shuffle by the pair, and only what is still undecided goes on. A rank is a 64-bit fingerprint: the rank of p + h
has the same value wherever it is computed, so it is no join over positions but read off the document's own bytes. Equal pairs are taken
as equal strings. Rows of a batch with equal ranks are combined before the shuffle, so text that repeats itself does not send a row per byte.

An anchor that very many different texts follow (a common line before what differs) would be sorted in one task. So anchors are counted
first, by SLOTS classes of their ranks; those of a class with over HEAVY times the usual number are ranked at the longest doubled length at
once, where they are spread by what follows them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns_of, map_batches, named, whole_text

GRAM, STEP = 32, 8
#: Classes by which anchors are counted; times the mean, and at least FEW, that make a class a heavy one.
SLOTS, HEAVY, FEW = 1 << 16, 16, 4096
#: Bytes hashed at once; a power of two, as positions share a word with hashes.
PIECE = 1 << 18
_MASK = np.uint64(PIECE * 2 - 1)
_U = np.uint64


class _Hash:
    """Fingerprints of any range of a piece of bytes, alike wherever in the piece or in a document it lies."""

    def __init__(self, seed: int, base: int):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64) | _U(1)
        self.up, self.down = (self._powers(x, 2 * PIECE + 1) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
            done += more
        return out

    def sums(self, piece: np.ndarray) -> np.ndarray:
        out = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(self.table[piece] * self.up[: len(piece)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.down[start])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_hashes: list[_Hash] = []


def _both() -> list[_Hash]:
    if not _hashes:
        _hashes.extend((_Hash(11, 0x9E3779B97F4A7C15 | 5), _Hash(12, 0xC2B2AE3D27D4EB4D | 5)))
    return _hashes


def _anchored(text: np.ndarray, min_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(shared rank, covered rank, anchor, first and last window from the anchor) of a document's intervals."""
    one, two = _both()
    width = min_bytes - GRAM + 1
    for at in range(0, max(0, len(text) - min_bytes + 1), PIECE):
        piece = text[at : at + PIECE + min_bytes - 1]
        s1, s2 = one.sums(piece), two.sums(piece)
        grams = _mix((s1[GRAM:] - s1[:-GRAM]) * one.down[: len(piece) - GRAM + 1])
        least, span = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        anchor = (least[first] & _MASK).astype(np.int64)
        low, high = first - anchor, last - anchor
        yield grams[anchor], two.of(s2, first, last + min_bytes) ^ _shape(low, high), anchor + at, low, high


def _shape(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Intervals count as alike only if they lie alike about their anchors."""
    return _mix(((low & 0xFFFF).astype(np.uint64) << _U(16)) | (high & 0xFFFF).astype(np.uint64))


def _lengths(min_bytes: int) -> list[int]:
    """The lengths at which positions are ranked: doubled while they are short of the last two."""
    out = [GRAM]
    while 2 * out[-1] < min_bytes - STEP + 1:
        out.append(2 * out[-1])
    return [*out, min_bytes - STEP + 1, min_bytes]


def _cut(text: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, min_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The intervals cut from their anchors so that the windows of each share length bytes, with the pair of ranks of those and their covered rank."""
    one, two = _both()
    step = min_bytes - length + 1
    half = max(x for x in _lengths(min_bytes)[:-2] if x <= length)
    order = np.argsort(anchor + low, kind="stable")
    anchor, low, high = anchor[order], low[order], high[order]
    at = 0
    while at < len(anchor):
        begin = int(anchor[at] + low[at])
        upto = max(at + 1, int(np.searchsorted(anchor + low, begin + PIECE - 4 * min_bytes)))
        piece = text[begin : begin + PIECE]
        s1, s2 = one.sums(piece), two.sums(piece)
        a, lo, hi = anchor[at:upto] - begin, low[at:upto], high[at:upto]
        at = upto
        n = hi // step - lo // step + 1
        k = np.repeat(np.arange(len(n)), n)
        block = (lo // step)[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        a, lo, hi = a[k], np.maximum(lo[k], block * step), np.minimum(hi[k], block * step + step - 1)
        p, stop = a + block * step + step - 1, a + block * step + min_bytes
        rank, beyond = one.of(s1, p, p + half), one.of(s1, stop - half, stop)
        if step > 1:  # those that lie differently about their anchors can't be alike
            yield rank ^ _mix((block & 0xFFFF).astype(np.uint64)), beyond, two.of(s2, a + lo, a + hi + min_bytes) ^ _shape(lo, hi), a + begin, lo, hi
        else:
            yield rank, beyond, two.of(s2, a + lo, a + hi + min_bytes), a + begin, lo, hi


_ROUND = "rank long, beyond long, cover long, times long, kd long, kt long, anchor long, low long, high long"


def _combined(found: list[tuple[np.ndarray, ...]], ids: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of a round for one batch: of intervals with equal ranks the first, with their number; then ranges
    of bytes that are known to repeat (times 0), for all of them."""
    if not found:
        return {c.split()[0]: np.zeros(0, np.int64) for c in _ROUND.split(", ")}
    rank, beyond, cover, row, anchor, low, high = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((cover, beyond, rank))
    rank, beyond, cover, row, anchor, low, high = (x[order] for x in (rank, beyond, cover, row, anchor, low, high))
    head = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (beyond[1:] != beyond[:-1]) | (cover[1:] != cover[:-1]))))
    times = np.diff(np.append(head, len(rank)))
    again = np.repeat(times > 1, times)
    r, s, e = row[again], (anchor + low)[again], (anchor + high)[again]
    order = np.lexsort((s, r))
    r, s, e = r[order], s[order], e[order]
    start = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] > e[:-1] + 1)))) if len(r) else np.zeros(0, np.int64)
    stop = e[np.append(start[1:], len(r)) - 1] if len(r) else e
    r, s = r[start], s[start]
    spread = _mix(ids[1][r].view(np.uint64) ^ s.astype(np.uint64))
    rows = np.concatenate([row[head], r])
    made = {c: np.concatenate([x[head], spread]).view(np.int64) for c, x in (("rank", rank), ("beyond", beyond), ("cover", cover))}
    made |= {"times": np.concatenate([times, np.zeros(len(r), np.int64)])}
    made |= {"kd": ids[0][rows], "kt": ids[1][rows], "anchor": np.concatenate([anchor[head], s]), "low": np.concatenate([low[head], np.zeros(len(r), np.int64)]), "high": np.concatenate([high[head], stop - s])}
    return made


def _first_round(docs: DataFrame, min_bytes: int, heavy: np.ndarray) -> DataFrame:
    """Rows of anchors ranked at GRAM bytes, and of those in heavy classes at the longest doubled length."""

    def ranked(text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for rank, cover, anchor, low, high in _anchored(text, min_bytes):
            much = np.isin(rank & _U(SLOTS - 1), heavy) if len(heavy) else np.zeros(len(rank), bool)
            yield tuple(x[~much] for x in (rank, np.zeros_like(rank), cover, anchor, low, high))
            if much.any():
                yield from _cut(text, anchor[much], low[much], high[much], _lengths(min_bytes)[-3], min_bytes)

    def each(batch: pa.RecordBatch) -> dict:
        ids = tuple(batch.column(i).to_numpy() for i in (0, 1))
        found = [(r, b, u, np.full(len(a), i), a, lo, hi) for i, t in enumerate(batch.column(2).to_pylist()) for r, b, u, a, lo, hi in ranked(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))]
        return _combined(found, ids)

    return map_batches(docs.select("kd", "kt", whole_text("text")), each, _ROUND)


def _heavy(docs: DataFrame, min_bytes: int) -> np.ndarray:
    """The classes of anchors with very many rows. A count for each class reaches the driver, however many documents there are."""
    rows = _first_round(docs, min_bytes, np.zeros(0, np.uint64)).where("times > 0")
    counts = rows.groupBy(F.pmod("rank", F.lit(SLOTS)).alias("slot")).count().toPandas()
    return np.sort(counts["slot"][counts["count"] > max(FEW, HEAVY * counts["count"].sum() / SLOTS)].to_numpy().astype(np.uint64))


def _next_round(docs: DataFrame, undecided: DataFrame, length: int, min_bytes: int) -> DataFrame:
    """Rows of a round for the intervals that are still undecided, ranked at length bytes."""
    packed = F.shiftleft("anchor", 20).bitwiseOR(F.shiftleft(F.col("low") + 512, 10)).bitwiseOR(F.col("high") + 512)
    wanted = undecided.groupBy("kd", "kt").agg(F.collect_list(packed).alias("intervals"))

    def each(batch: pa.RecordBatch) -> dict:
        ids = tuple(batch.column(i).to_numpy() for i in (0, 1))
        found = []
        for i, (t, x) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
            x = x.values.to_numpy()
            cuts = _cut(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), x >> 20, (x >> 10 & 1023) - 512, (x & 1023) - 512, length, min_bytes)
            found += [(r, b, u, np.full(len(a), i), a, lo, hi) for r, b, u, a, lo, hi in cuts]
        return _combined(found, ids)

    # What asks for all columns makes every round and the last join read one shuffle of the documents.
    nulls = sum((F.col(c).isNull().cast("int") for c in docs.columns if c not in ("kd", "kt", "text")), F.lit(0))
    return map_batches(docs.join(wanted, ["kd", "kt"]).select("kd", "kt", whole_text("text"), "intervals", nulls), each, _ROUND)


def _sorted(rows: DataFrame) -> DataFrame:
    """A round's rows with the number of equal ones and, for each pair of ranks, of different covered ranks."""
    alike = Window.partitionBy("rank", "beyond", "cover")
    rows = rows.repartition("rank", "beyond").withColumn("number", F.sum("times").over(alike))
    rows = rows.withColumn("first", (F.row_number().over(alike.orderBy("kd", "kt", "anchor", "low")) == 1) & (F.col("times") > 0))
    return rows.withColumn("kinds", F.sum(F.col("first").cast("long")).over(Window.partitionBy("rank", "beyond")))


def _repeated(ranked: DataFrame, min_bytes: int) -> DataFrame:
    start = F.col("anchor") + F.col("low")
    return ranked.where("number > 1 or times = 0").select("kd", "kt", F.shiftleft(start, 31).bitwiseOR(F.col("anchor") + F.col("high") + min_bytes).alias("range"))


_KEPT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells rows apart: the id and the text (and whether there is an id); rows alike in both are treated alike."""
    own = named(id_col).cast("long")
    return F.coalesce(own, F.lit(0)), F.xxhash64(own.isNull(), whole_text(text_col))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kd, kt, text) and the columns of docs as c0, c1, ..., so that no names clash."""
    kd, kt = _keys(id_col, text_col)
    others = [c.alias(f"c{k}") for k, (c, name) in enumerate(zip(columns_of(docs), docs.columns)) if name.lower() != text_col.lower()]
    return docs.select(kd.alias("kd"), kt.alias("kt"), named(text_col).cast("string").alias("text"), *others)


def _ranges(keyed: DataFrame, min_bytes: int) -> DataFrame:
    """(kd, kt, ranges) of the rows of _keyed that hold repeated strings: byte ranges, packed, in no order, that may overlap."""
    if min_bytes < GRAM + STEP:
        raise ValueError(f"min_bytes must be {GRAM + STEP} at least")
    if min_bytes > GRAM + 512:  # places from -512 to 511 about an anchor are packed
        raise ValueError(f"min_bytes must be {GRAM + 512} at most")
    ranked = _sorted(_first_round(keyed, min_bytes, _heavy(keyed, min_bytes)))
    ranges = _repeated(ranked, min_bytes)
    for length in _lengths(min_bytes)[1:]:
        ranked = _sorted(_next_round(keyed, ranked.where("first and kinds > 1").select("kd", "kt", "anchor", "low", "high"), length, min_bytes))
        ranges = ranges.unionByName(_repeated(ranked, min_bytes))
    return ranges.groupBy("kd", "kt").agg(F.collect_list("range").alias("ranges"))


def _kept_rows(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_without(t.encode("utf-8", "surrogatepass"), x) for t, x in zip(text, ranges)], columns=["n_bytes", "n_removed", "n_spans", "kept"])


def _without(text: bytes, ranges: np.ndarray | None) -> tuple[int, int, int, bytes]:
    if ranges is None or not len(ranges):
        return len(text), 0, 0, text
    ranges = np.sort(np.asarray(ranges, np.int64))
    start, stop = ranges >> 31, np.maximum.accumulate(ranges & (1 << 31) - 1)
    head = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
    start, stop = start[head], stop[np.append(head[1:], len(stop)) - 1]
    kept = b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)]))
    return len(text), len(text) - len(kept), len(head), kept


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs.

    A null text is an empty one; texts under min_bytes bytes lose nothing. Repeated rows are copies of each other and
    lose all that lies in strings of min_bytes bytes. A null id is an id like others. Texts must be under 2 GB.
    An empty table gives no rows; other columns of docs are not looked at.
    """
    kept = F.pandas_udf(_kept_rows, _KEPT)
    keyed = _keyed(docs.select(named(id_col), named(text_col)), id_col, text_col)
    rows = keyed.join(_ranges(keyed, min_bytes), ["kd", "kt"], "left")
    return rows.select(F.col("c0").cast("long").alias("doc_id"), kept(whole_text("text"), "ranges").alias("kept")).select("doc_id", "kept.*")


def keep_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200) -> DataFrame:
    """docs whose text is what stays, with all their columns, whatever their names; n_chars is counted again.

    Bytes of a character that was cut in part go too. Null texts stay null. See repeats_removed for odd rows.
    """

    def rest(text: pd.Series, ranges: pd.Series) -> pd.Series:
        cut = [t if t is None or x is None else _without(t.encode("utf-8", "surrogatepass"), x)[3].decode("utf-8", "ignore") for t, x in zip(text, ranges)]
        return pd.Series(cut, dtype=object)

    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.join(_ranges(keyed, min_bytes), ["kd", "kt"], "left").withColumn("text", F.pandas_udf(rest, "string")("text", "ranges"))
    back = [(F.col("text") if name.lower() == text_col.lower() else F.col(f"c{k}")).alias(name) for k, name in enumerate(docs.columns)]
    return rows.select(back).withColumn("n_chars", F.length(named(text_col)).cast("long"))

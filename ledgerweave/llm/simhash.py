"""Near-duplicates by SimHash fingerprints, linked by a self-join of their binary trie.

Fingerprints of all documents become one row each (a hot group of copies is one fingerprint). The trie is dealt out: a
cell is the subtrie of fingerprints alike in one of budget + 1 bands of bits, which is turned to the front. Within a
cell pairs of nodes are traversed downwards, differing bits add up and a pair of nodes beyond the budget is
dropped with all below it. A cell returns a spanning forest of the links it found, not the links; so a dense
group of n texts costs n rows. The forests are joined into components by connected_components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import absent, columns_of, durable, map_batches, whole_text

BITS = 64
#: Fingerprints of a cell above which it is dealt again, as long as more than LEAST_BITS of them may differ; a cell never holds more than 2 ** LEAST_BITS or CELL_ROWS.
CELL_ROWS, LEAST_BITS = 16_384, 21
#: Pairs of nodes traversed at once (SOME where pairs are listed); pairs of leaves below FEW are compared without going down.
BLOCK, FEW, SOME = 200_000, 24, 20_000


def digests(text: str, words: int = 3, seed: int = 42) -> bytes:
    """Eight bytes for each word shingle of a text, repeats included; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return b""
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    k = min(words, len(found))
    starts, stops = np.concatenate(([0], ends[: len(found) - k])).tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts, stops)])


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text over its word shingles, repeats included; 0 without words."""
    return majority(np.frombuffer(digests(text, words, seed), np.uint8).reshape(-1, 8))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, rows of eight bytes."""
    if not len(h):
        return 0
    ones = sum(np.unpackbits(h[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id long, kt long, fp long): kt is a hash of the text, fp holds the 64 bits as a signed number; null texts count as empty."""

    def each(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "kt": batch.column(1), "fp": fp.view(np.int64)}

    text = whole_text(text_col)
    return map_batches(docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text), each, "doc_id long, kt long, fp long")


def components(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, root, component_id) for fps(doc_id, fp): root is the same for all fingerprints that links of at most budget
    bits connect, component_id the smallest doc_id among their rows."""
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(trie_links(nodes.select("fp"), budget))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint 0 and are linked like others. Repeated rows give equal rows.
    A null doc_id keeps its row and is never a component's name unless all of the component are null.
    An empty table gives no rows; other columns of docs are not looked at.
    """
    fps = durable(fingerprints(docs, id_col, text_col, words))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(components(fps, budget), "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component one."""
    fps = durable(fingerprints(docs, words=words))
    return first_of_each(docs, fps.join(components(fps, budget), "fp").select("doc_id", "kt", "root"))


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs that stay: for each root of rows(doc_id, kt, root) the one with the smallest doc_id (of several its text with the smallest hash), once.

    The texts are shuffled once, to meet the ids that stay; only rows that are there more than once are shuffled again.
    """
    key, none, kt, again = absent(docs.columns, "key", "none", "kt", "again")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kt")).alias("b"))
    number = rows.groupBy("doc_id", "kt").agg((F.count("*") > 1).alias(again))
    number = number.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kt").alias("b"), again)
    stay = best.join(number, "b").select(F.coalesce("b.doc_id", F.lit(0)).alias(key), F.col("b.none").alias(none), F.col("b.kt").alias(kt), again)
    keys = {key: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").isNull(), kt: F.xxhash64(whole_text())}
    kept = docs.withColumns(keys).join(stay, [*keys])
    once = kept.where(~F.col(again)).unionByName(kept.where(again).dropDuplicates([*keys]))
    return once.select(columns_of(docs))


def trie_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(u, v): links between distinct fps(fp) that connect what pairs within budget bits connect.

    Of budget + 1 bands of the bits, near fingerprints have one alike. So each fingerprint goes to budget + 1 cells, by
    number and value of the band, at any number of fingerprints; with the band turned to the front, a cell is a subtrie, to
    be joined with itself. A cell of more than CELL_ROWS is dealt again, by bands of the bits that may still differ, until
    so few of these are left that no cell can be large.
    """
    ways, rows, fixed, found, turns = budget + 1, fps.select(F.col("fp").alias("x"), F.lit(0).cast("long").alias("path")), 0, [], []
    while True:
        rest = BITS - fixed
        band = rest // ways
        turns.append((rest, band))
        dealt = F.array(*[F.struct(_turned_column(F.col("x"), rest, j * band).alias("x"), (F.col("path") * ways + j).alias("path")) for j in range(ways)])
        dealt = rows.select(F.explode(dealt).alias("t")).select("t.*").withColumn("cell", F.shiftrightunsigned("x", rest - band) if rest > band else F.col("x"))
        sizes = durable(dealt.groupBy("path", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 1))
        many, most = sizes.agg(F.sum("n"), F.max("n")).first()
        split = (most or 0) > CELL_ROWS and rest - band > LEAST_BITS
        buckets = max(1, -(-(many or 0) // (ways * CELL_ROWS)))
        joined = dealt.join(sizes.where(F.col("n") <= CELL_ROWS) if split else sizes, ["path", "cell"], "left_semi")
        found.append(joined.groupBy("path", F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket")).applyInPandas(_cells(tuple(turns), budget), "u long, v long"))
        if not split:
            return reduce(DataFrame.unionByName, found)
        rows, fixed = durable(dealt.join(sizes.where(F.col("n") > CELL_ROWS), ["path", "cell"], "left_semi").select("x", "path")), fixed + band


def _cells(turns: tuple[tuple[int, int], ...], budget: int):
    """The links within the cells of one group of rows(x, path), all of one path, in the fingerprints as they were."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rest, band = turns[-1]
        path, x = int(rows["path"].iloc[0]), np.unique(rows["x"].to_numpy(np.int64).view(np.uint64))
        cell = x >> np.uint64(rest - band) if rest > band else x
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        u, v = forest(x, x, BITS - rest + band, budget, (start, np.append(start[1:], len(x))))
        for bits, width in reversed(turns):
            path, j = divmod(path, budget + 1)
            u, v = (_turned(y, bits, (bits - j * width) % bits) for y in (u, v))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return links


def _turned(x: np.ndarray, bits: int, by: int) -> np.ndarray:
    """The lowest bits turned left by so many places; those above stay."""
    if not by:
        return x
    mask = np.uint64((1 << bits) - 1)
    low = x & mask
    return (x & ~mask) | (((low << np.uint64(by)) | (low >> np.uint64(bits - by))) & mask)


def _turned_column(x: Column, bits: int, by: int) -> Column:
    if not by:
        return x
    mask = (1 << bits) - 1 if bits < BITS else -1
    low = x.bitwiseAND(F.lit(mask).cast("long"))
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, bits - by)).bitwiseAND(F.lit(mask).cast("long"))
    return turned.bitwiseOR(x.bitwiseAND(F.lit(~mask).cast("long")))


def near_pairs(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, budget: int, group: np.ndarray | None = None, spanning: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs within runs start to stop of fp that differ in budget bits at most; fp is sorted within each run.

    As forest, but for each run a trie of its own, and with the pairs themselves. group is a number for each place: pairs of one group are
    left out. All other pairs are returned, or, if spanning, so many of them as connect what all connect.
    """
    n = len(fp)
    first = np.arange(n) if group is None else np.unique(group, return_index=True, return_inverse=True)[1:]
    parent = first if group is None else first[0][first[1]]
    stack, out, ones = [(0, start, stop, start, stop)], [], {}
    while stack:
        d, *ends = stack.pop()
        if len(ends[0]) > SOME:
            stack += [(d, *(x[i : i + SOME] for x in ends)) for i in range(0, len(ends[0]), SOME)]
            continue
        al, ah, bl, bh = ends
        if group is not None or spanning:
            turns = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            apart = (parent[al] != parent[bl]) | (turns[al] != turns[ah - 1]) | (turns[bl] != turns[bh - 1])
            al, ah, bl, bh = (x[apart] for x in ends)
        few = (ah - al) * (bh - bl) <= FEW if d < BITS else np.ones(len(al), bool)
        for x, y in _leaves(fp, *(x[few] for x in (al, ah, bl, bh)), budget):
            between = parent[x] != parent[y] if group is not None or spanning else slice(None)
            out.append(_joining(parent, x[between], y[between]) if spanning else (x[between], y[between]))
        al, ah, bl, bh = (x[~few] for x in (al, ah, bl, bh))
        if not len(al):
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum(fp >> np.uint64(BITS - 1 - d) & np.uint64(1), dtype=np.int64)))
        am, bm = (hi - (ones[d][hi] - ones[d][lo]) for lo, hi in ((al, ah), (bl, bh)))
        two = (al != bl) | (ah != bh)
        parts = [(al, am, bl, bm), (am, ah, bm, bh), (al, am, bm, bh), tuple(x[two] for x in (am, ah, bl, bm))]
        below = [np.concatenate(x) for x in zip(*parts)]
        full = (below[0] < below[1]) & (below[2] < below[3])
        below = [x[full] for x in below]
        near = np.bitwise_count((fp[below[0]] ^ fp[below[2]]) >> np.uint64(BITS - 1 - d)) <= budget
        stack.append((d + 1, *(x[near] for x in below)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(x[k] for x in out)]) for k in (0, 1))


def _leaves(fp: np.ndarray, al, ah, bl, bh, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in (slice(i, i + SOME) for i in range(0, len(al), SOME)):
        na, nb = ah[s] - al[s], bh[s] - bl[s]
        pair = np.repeat(np.arange(len(na)), na * nb)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = al[s][pair] + k // nb[pair], bl[s][pair] + k % nb[pair]
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= budget) & ((x < y) | (al[s] != bl[s])[pair])
        yield np.minimum(x, y)[near], np.maximum(x, y)[near]


def _joining(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join two trees each, all of which are joined; every node points at its root."""
    out = [(x[:0], y[:0])]
    while len(x):
        high, first = np.unique(np.maximum(parent[x], parent[y]), return_index=True)
        out.append((x[first], y[first]))
        parent[high] = np.minimum(parent[x], parent[y])[first]
        while not np.array_equal(above := parent[parent], parent):
            parent[:] = above
        between = parent[x] != parent[y]
        x, y = x[between], y[between]
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(a: np.ndarray, b: np.ndarray, depth: int, budget: int, runs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between sorted distinct a and b, whose first depth bits are alike in each.

    a is b for the links within one subtrie, or within each of several: runs are their first places and those behind their last. A pair of nodes all of whose leaves are known to be connected
    is dropped: its links change no component.
    """
    same = a is b
    if not len(a) or not len(b):
        return a[:0], a[:0]
    every = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = np.arange(len(every))
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b))))] if runs is None else [(depth, *runs, *runs)]
    one = np.uint64(1)
    while stack:
        d, al, ah, bl, bh = stack.pop()
        if len(al) > BLOCK:
            stack += [(d, *(x[i : i + BLOCK] for x in (al, ah, bl, bh))) for i in range(0, len(al), BLOCK)]
            continue
        turns = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        joined = (parent[al] == parent[bl + shift]) & (turns[al] == turns[ah - 1]) & (turns[bl + shift] == turns[bh - 1 + shift])
        al, ah, bl, bh = (x[~joined] for x in (al, ah, bl, bh))
        few = (ah - al) * (bh - bl) <= FEW if d < BITS else np.ones(len(al), bool)
        _connect(parent, a, b, shift, budget, *(x[few] for x in (al, ah, bl, bh)))
        al, ah, bl, bh = (x[~few] for x in (al, ah, bl, bh))
        if not len(al):
            continue
        bit = one << np.uint64(BITS - 1 - d)
        head = ~((bit << one) - one) if d else np.uint64(0)
        am, bm = (np.searchsorted(x, (x[lo] & head) | bit) for x, lo in ((a, al), (b, bl)))
        am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
        mirror = same & (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm), (am, ah, bm, bh), (al, am, bm, bh)]
        children = [np.concatenate(x) for x in zip(*parts, tuple(x[~mirror] for x in (am, ah, bl, bm)))]
        cl, ch, dl, dh = children
        full = (cl < ch) & (dl < dh)
        cl, ch, dl, dh = (x[full] for x in (cl, ch, dl, dh))
        differing = np.bitwise_count((a[cl] ^ b[dl]) >> np.uint64(BITS - 1 - d))
        near = differing <= budget
        stack.append((d + 1, *(x[near] for x in (cl, ch, dl, dh))))
    moved = np.flatnonzero(parent != np.arange(len(every)))
    return every[moved], every[parent[moved]]


def _connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray, shift: int, budget: int, al, ah, bl, bh) -> None:
    """Compares the few leaves below each pair of nodes and joins those within the budget."""
    for i in range(0, len(al), BLOCK):
        s = slice(i, i + BLOCK)
        na, nb = ah[s] - al[s], bh[s] - bl[s]
        size = na * nb
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        x, y = al[s][pair] + k // nb[pair], bl[s][pair] + k % nb[pair]
        near = np.bitwise_count(a[x] ^ b[y]) <= budget
        union(parent, x[near], y[near] + shift)


def union(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins x with y in a forest in which every node points at its root, the smallest of its tree."""
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        if len(x):
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(above := parent[parent], parent):
                parent[:] = above

"""SimHash near-dedup at a similarity of word shingles: the trie self-join within cells of shared shingles, and an exact check.

Texts with equal sets of shingles are one node. Fingerprints of texts with a Jaccard similarity of 0.8 differ in 10 of 64 bits on
average, too many for cells of equal bands: nearly all pairs of a large corpus would be traversed. But sets of similarity t or more
share one of the first n - ceil(t * n) + 1 shingles of each in any common order (prefix filter). So a cell is the nodes that share
such a shingle; the order is by hash, with shingles that many texts have last (which these are is estimated on a part of the
texts, as the order bears on speed only). Within a cell the trie of fingerprints is joined with itself under a budget of BUDGET bits,
and what is found is compared exactly. The budget is wide: a pair of similarity 0.8 is beyond it with a chance under one in 10,000.

A dense cell is no square of pairs. First, cells (large ones in parts of near fingerprints) give a spanning forest of what differs
in CLOSE bits at most, one pair for each node, the nearest first, and pairs of each node with the one in the middle of its cell, which may be
what the others were copied from; those that the exact check confirms make groups. Then only pairs of nodes of
different groups are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, durable, map_batches, whole_text
from .simhash import digests, first_of_each, majority, near_pairs, union

#: Bits in which the fingerprints of near copies may differ, and those of pairs of the first forests.
BUDGET, CLOSE, SLACK = 24, 10, 1e-9
#: One text in PART is read for common shingles; common is what COMMON of these have, MOST shingles at most.
PART, COMMON, MOST = 8, 8, 200_000
#: Nodes of a cell that are joined as one trie in one task, and rows of cells in one group.
CELL, GROUP = 1024, 16_384
#: Texts of a batch whose shingles are held at once.
SLICE = 512
#: Nodes of a cell from which on each is compared with the middle one.
DENSE = 16


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; the whole text is one if it has fewer words."""
    return np.unique(np.frombuffer(digests(text, words), np.uint64))


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the common order, as many as similar sets can't all do without."""
    if not len(found):
        return found
    late = common[np.searchsorted(common, found).clip(0, len(common) - 1)] == found if len(common) else np.zeros(len(found), bool)
    return np.concatenate([found[~late], found[late]])[: len(found) - ceil(least * len(found) - SLACK) + 1].copy()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def _common(docs: DataFrame, words: int) -> np.ndarray:
    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        seen = set()
        for part in _slices(batch):
            texts = dict.fromkeys(t for t in part.column(0).to_pylist() if t not in seen)
            seen.update(texts)
            yield {"s": np.concatenate([np.zeros(0, np.uint64), *(shingles(t, words) for t in texts)]).view(np.int64)}

    part = docs.select(whole_text().alias("t")).where(F.xxhash64("t", F.lit(1)) % PART == 0)
    often = map_batches(part, each, "s long").groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST)
    return np.sort(np.array([r["s"] for r in often.select("s").collect()], np.int64).view(np.uint64))


def _described(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, kt, node, n, fp, tokens); copies in one batch have tokens once."""
    common = _common(docs, words)

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        known: dict[str, tuple] = {}
        none = np.zeros(0, np.int64)
        for part in _slices(batch):
            rows, tokens = [], []
            for t in part.column(2).to_pylist():
                if t in known:
                    tokens.append(none)
                else:
                    s = shingles(t, words)
                    known[t] = _signed(s), len(s), majority(s.view(np.uint8).reshape(-1, 8))
                    tokens.append(prefix(s, common, least).view(np.int64))
                rows.append(known[t])
            node, n, fp = zip(*rows)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in tokens]))).astype(np.int32)
            yield {"doc_id": part.column(0), "kt": part.column(1), "node": node, "n": n, "fp": np.array(fp, np.uint64).view(np.int64), "tokens": pa.ListArray.from_arrays(ends, np.concatenate(tokens))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()), whole_text()), each, "doc_id long, kt long, node long, n int, fp long, tokens array<bigint>")


def _signed(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 5)], np.uint64).view(np.int64)[0])


def _key(c: str) -> tuple[Column, Column, Column]:
    return F.coalesce(f"{c}.doc_id", F.lit(0)).alias("id"), F.col(f"{c}.none").alias("none"), F.col(f"{c}.kt").alias("kt")


def _sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set, n) of the wanted nodes, from one text of each."""
    one = described.join(wanted.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kt")).alias("b")).select("node", *_key("b"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(whole_text()).alias("kt"), whole_text().alias("t"))

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in _slices(batch):
            sets = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
            yield {"node": part.column(0), "set": sets, "n": [len(s) for s in sets]}

    texts = one.join(keyed, ["id", "none", "kt"]).select("node", "t").dropDuplicates(["node"])
    return map_batches(texts, each, "node long, set array<bigint>, n long")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, similarity) of pairs(u, v)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"), F.col("n").alias(f"{x}_n")) for x in "uv")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", (both / (F.col("u_n") + F.col("v_n") - both)).alias("similarity"))


def nearest(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, budget: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest as of near_pairs, of pairs that differ in few bits where these connect as much: such pairs are likelier to be similar."""
    tree, out = np.arange(int(group.max(initial=-1)) + 1), []
    for bits in [*range(2, budget, 2), budget]:
        i, j = near_pairs(fp, start, stop, bits, tree[group], True)
        out.append((i, j))
        union(tree, group[i], group[j])
    return tuple(np.concatenate(x) for x in zip(*out))


def around_middle(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in each run of least places or more: each of them with the one whose bits are nearest to those that most have."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in zip(start.tolist(), stop.tolist()):
        if hi - lo >= least:
            bits = np.unpackbits(fp[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
            middle = lo + int(np.abs(bits - bits.mean(axis=0).round()).sum(axis=1).argmin())
            near = np.arange(lo, hi)[np.bitwise_count(fp[lo:hi] ^ fp[middle]) <= BUDGET]
            out.append((near, np.full(len(near), middle)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _trie_pairs(rows: DataFrame, least: float, budget: int, spanning: bool) -> DataFrame:
    """(u, v): candidates within the parts of cells of rows(token, part, node, n, at, fp, root), not of one root, each once."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        token, part, node, n, at, fp, root = (group[c].to_numpy() for c in ("token", "part", "node", "n", "at", "fp", "root"))
        order = np.lexsort((fp.view(np.uint64), part, token))
        token, part, node, n, at, fp, root = (x[order] for x in (token, part, node, n, at, fp, root))
        start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (part[1:] != part[:-1]))))
        # A forest spans each part of a cell by itself: what is joined in one may need other pairs in another.
        name = np.unique(np.stack([np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token)))), root], axis=1), axis=0, return_inverse=True)[1].ravel()
        fp, stop = fp.view(np.uint64), np.append(start[1:], len(token))
        i, j = nearest(fp, start, stop, budget, name) if spanning else near_pairs(fp, start, stop, budget, name)
        keep = np.full(len(i), spanning)
        if spanning:
            x, y = around_middle(fp, start, stop)
            apart = (node[x] != node[y]) & (root[x] != root[y])
            i, j, keep = np.concatenate([i, x[apart]]), np.concatenate([j, y[apart]]), np.append(keep, np.zeros(apart.sum(), bool))
        keep |= np.minimum(n[i] - at[i], n[j] - at[j]) >= least / (1 + least) * (n[i] + n[j]) - SLACK
        found = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1)[keep], axis=0)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    groups = max(1, -(-rows.count() // GROUP))
    return rows.groupBy(F.pmod(F.xxhash64("token", "part"), F.lit(groups)).alias("g")).applyInPandas(pairs, "u long, v long").distinct()


def _joined_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(u, v): candidates of cells of any number of nodes: an equi-join, which adaptive execution splits."""
    a, b = (rows.select("token", F.col("node").alias(x), F.col("root").alias(f"{x}_root"), F.col("n").alias(f"{x}_n"), F.col("at").alias(f"{x}_at"), F.col("fp").alias(f"{x}_fp")) for x in "uv")
    need = least / (1 + least) * (F.col("u_n") + F.col("v_n")) - SLACK
    able = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at")) >= need
    near = F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp"))) <= BUDGET
    return a.join(b, "token").where((F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & able & near).select("u", "v").distinct()


def _shared(described: DataFrame) -> DataFrame:
    """(token, node, n, at, fp, m): tokens that m > 1 nodes have. Rows of a token are counted as they stream by, sorted."""
    nodes = described.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    tokens = described.select("node", F.posexplode("tokens").alias("at", "token"))
    number = F.count("*").over(Window.partitionBy("token"))
    several = tokens.withColumn("m", number).where("m > 1").groupBy("token", "node").agg(F.min("at").alias("at"))
    counted = several.join(several.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "token")
    return counted.join(nodes, "node")


def links(docs: DataFrame, described: DataFrame, shared: DataFrame, scratch: Scratch, words: int, least: float) -> DataFrame:
    """(u, v) of nodes of similarity least or more: enough of them to connect what all such pairs connect. shared is a table of scratch, and goes."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs)
        sets = scratch.keep("sets", _sets(docs, described, pairs.select(F.explode(F.array("u", "v")).alias("node")), words))
        close = durable(_compared(pairs, sets).where(F.col("similarity") >= least).select("u", "v"))
        scratch.drop("sets")
        return close

    bits = F.ceil(F.log2(F.col("m") / CELL))
    parts = shared.withColumn("root", F.col("node")).withColumn("part", F.when(bits > 0, F.expr("shiftrightunsigned(fp, 64 - cast(greatest(ceil(log2(m / %d)), 1) as int))" % CELL)).otherwise(F.lit(0).cast("long")))
    close = confirmed(_trie_pairs(parts, least, CLOSE, True))
    roots = connected_components(close)
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("part", F.lit(0).cast("long"))
    rooted = scratch.keep("rooted", rooted)
    scratch.drop("shared")
    small, large = rooted.where(F.col("m") <= CELL), rooted.where(F.col("m") > CELL)
    return close.unionByName(confirmed(_trie_pairs(small, least, BUDGET, False).unionByName(_joined_pairs(large, least)).distinct()))


def grouped(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, kt, root) for every row of docs: root is the same for all texts that pairs of similarity least or more connect.

    Null texts count as empty, and texts without words are copies of each other. An empty table gives no rows; other columns of
    docs are not looked at. Repeated rows give equal rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        # The tokens, most of it all, go as soon as those that are shared are found.
        whole = scratch.keep("whole", _described(docs, words, least))
        described, shared = durable(whole.drop("tokens")), scratch.keep("shared", _shared(whole))
        scratch.drop("whole")
        roots = connected_components(links(docs, described, shared, scratch, words, least))
    return durable(described.select("doc_id", "kt", "node").join(roots, "node", "left").select("doc_id", "kt", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns of any names: of each group of near copies the one with the smallest doc_id, once (see simhash.first_of_each)."""
    return first_of_each(docs, grouped(docs, words, least))

"""Nearest vectors by inner product over an index of cells, exact or approximate.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and a query a zero: then the
largest inner product is the smallest distance. An index deals the vectors into cells and gives them coordinates;
two of them are here:

  * Rings: the cell is the nearest pivot, the coordinate the distance to it. By the triangle inequality
    the difference of coordinates bounds the distance from below: the search is exact.
  * Boxes: coordinates are a few Gaussian (2-stable) projections, cells the top of a kd-tree over them, which goes on
    within each cell. A point at distance t has squared projected distance t^2 chi^2 with as many degrees of
    freedom as projections: neighbours in the projection are verified until the chi-square test says that
    what is left holds a nearer point with a small probability only.

A query searches its own cell first, then the nearest other one, the next two, the next four and so on: each time with
its k-th score so far, and only those cells that the bound does not rule out.
Within a cell runs of neighbouring coordinates are compared from the nearest outwards until the bound passes the k-th
distance. Cells are salted into groups of bounded size and the queries of a cell into blocks, so neither a hot vector nor many
queries make a large group. Only rows of cells that queries go to are shuffled, once for each block of queries of their cell: with
cells growing as the root of the table and few queries in each, that is once. Equal vectors of a group are compared once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, map_batches

#: Rows and queries of a group, and rows of a run of neighbouring coordinates.
GROUP, RUN = 8192, 256
#: Rows that a cell has on average, until there are as many cells as the root of the number of rows, or MOST_CELLS; what a cell has beyond GROUP rows is salted.
CELL, MOST_CELLS = 4096, 8192
#: Rows that pivots and the top of the kd-tree are fitted on: LEAST_SAMPLE, or PER_CELL for each cell (65,536 at most). Every row is indexed.
LEAST_SAMPLE, PER_CELL = 2048, 8


def usable(column: str) -> Column:
    """A vector that takes part: neither null nor empty, nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, fine), F.lit(False))


@dataclass(frozen=True)
class Rings:
    pivots: np.ndarray
    dims: int = 1
    scale: float = 1.0

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Rings:
        """Pivots: means of a few rounds of clustering the sample."""
        pivots = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
        for _ in range(5):
            own = _nearest(sample, pivots)
            pivots = np.array([sample[own == k].mean(axis=0) if (own == k).any() else pivots[k] for k in range(len(pivots))])
        return Rings(pivots)

    def cell(self, points: np.ndarray) -> np.ndarray:
        return _nearest(points, self.pivots)

    def coordinates(self, points: np.ndarray, cell: int) -> np.ndarray:
        return np.sqrt(((points - self.pivots[cell]) ** 2).sum(axis=1))[:, None]

    @property
    def cells(self) -> int:
        return len(self.pivots)


@dataclass(frozen=True)
class Boxes:
    directions: np.ndarray
    splits: tuple[tuple[int, float], ...]
    dims: int
    scale: float

    @staticmethod
    def fit(sample: np.ndarray, cells: int, dims: int = 8, sure: float = 0.99) -> Boxes:
        """The top of the kd-tree in level order, by medians of the sample; sure is the probability of the stopping test."""
        directions = np.random.default_rng(5).standard_normal((sample.shape[1], dims))
        parts, splits = [sample @ directions], []
        while len(parts) < cells:
            below = []
            for p in parts:
                axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
                cut = float(np.median(p[:, axis])) if len(p) else 0.0
                splits.append((axis, cut))
                below += [p[p[:, axis] <= cut], p[p[:, axis] > cut]]
            parts = below
        return Boxes(directions, tuple(splits), dims, 1 / math.sqrt(chi_square_quantile(sure, dims)))

    def cell(self, points: np.ndarray) -> np.ndarray:
        own, at = points @ self.directions, np.zeros(len(points), np.int64)
        if self.splits:
            axis, cut = (np.array(x) for x in zip(*self.splits))
            for _ in range((len(self.splits) + 1).bit_length() - 1):
                at = 2 * at + 1 + (own[np.arange(len(at)), axis[at]] > cut[at])
        return at - len(self.splits)

    def coordinates(self, points: np.ndarray, cell: int) -> np.ndarray:
        return points @ self.directions

    @property
    def cells(self) -> int:
        return len(self.splits) + 1


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if 1 - beyond < p else (low, x)
    return low


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0))


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // len(pivots))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(_distances(points[i : i + step], pivots), axis=1) for i in range(0, len(points), step))])


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))])


def _query(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.zeros(len(x))])


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _runs(own: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The kd-tree below a cell: rows halved at the median of the widest coordinate, to runs of RUN rows."""
    if len(rows) <= RUN:
        return [rows]
    axis = int(np.argmax(np.ptp(own[rows], axis=0)))
    order = rows[np.argsort(own[rows, axis], kind="stable")]
    return _runs(own, order[: len(rows) // 2]) + _runs(own, order[len(rows) // 2 :])


def _gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances in coordinates from queries (m x dims) to boxes (n x dims)."""
    total = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        total += np.maximum(np.maximum(low[None, :, k] - q[:, k, None], q[:, k, None] - high[None, :, k]), 0) ** 2
    return np.sqrt(total)


def _reach(q: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """The distance at which a vector has this score, with room for rounding; unknown scores reach all."""
    square = (q**2).sum(axis=1) + most - 2 * score
    return np.where(np.isfinite(score), np.sqrt(np.maximum(square, 0)) + 1e-6 * (1 + math.sqrt(most)), np.inf)


def search_group(index: Rings | Boxes, cell: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of the k best rows for each query that are better than its least score, or as good."""
    x, inverse = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, inverse.ravel()))
    begin = np.searchsorted(inverse.ravel()[order], np.arange(len(x) + 1))
    ids = ids[order]
    lifted, asked = _lifted(x, most), _query(q)
    own = index.coordinates(lifted, cell)
    runs = _runs(own, np.arange(len(x)))
    low, high = (np.array([f(own[r], axis=0) for r in runs]) for f in (np.min, np.max))
    gap = _gap(index.coordinates(asked, cell), low, high) * index.scale
    nearest = np.argsort(gap, axis=1, kind="stable")
    keep = k + 1  # distinct vectors: one of them may be the query itself
    score, place = np.full((len(q), keep), -np.inf), np.full((len(q), keep), -1)
    reach = _reach(q, most, least)
    for turn in range(len(runs)):
        run = nearest[:, turn]
        active = np.flatnonzero(gap[np.arange(len(q)), run] <= reach)
        if not len(active):
            break
        for r in np.unique(run[active]):
            who = active[run[active] == r]
            s = q[who] @ x[runs[r]].T
            a, b = np.nonzero(s >= np.maximum(score[who, -1], -np.inf)[:, None])
            _keep(score, place, ids[begin[:-1]], who[a], runs[r][b], s[a, b])
        reach = np.minimum(reach, _reach(q, most, score[:, -1]))
    who, column = np.nonzero(place >= 0)
    vector = place[who, column]
    n = np.minimum(begin[vector + 1] - begin[vector], keep)
    at = np.repeat(begin[vector], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who, value, found = np.repeat(who, n), np.repeat([math.fsum(p) for p in q[who] * x[vector]] if len(who) else np.zeros(0), n), ids[at]
    other = (found != query_ids[who]) & (value >= least[who])
    who, value, found = who[other], value[other], found[other]
    order = np.lexsort((found, -value, who))
    who, value, found = who[order], value[order], found[order]
    best = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[best], found[best], value[best]


def _keep(score: np.ndarray, place: np.ndarray, name: np.ndarray, who: np.ndarray, what: np.ndarray, value: np.ndarray) -> None:
    """Merges found vectors into the best of their queries; of equal scores the smaller id is better."""
    rows, keep = np.unique(who), score.shape[1]
    who = np.concatenate([np.repeat(rows, keep), who])
    what, value = np.concatenate([place[rows].ravel(), what]), np.concatenate([score[rows].ravel(), value])
    order = np.lexsort((np.where(what >= 0, name[what], np.iinfo(np.int64).max), -value, who))
    who, what, value = who[order], what[order], value[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    best = rank < keep
    place[who[best], rank[best]], score[who[best], rank[best]] = what[best], value[best]


def search(vectors: DataFrame, every: int, k: int, kind: type[Rings] | type[Boxes], sent_rows: list[int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score double) for vectors(vec_id long, vec array<double>) without nulls.

    Queries are the rows whose vec_id is divisible by every; a repeated query id is asked once, with its least vector.
    Each other row is a candidate; rows with the query's id are the query's own. Shorter vectors are filled up
    with zeros. Fewer than k candidates are returned all; no queries or no candidates give no rows.
    sent_rows gets the number of rows that are shuffled as candidates, for each round.
    """
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(squares).alias("most")).first()
    if not stats["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = stats["dim"], stats["most"]
    padded = vectors.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))
    cells = 1 << max(0, min(MOST_CELLS.bit_length() - 1, round(math.log2(stats["n"] / CELL)), round(math.log2(stats["n"]) / 2)))
    sample = padded.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEAST_SAMPLE, PER_CELL * cells)).collect()
    index = kind.fit(_lifted(np.array([r["vec"] for r in sample], np.float64), most), cells)

    def indexed(batch: pa.RecordBatch) -> dict:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        points = _lifted(x, most)
        cell = index.cell(points)
        own = np.zeros((len(x), index.dims))
        for c in np.unique(cell):
            own[cell == c] = index.coordinates(points[cell == c], int(c))
        return {"vec_id": batch.column(0), "cell": cell, "own": list(own), "vec": [r.tobytes() for r in x]}

    rows = durable(map_batches(padded.select("vec_id", "vec"), indexed, "vec_id long, cell int, own array<double>, vec binary"))
    edges = [f(F.col("own")[i]).alias(f"{n}{i}") for i in range(index.dims) for n, f in (("low", F.min), ("high", F.max))]
    catalog = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect()}
    known = np.array(sorted(catalog))
    salts = {int(c): -(-catalog[c]["n"] // GROUP) for c in known}
    box = [np.array([[catalog[c][f"{n}{i}"] for i in range(index.dims)] for c in known]) for n in ("low", "high")]
    asked = padded.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumnRenamed("vec_id", "query_id")

    salt_of = F.broadcast(vectors.sparkSession.createDataFrame(list(salts.items()), "cell int, salts int"))  # a row for each cell
    dealt = rows.join(salt_of, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("salts").cast("long")).cast("int").alias("salt"), "vec_id", "vec")

    def wanted(q: np.ndarray, score: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the cell) for the cells that come from begin to before end in the queries' orders, as far as the bound lets them."""
        point = _query(q)
        gap = np.column_stack([_gap(index.coordinates(point, int(c)), box[0][i : i + 1], box[1][i : i + 1])[:, 0] for i, c in enumerate(known)]) * index.scale
        # First the cell in which the query itself would be indexed, then the others by their distances.
        home = np.searchsorted(known, index.cell(_lifted(q, most))).clip(0, len(known) - 1)
        order = gap.copy()
        order[np.arange(len(q)), home] = -1
        visited = np.argsort(order, axis=1, kind="stable")[:, begin:end]
        who, column = np.nonzero(np.take_along_axis(gap, visited, axis=1) <= _reach(q, most, score)[:, None])
        return who, visited[who, column]

    def visits(batch: pa.RecordBatch, begin: int, end: int) -> dict:
        q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        score = batch.column(2).to_numpy(zero_copy_only=False)
        who, cell = wanted(q, score, begin, end)
        return {"query_id": batch.column(0).to_numpy()[who], "cell": known[cell], "vec": [q[w].tobytes() for w in who], "least": score[who]}

    def routed(queries: DataFrame, begin: int, end: int) -> tuple[DataFrame, DataFrame] | None:
        """Queries by (cell, salt, block) and the rows of the cells that they go to, for each block of GROUP queries of a cell."""
        sent = map_batches(queries.select("query_id", "vec", "least"), lambda batch: visits(batch, begin, end), "query_id long, cell int, vec binary, least double")
        numbers = [(r["cell"], -(-r["n"] // GROUP)) for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # a row for each cell
        if sent_rows is not None:
            sent_rows.append(sum(catalog[c]["n"] * blocks for c, blocks in numbers))
        if not numbers:
            return None
        asked_of = F.broadcast(vectors.sparkSession.createDataFrame(numbers, "cell int, blocks int"))
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int").alias("block")
        sent = sent.join(asked_of, "cell").join(salt_of, "cell").select("cell", block, "query_id", "vec", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return sent, dealt.join(asked_of, "cell").select("cell", "salt", "vec_id", "vec", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def group(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, query_ids = candidates["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        who, found, score = search_group(index, int(key[0]), ids, _matrix(candidates["vec"]), query_ids, _matrix(queries["vec"]), queries["least"].to_numpy(np.float64), k, most)
        return pd.DataFrame({"query_id": query_ids[who], "vec_id": found, "score": score})

    keys = ("cell", "salt", "block")
    compared = lambda queries, candidates: candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(group, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, begin, end = None, 0, 1
    while begin < len(known):
        if best is None:
            bounded = asked.withColumn("least", F.lit(float("-inf")))
        else:
            bound = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            bounded = asked.join(bound, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        groups = routed(bounded, begin, end)
        if groups is None:
            begin, end = end, 2 * end
            continue
        found = compared(*groups)
        every = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = durable(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        begin, end = end, 2 * end
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10, grid: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score long): the k largest inner products of floor(grid * component), by pivots and rings.

    vectors(vec_id, embedding). Vectors that are null, empty or hold null or non-finite components take no part.
    Scores are exact up to 2^53; greater ones raise an error. See search for repeated ids, lengths and empty tables.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * grid).cast("double"))
    rows = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))
    found = search(rows.where("vec_id is not null"), every, k, Rings)
    too_large = F.raise_error(F.lit("an inner product is beyond 2^53"))
    return found.select("query_id", "rank", "vec_id", F.when(F.abs("score") < 2.0**53, F.col("score").cast("long")).otherwise(too_large.cast("long")).alias("score"))


def near_top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k largest inner products found, by projections and a kd-tree.

    As exact_top_k on the vectors as they are; zero vectors take no part either.
    """
    zero = F.forall("embedding", lambda x: x == 0)
    rows = vectors.where(usable("embedding") & ~zero).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return search(rows.where("vec_id is not null"), every, k, Boxes)

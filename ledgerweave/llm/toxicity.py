"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P, texts without regard to any label the unlabelled U. With the class prior
p, the risk is p R+(P) + max(0, R-(U) - p R-(P)) for logistic losses; where the second part falls below
zero, the step goes up its slope instead, so the classifier does not learn the unlabelled positives as negatives.
Features say whether a word or a beginning of a word occurs in the text (hashed); those are kept that
are more frequent in P than in U beyond chance. Training runs in numpy on the driver over a bounded sample; scores
take whole texts on the executors.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, whole_text

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 21
BEGINNINGS = (3, 4, 5, 6)
#: Words whose features a worker remembers.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Settings:
    """The training sample is the bound on what is learnt from: at most this many positive and unlabelled rows."""

    positives: int = 3000
    unlabelled: int = 6000
    least_z: float = 4.0
    least_texts: int = 5
    epochs: int = 250
    rate: float = 0.05
    decay: float = 7e-4


@dataclass(frozen=True)
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0


def features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    names = ["w" + word, *("b" + word[:k] for k in BEGINNINGS if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for x in names]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are not learnt from; a row without an id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model from docs(doc_id, text) and labels(doc_id, toxic).

    Only rows that are not held out count; a doc_id labelled both ways is toxic. Without a toxic text in docs the
    model scores every text near 0.
    """
    ids = docs.select(F.col("doc_id").cast("long")).where(~held_out())
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    mixed = F.xxhash64("doc_id"), F.col("doc_id")
    toxic = ids.join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").distinct()
    sample = [[r[0] for r in rows.orderBy(*mixed).limit(n).collect()] for rows, n in ((toxic, settings.positives), (ids.distinct(), settings.unlabelled))]
    if not sample[0] or not 0 < prior < 1:
        return Model()
    wanted = docs.sparkSession.createDataFrame([(i,) for i in {*sample[0], *sample[1]}], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).join(F.broadcast(wanted), "doc_id")
    found = map_batches(texts, _sampled, "doc_id long, slots array<int>").toArrow()
    slots = dict(zip(found.column(0).to_pylist(), (x.values.to_numpy() for x in found.column(1))))
    return _train([slots[i] for i in sample[0]], [slots[i] for i in sample[1]], prior, settings)


def _sampled(batch: pa.RecordBatch) -> dict:
    texts = [{*WORD.findall(t.lower())} for t in batch.column(1).to_pylist()]
    return {"doc_id": batch.column(0), "slots": [np.unique(np.array([f for w in words for f in features(w)], np.int32)) for words in texts]}


def _train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings) -> Model:
    n, u = len(positive), len(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate(x), minlength=SLOTS) for x in (positive, unlabelled))
    pooled = (in_p + in_u) / (n + u)
    z = (in_p / n - in_u / u) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n + 1 / u))
    kept = np.flatnonzero((z > settings.least_z) & (in_p + in_u >= settings.least_texts))
    if not len(kept):
        return Model()
    place = np.full(SLOTS, -1)
    place[kept] = np.arange(len(kept))
    own = [c[c >= 0] for c in (place[x] for x in (*positive, *unlabelled))]
    column, row = np.concatenate(own), np.repeat(np.arange(n + u), [len(x) for x in own])
    is_p = np.arange(n + u) < n
    w, m, v = np.append(np.zeros(len(kept)), -2.0), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    mean = np.zeros_like(w)  # of the later half of the steps: the two slopes of the risk take turns
    for step in range(1, settings.epochs + 1):
        margin = np.bincount(row, w[column], n + u) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        negative = np.logaddexp(0, margin[~is_p]).mean() - prior * np.logaddexp(0, margin[is_p]).mean()
        slope_u, slope_p = p[~is_p] / u, prior * p[is_p] / n
        slope = np.concatenate([prior * (p[is_p] - 1) / n - slope_p, slope_u] if negative >= 0 else [slope_p, -slope_u])
        g = np.append(np.bincount(column, slope[row], len(kept)) + settings.decay * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - settings.rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        mean += w * (step > settings.epochs // 2) / (settings.epochs - settings.epochs // 2)
    return Model({int(k): float(x) for k, x in zip(kept, mean)}, float(mean[-1]))


_remembered: dict[str, tuple[int, ...]] = {}
_remembered_for: list[Model] = []


def _scores(texts: list[str], model: Model) -> np.ndarray:
    if not _remembered_for or _remembered_for[0] != model:
        _remembered.clear()
        _remembered_for[:] = [model]
    out = []
    for text in texts:
        if len(_remembered) > REMEMBERED:
            _remembered.clear()
        hit: set[int] = set()
        for word in {*WORD.findall(text.lower())}:
            own = _remembered.get(word)
            if own is None:
                own = _remembered[word] = tuple(f for f in features(word) if f in model.weights)
            if own:
                hit.update(own)
        out.append(model.bias + sum(model.weights[f] for f in sorted(hit)))
    return 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; a null text is an empty one."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": _scores(batch.column(2).to_pylist(), model)}

    rows = map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col), whole_text(text_col)), each, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that the model does not take as toxic, with all their columns."""
    model = fit(docs, labels, settings)
    scored = F.pandas_udf(lambda t: pd.Series(_scores(t.tolist(), model)), "double")
    return docs.where(scored(whole_text()) < 0.5)

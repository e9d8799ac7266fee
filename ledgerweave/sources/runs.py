"""Runs of collecting: state that survives its writer, one writer at a time, content kept once by its hash, and a history of what was fetched.

    with Run(spark, root, "rs-system-api", "2024-01", {"year": 2024}) as run:
        run.store(pages)        # pages(key, url, content): fetched by executors
        run.finish(complete)

A run is a folder: `lock`, made exclusively; `state`, a pointer that moves with each step, so a killed run goes on from its last one; `objects`, contents by
hash, whichever key, run or day they came with; `snapshots`, an append-only table that says when a key had which content. A run that was killed
leaves its lock; who has made sure that its writer is gone takes it over.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pointer

OBJECTS = "sha256 string, content binary, shelf string"
SNAPSHOTS = "key string, url string, sha256 string, size bigint, fetched_at timestamp, step int"


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Run:
    def __init__(self, spark: SparkSession, root: str, collection: str, run: str, scope: dict, take_over: bool = False):
        for name in (collection, run):
            if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", name):
                raise ValueError(f"not a name: {name}")
        self.spark, self.root, self.folder, self.scope, self.take_over = spark, f"{root}/{collection}", f"{root}/{collection}/runs/{run}", scope, take_over
        self.token = uuid4().hex
        self.state: dict = {}

    def __enter__(self) -> Run:
        lock = f"{self.folder}/lock"
        if self.take_over:
            pointer.remove(self.spark, lock)
        pointer.create(self.spark, lock, self.token)
        try:
            self.state = pointer.latest(self.spark, f"{self.folder}/state") or {"scope": self.scope, "started_at": _now(), "attempts": [], "step": 0}
            if self.state["scope"] != self.scope:
                raise ValueError("a run isn't used again for another scope")
            self.state["attempts"].append({"started_at": _now()})
            self._move(status="running", error=None, finished_at=None)
        except BaseException:
            pointer.remove(self.spark, lock)
            raise
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        try:
            if error is not None and self._held():
                self.state["attempts"][-1] |= {"status": "failed", "finished_at": _now(), "error": str(error)}
                self._move(status="failed", error=str(error), finished_at=_now())
        finally:
            if self._held():
                pointer.remove(self.spark, f"{self.folder}/lock")

    def _held(self) -> bool:
        return pointer.read(self.spark, f"{self.folder}/lock") == self.token

    def _move(self, **values: object) -> None:
        if not self._held():
            raise RuntimeError("another writer has taken this run over")
        self.state.update(values)
        pointer.advance(self.spark, f"{self.folder}/state", self.state)

    def store(self, pages: DataFrame, step: int | None = None) -> None:
        """Keeps pages(key, url, content): what the store doesn't have by hash, then what says which key had it. A step that was stored before isn't stored again.

        pages are computed once, into the run's folder, so nothing is fetched twice though it is read for both.
        """
        step = self.state["step"] if step is None else step
        if step < self.state["step"]:
            return
        apart = f"{self.folder}/steps/{step}"
        pages.select("key", "url", "content", F.sha2("content", 256).alias("sha256")).write.mode("overwrite").parquet(apart)
        rows = self.spark.read.parquet(apart)
        new = rows.select("sha256", "content", F.substring("sha256", 1, 2).alias("shelf")).dropDuplicates(["sha256"]).join(objects(self.spark, self.root).select("sha256"), "sha256", "left_anti")
        new.write.mode("append").partitionBy("shelf").parquet(f"{self.root}/objects")
        told = rows.select("key", "url", "sha256", F.octet_length("content").cast("bigint").alias("size"), F.lit(_now()).cast("timestamp").alias("fetched_at"), F.lit(step).alias("step"))
        told.write.mode("overwrite").parquet(f"{self.folder}/snapshots/step={step}")
        self._move(step=step + 1)
        pointer.remove(self.spark, apart)

    def history(self) -> DataFrame:
        """(key, url, sha256, size, fetched_at, step) of all that this run stored, in order of steps."""
        return history(self.spark, self.folder)

    def cached(self) -> DataFrame:
        """(key, sha256, content): what each key had last, if its content is there and is what its hash says."""
        last = self.history().groupBy("key").agg(F.max_by("sha256", "step").alias("sha256"))
        return last.join(objects(self.spark, self.root), "sha256").where(F.sha2("content", 256) == F.col("sha256")).select("key", "sha256", "content")

    def finish(self, complete: bool, **counts: int) -> None:
        status, at = "complete" if complete else "partial", _now()
        self.state["attempts"][-1] |= {"status": status, "finished_at": at}
        self._move(status=status, finished_at=at, **({"last_complete_at": at} if complete else {}), **counts)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, content, shelf) of all runs of a collection."""
    there = pointer.exists(spark, f"{root}/objects")
    return spark.read.schema(OBJECTS).parquet(f"{root}/objects") if there else spark.createDataFrame([], OBJECTS)


def history(spark: SparkSession, folder: str) -> DataFrame:
    there = pointer.exists(spark, f"{folder}/snapshots")
    return spark.read.schema(SNAPSHOTS).parquet(f"{folder}/snapshots") if there else spark.createDataFrame([], SNAPSHOTS)

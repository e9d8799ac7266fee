"""N-Quads files with their manifest from one job, as a Python data source.

    spark.dataSource.register(NQuadsSink)
    quads.select("g", line().alias("value")).write.format("nquads").option("path", folder).mode("append").save()

A task writes one gzipped file and tells the driver its name and hash, and of each graph how many lines it had and their digest, which is the sum of the digests
of lines, so those of tasks add up in any order. The manifest is written last and names what counts; files of tasks that failed or ran twice are
removed. A folder that has a manifest isn't written again.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_WHOLE = 1 << 256


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int
    sha256: str
    graphs: dict[str, tuple[int, int]]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _tally(graphs: dict[str, tuple[int, int]], g: str, line: str) -> None:
    n, total = graphs.get(g, (0, 0))
    graphs[g] = n + 1, (total + int.from_bytes(hashlib.sha256(line.encode()).digest(), "big")) % _WHOLE


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, notes: str):
        self.path, self.notes, self.job = path.rstrip("/"), notes, uuid4().hex
        store, at = _place(self.path)
        if store.get_file_info(f"{at}/manifest.json").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} has a manifest")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, at = _place(self.path)
        store.create_dir(at, recursive=True)
        name, graphs, size, digest = f"{self.job}-{uuid4().hex}.nq.gz", {}, 0, hashlib.sha256()
        pack = zlib.compressobj(wbits=31)
        try:
            with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                for batch in iterator:
                    lines = batch.column("value").to_pylist()
                    for g, line in zip(batch.column("g").to_pylist(), lines):
                        _tally(graphs, g, line)
                    for block in (pack.compress("".join(f"{x}\n" for x in lines).encode()), None):
                        if block:
                            out.write(block)
                            digest.update(block)
                            size += len(block)
                block = pack.flush()
                out.write(block)
                digest.update(block)
        except BaseException:
            store.delete_file(f"{at}/{name}")
            raise
        return _Written(name, size + len(block), digest.hexdigest(), graphs)

    def commit(self, messages: list[_Written | None]) -> None:
        told = [m for m in messages if m is not None]
        graphs: dict[str, tuple[int, int]] = {}
        for m in told:
            for g, (n, total) in m.graphs.items():
                have = graphs.get(g, (0, 0))
                graphs[g] = have[0] + n, (have[1] + total) % _WHOLE
        said = {"files": [{"name": m.name, "bytes": m.size, "sha256": m.sha256} for m in told], "graphs": {g: {"n": n, "digest": f"{d:064x}"} for g, (n, d) in sorted(graphs.items())}, "notes": self.notes}
        store, at = _place(self.path)
        self._remove({m.name for m in told})
        with store.open_output_stream(f"{at}/{self.job}.json") as out:
            out.write(json.dumps(said, ensure_ascii=False, indent=1).encode())
        store.move(f"{at}/{self.job}.json", f"{at}/manifest.json")

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove(set())

    def _remove(self, but: set[str]) -> None:
        """Files of this job that don't count."""
        store, at = _place(self.path)
        for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(self.job) and x.base_name not in but:
                store.delete_file(x.path)


class NQuadsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nquads"

    def schema(self) -> str:
        return "g string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a release is never written over")
        return _Writer(self.options["path"], self.options.get("notes", ""))


def manifest(folder: str) -> dict:
    store, at = _place(folder.rstrip("/"))
    with store.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(g, value) of the lines of the files that the manifest names."""
    paths = [f"{folder.rstrip('/')}/{f['name']}" for f in manifest(folder)["files"]]
    lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
    return lines.select(F.regexp_extract("value", r" <([^>]*)> \.$", 1).alias("g"), "value")


def differing(spark: SparkSession, folder: str) -> list[str]:
    """Graphs whose lines aren't what the manifest says, and files whose bytes aren't. Tasks add up their own lines; a row for each graph and task comes back."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for g, line in zip(batch.column("g").to_pylist(), batch.column("value").to_pylist()):
                _tally(graphs, g, line)
        yield pa.RecordBatch.from_pydict({"g": pa.array(graphs, pa.string()), "n": pa.array([n for n, _ in graphs.values()], pa.int64()), "digest": pa.array([f"{d:064x}" for _, d in graphs.values()], pa.string())})

    said, found = manifest(folder), {}
    for r in read(spark, folder).mapInArrow(tallied, "g string, n bigint, digest string").collect():
        n, total = found.get(r["g"], (0, 0))
        found[r["g"]] = n + r["n"], (total + int(r["digest"], 16)) % _WHOLE
    files = [f"{folder.rstrip('/')}/{f['name']}" for f in said["files"]]
    hashes = {r["path"].rsplit("/", 1)[1]: r["h"] for r in spark.read.format("binaryFile").load(files).select("path", F.sha2("content", 256).alias("h")).collect()} if files else {}
    wrong = [f["name"] for f in said["files"] if hashes.get(f["name"]) != f["sha256"]]
    told = {g: (x["n"], int(x["digest"], 16)) for g, x in said["graphs"].items()}
    return sorted(g for g in {*told, *found} if told.get(g) != found.get(g)) + wrong

"""What several operators of this subpackage share: tables, durable cuts of lineage, batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as every operator here takes it: null counts as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def absent(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns beside these columns: underscores go before a name until no column has it, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, dots and backticks in names or not."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; only on one machine is one made where none is set."""
    context = spark.sparkContext
    if (set_already := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_already.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder of the shared store, now or when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        store.deleteOnExit(place)
    else:
        store.delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder, compressed, for what is read again within one computation and deleted before it ends.

    Lasting ones are read by the result, whenever that is, and deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, lasting: bool = False):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid4().hex}"
        if lasting:
            remove_folder(spark, self.folder, at_exit=True)

    def __enter__(self) -> Scratch:
        return self

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        remove_folder(self.spark, f"{self.folder}/{name}")

    def __exit__(self, *error: object) -> None:
        remove_folder(self.spark, self.folder)


def give_back() -> None:
    """What a task of a Python worker has freed goes back to the machine, as workers live on beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[dict[str, object]] | dict[str, object]], schema: str, done: Callable[[], None] = lambda: None) -> DataFrame:
    """mapInArrow with a function from one batch to the columns of one result batch or of several; done is called at the end of a task."""
    kind = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    made = each(batch)
                    for columns in [made] if isinstance(made, dict) else made:
                        yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in kind], schema=kind)
                    batch = made = columns = None  # before the next one is read
        finally:
            done()
            give_back()

    return df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(name: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    if name in plain:
        return plain[name]
    if name.startswith("array<"):
        return pa.list_(_arrow(name[6:-1]))
    raise ValueError(name)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)

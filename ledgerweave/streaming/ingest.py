"""Streaming ingest of quads into versioned graphs.

A delivery is a folder of quads, then a row for each of its graphs that says how many there are. The stream reads both. However many batches a
graph's rows come in, they lie beside the graph's earlier versions, and a version becomes the current one when it is whole: when as many rows came as
were declared. What is current is a table of its own for each batch, and a pointer that moves at once names the last one; so a reader never sees
part of a graph, a batch that is run again writes the same, and a stream that was stopped anywhere goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pointer
from ..schema import TABLES

_DECLARED = "g string, n bigint"
_STATE = "g string, delivery string, n bigint, declared bigint"


def deliver(quads: DataFrame, folder: str, delivery: str) -> None:
    """Writes a delivery; later ones have greater names, such as dates. One that is there isn't written again: that raises."""
    quads.write.parquet(f"{folder}/quads/delivery={delivery}")
    written = quads.sparkSession.read.schema(TABLES["quads"]).parquet(f"{folder}/quads/delivery={delivery}")
    written.groupBy("g").agg(F.count("*").alias("n")).write.parquet(f"{folder}/declared/delivery={delivery}")


def read_quads(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Quads with their delivery, and rows with n in place of a quad where a delivery declares a graph."""
    made = []
    for name, schema in (("quads", TABLES["quads"]), ("declared", _DECLARED)):
        made.append(spark.readStream.schema(f"{schema}, delivery string").option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}"))
    return made[0].unionByName(made[1], allowMissingColumns=True)


def write_graphs(quads: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps what read_quads gives below path, for read_graphs."""
    writer = quads.writeStream.foreachBatch(lambda batch, number: _keep(batch, number, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _keep(batch: DataFrame, number: int, path: str) -> None:
    spark = batch.sparkSession
    batch = batch.withColumn("batch", F.lit(number))
    rows = batch.where("n is null").drop("n")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g", "delivery", "batch").parquet(f"{path}/rows")
    last = pointer.latest(spark, f"{path}/current") or {"now": None, "before": None}
    before = last["before"] if last["now"] == number else last["now"]  # a batch that is run again begins where it began
    state = spark.createDataFrame([], _STATE) if before is None else spark.read.schema(_STATE).parquet(f"{path}/versions/{before}")
    came = batch.groupBy("g", "delivery").agg(F.count(F.when(F.col("n").isNull(), 1)).alias("n"), F.max("n").alias("declared"))
    state = state.unionByName(came).groupBy("g", "delivery").agg(F.sum("n").alias("n"), F.max("declared").alias("declared"))
    whole = state.where("n = declared").groupBy("g").agg(F.max("delivery").alias("newest"))
    state = state.join(whole, "g", "left").where("newest is null or delivery >= newest").drop("newest")
    state.write.mode("overwrite").parquet(f"{path}/versions/{number}")
    pointer.advance(spark, f"{path}/current", {"now": number, "before": before})
    if before is not None and last["before"] not in (None, before):
        pointer.remove(spark, f"{path}/versions/{last['before']}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(g, delivery) of the current version of each graph."""
    now = (pointer.latest(spark, f"{path}/current") or {}).get("now")
    state = spark.createDataFrame([], _STATE) if now is None else spark.read.schema(_STATE).parquet(f"{path}/versions/{now}")
    return state.where("n = declared").groupBy("g").agg(F.max("delivery").alias("delivery"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """The quads of the current version of each graph. Graph and delivery are folders, so other versions aren't read."""
    columns = TABLES["quads"].replace(", g string", "")
    rows = spark.read.schema(f"{columns}, g string, delivery string, batch bigint").parquet(f"{path}/rows")
    return rows.join(versions(spark, path), ["g", "delivery"]).select(*[c.split()[0] for c in TABLES["quads"].split(", ")])


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """(g, delivery, n, declared) of versions of which rows, or what declares them, have not come yet."""
    now = (pointer.latest(spark, f"{path}/current") or {}).get("now")
    state = spark.createDataFrame([], _STATE) if now is None else spark.read.schema(_STATE).parquet(f"{path}/versions/{now}")
    return state.where("not (n <=> declared)")


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes versions older than the current ones, when no reader needs them any more; says how many folders went."""
    old = spark.read.parquet(f"{path}/rows").select("g", "delivery", F.input_file_name().alias("file")).join(versions(spark, path).withColumnRenamed("delivery", "now"), "g").where("delivery < now")
    folders = [r["folder"] for r in old.select(F.regexp_replace("file", "/batch=[^/]*/[^/]*$", "").alias("folder")).distinct().collect()]
    for folder in folders:
        pointer.remove(spark, folder)
    return len(folders)

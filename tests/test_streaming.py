from __future__ import annotations

import datetime
import os

import pytest
from pyspark.errors import StreamingQueryException

from ledgerweave.streaming import ingest, usage

QUAD = "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string"


def quads(spark, rows):
    return spark.createDataFrame([(s, "p", "o", "uri", None, None, g) for s, g in rows], QUAD)


def run(spark, source, out, state, files=100):
    ingest.write_graphs(ingest.read_quads(spark, source, files), out, state).awaitTermination()
    return sorted((r["s"], r["g"]) for r in ingest.read_graphs(spark, out).collect())


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "state")]


def test_a_stream_replaces_whole_graphs_and_resumes(spark, folders):
    source = folders[0]
    ingest.deliver(quads(spark, [("s1", "g1"), ("s2", "g2")]), source, "2024-01-01")
    assert run(spark, *folders) == [("s1", "g1"), ("s2", "g2")]
    ingest.deliver(quads(spark, [("s3", "g2")]), source, "2024-02-01")
    assert run(spark, *folders) == [("s1", "g1"), ("s3", "g2")]
    assert ingest.vacuum(spark, folders[1]) == 1 and run(spark, *folders) == [("s1", "g1"), ("s3", "g2")]


def test_a_graph_over_many_batches_keeps_all_its_rows(spark, folders):
    rows = [(f"s{k}", "g") for k in range(8)]
    ingest.deliver(quads(spark, rows).repartition(4), folders[0], "1")
    assert run(spark, *folders, files=1) == rows
    ingest.deliver(quads(spark, rows[:3]).repartition(3), folders[0], "2")
    assert run(spark, *folders, files=1) == rows[:3]


def test_a_graph_is_seen_only_when_it_is_whole(spark, folders):
    ingest.deliver(quads(spark, [("old", "g")]), folders[0], "1")
    assert run(spark, *folders) == [("old", "g")]
    quads(spark, [("new", "g")]).write.parquet(f"{folders[0]}/quads/delivery=2")
    assert run(spark, *folders) == [("old", "g")]
    assert [(r["delivery"], r["n"], r["declared"]) for r in ingest.waiting(spark, folders[1]).collect()] == [("2", 1, None)]
    spark.createDataFrame([("g", 1)], "g string, n bigint").write.parquet(f"{folders[0]}/declared/delivery=2")
    assert run(spark, *folders) == [("new", "g")] and ingest.waiting(spark, folders[1]).isEmpty()


@pytest.mark.parametrize("after", ["rows", "state", "pointer"])
def test_a_stream_that_is_stopped_in_a_batch_loses_and_doubles_nothing(spark, folders, monkeypatch, after):
    rows = [(f"s{k}", "g") for k in range(8)]
    ingest.deliver(quads(spark, rows).repartition(4), folders[0], "1")
    keep, advance = ingest._keep, ingest.pointer.advance

    def broken(batch, number, path):
        if number != 2:
            return keep(batch, number, path)
        if after == "pointer":
            keep(batch, number, path)
            raise RuntimeError("stopped")
        target, name = (ingest.pointer, "latest") if after == "rows" else (ingest.pointer, "advance")

        def stop(*_):
            raise RuntimeError("stopped")

        with monkeypatch.context() as m:
            m.setattr(target, name, stop)
            keep(batch, number, path)

    monkeypatch.setattr(ingest, "_keep", broken)
    with pytest.raises(StreamingQueryException):
        run(spark, *folders, files=1)
    monkeypatch.setattr(ingest, "_keep", keep)
    assert ingest.pointer.advance is advance
    assert run(spark, *folders, files=1) == rows
    assert len(os.listdir(f"{folders[1]}/versions")) <= 3


def test_calls_per_minute_on_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("c", at + datetime.timedelta(seconds=s)) for s in (0, 10, 59, 60)] + [("d", at + datetime.timedelta(hours=1))]
    spark.createDataFrame(rows, "client string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "calls"))
    query = usage.calls_per_minute(stream).writeStream.format("memory").queryName("calls").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["client"], r["minute"].minute, r["minute"].hour): r["calls"] for r in spark.sql("select * from calls").collect()}
    assert got == {("c", 0, 0): 3, ("c", 1, 0): 1, ("d", 0, 1): 1}
    over = usage.over_limit(spark.read.parquet(str(tmp_path / "calls")), 2).collect()
    assert [(r["client"], r["refused"]) for r in over] == [("c", 1)]

"""Streams over a folder of Parquet give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.operators import state
from recallforge.streaming import streams
from tests.compare import SF


def _stream(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _run(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table("t").collect()


def test_reconcile_equals_batch(spark, tmp_path):
    s = M.states(spark, SF).withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {(r.node_id, r.prev_id, r.relation) for r in _run(streams.reconcile(_stream(spark, s, tmp_path / "in")), tmp_path)}
    want = {(r.node_id, r.prev_id, r.relation) for r in state.reconcile(s).collect()}
    assert got == want


def test_dedup(spark, tmp_path):
    d = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.text for r in _run(streams.dedup(_stream(spark, d, tmp_path / "in"), "text", "ts"), tmp_path)) == ["a", "b"]


def test_episodes_close(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00"), (1, "2024-01-01 10:00"), (1, "2024-01-05 00:00"), (2, "2024-01-09 00:00")]
    d = spark.createDataFrame(rows, "u long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(streams.episodes(_stream(spark, d, tmp_path / "in"), ["u"], "ts"), tmp_path)
    assert sorted((r.u, r.members) for r in got) == [(1, 1), (1, 2)]


def test_announce_and_heartbeat(spark, tmp_path):
    a = spark.createDataFrame([("x", ["db:main"]), ("y", ["*"])], "sender string, announced array<string>")
    subs = spark.createDataFrame([("x", ["db"]), ("z", ["db"]), ("w", []), ("v", ["*"])], "subscriber string, wanted array<string>")
    got = {(r.sender, r.subscriber) for r in _run(streams.announce(_stream(spark, a, tmp_path / "in"), subs), tmp_path)}
    assert got == {("x", "z"), ("x", "w"), ("y", "w"), ("y", "v")}
    h = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00")], "agent string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    off = _run(streams.heartbeats(_stream(spark, h, tmp_path / "in2"), "agent", "ts"), tmp_path / "h")
    assert [r.agent for r in off] == ["a"]


def test_index_sink(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,)], "id long")
    seen = []
    q = streams.index_sink(_stream(spark, d, tmp_path / "in"), str(tmp_path / "cp"), lambda b, n: seen.append(b.count()), once=True)
    q.awaitTermination(60)
    assert sum(seen) == 2

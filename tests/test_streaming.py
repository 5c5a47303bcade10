"""Streams run to the end of their input."""

from pyspark.sql import functions as F

from tessera.sources.versioned import VersionedTable
from tessera.streaming import StreamingFrame, StreamWriter, count_window_processor, match_processor
from tessera.streaming.frame import LateSplitter, memory_stream, run_once

SCHEMA = "k bigint, ts bigint, v double, stage string"


def batches(spark, *parts):
    return [spark.createDataFrame(p, SCHEMA) for p in parts]


def test_windows_close_by_watermark(spark, tmp_path):
    stream = memory_stream(batches(spark, [(1, 0, 1.0, "a"), (1, 500, 2.0, "a")], [(1, 5000, 4.0, "a")], [(1, 6000, 1.0, "a")], [(1, 100, 9.0, "late")], [(1, 9000, 1.0, "a")]), f"file://{tmp_path}/in")
    out = StreamingFrame(stream).with_event_time("ts").with_watermark(0).key_by("k").tumbling_window(1000).aggregate(F.sum("v").alias("s"))
    rows = run_once(out, f"file://{tmp_path}/ck")
    assert {(r["window_start_ms"], r["s"]) for r in rows} >= {(0, 3.0), (5000, 4.0)}
    assert all(r["s"] != 12.0 for r in rows)


def test_sessions_a_gap_apart_are_separate(spark, tmp_path):
    stream = memory_stream(batches(spark, [(1, 0, 1.0, "a"), (1, 999, 1.0, "a"), (1, 1999, 1.0, "a")], [(1, 50_000, 1.0, "a")]), f"file://{tmp_path}/in")
    out = StreamingFrame(stream, "ts", 0, ("k",)).session_window(1000).aggregate(F.count(F.lit(1)).alias("n"))
    rows = run_once(out, f"file://{tmp_path}/ck")
    assert {(r["window_start_ms"], r["window_end_ms"], r["n"]) for r in rows} == {(0, 1999, 2), (1999, 2999, 1)}


def test_count_windows_and_patterns_keep_state(spark, tmp_path):
    parts = batches(spark, [(1, 0, 1.0, "a"), (1, 1, 2.0, "x")], [(1, 2, 3.0, "b"), (1, 3, 4.0, "a")])
    rows = run_once(count_window_processor(memory_stream(parts, f"file://{tmp_path}/a"), "k", "v", 3), f"file://{tmp_path}/cka")
    assert [(r["window_index"], r["n"], r["total"]) for r in rows] == [(0, 3, 6.0)]
    rows = run_once(match_processor(memory_stream(parts, f"file://{tmp_path}/b"), "k", "ts", "stage", ["a", "b"], 1000), f"file://{tmp_path}/ckb")
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(0, 2)]


def test_late_rows_go_to_the_side(spark, tmp_path):
    main, side = [], []
    split = LateSplitter("ts", 0, 0, lambda d, n: main.extend(r.ts for r in d.collect()), lambda d, n: side.extend(r.ts for r in d.collect()))
    stream = memory_stream(batches(spark, [(1, 1000, 1.0, "a")], [(1, 5, 1.0, "a"), (1, 2000, 1.0, "a")]), f"file://{tmp_path}/in")
    StreamWriter(stream).foreach_batch(split).checkpoint(f"file://{tmp_path}/ck").trigger("available_now").start().awaitTermination()
    assert main == [1000, 2000] and side == [5] and split.late_rows == 1


def test_upsert_sink(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["k"])
    stream = memory_stream(batches(spark, [(1, 1, 1.0, "a"), (2, 1, 1.0, "a")], [(1, 2, 7.0, "b")]), f"file://{tmp_path}/in")
    StreamWriter(stream).upsert(table, "ts").checkpoint(f"file://{tmp_path}/ck").trigger("available_now").start().awaitTermination()
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, 7.0), (2, 1.0)}


def test_queries_are_reported_and_their_state_can_be_read(spark, tmp_path):
    from tessera.streaming.delivery import QueryManager, read_state, state_metadata
    from tessera.streaming.frame import memory_stream

    manager = QueryManager(spark)
    try:
        df = memory_stream([spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")], f"file://{tmp_path}/in")
        q = df.groupBy("k").count().writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"file://{tmp_path}/ck").start()
        assert manager.get("counted").id == q.id and q.id in {x.id for x in manager.active()}
        q.processAllAvailable()
        q.stop()
        assert manager.wait_for("terminated", str(q.id)) and {e["kind"] for e in manager.events} == {"started", "progress", "terminated"}
        assert {(r.key.k, r.value["count"]) for r in read_state(spark, f"file://{tmp_path}/ck").collect()} == {(1, 2), (2, 2), (3, 1)}
        assert state_metadata(spark, f"file://{tmp_path}/ck").count() == 1
    finally:
        manager.close()


def test_slow_source_holds_the_watermark_back(spark, tmp_path):
    from tessera.streaming.delivery import union_streams
    from tessera.streaming.frame import StreamingFrame, memory_stream, run_once

    day = 86_400_000
    fast = memory_stream([spark.createDataFrame([(t * day, "f")], "ms long, s string") for t in (1, 10, 20)], f"file://{tmp_path}/fast")
    slow = memory_stream([spark.createDataFrame([(t * day, "s")], "ms long, s string") for t in (1, 2, 3)], f"file://{tmp_path}/slow")
    both = union_streams([StreamingFrame(fast, "ms", 0), StreamingFrame(slow, "ms", 0)])
    assert len(run_once(both.df, f"file://{tmp_path}/ck")) == 6


def test_registry_messages(spark):
    from tessera.streaming.delivery import decode_registered

    rows = [(bytes([0, 0, 0, 0, 7]) + b'{"a": 1}',), (bytes([0, 0, 0, 1, 8]) + b'{"a": 2, "b": "x"}',), (bytes([0, 0, 0, 0, 9]) + b"{}",), (b"plain",), (None,)]
    got = decode_registered(spark.createDataFrame(rows, "value binary"), "value", {7: "a INT", 264: "a INT, b STRING"}).collect()
    assert [None if r.decoded is None else (r.decoded.a, r.decoded.b) for r in got] == [(1, None), (2, "x"), None, None, None]


def test_window_statements(spark):
    import pytest

    from tessera.streaming.frame import compile_window_sql

    spec = compile_window_sql("SELECT k, sum(v) AS s FROM src GROUP BY k, HOP(ts, INTERVAL '5' MINUTE, INTERVAL '1' HOUR)")
    assert spec.window == ("sliding", 3_600_000, 300_000) and spec.keys == ("k",) and spec.source == "src"
    assert compile_window_sql("SELECT count(*) AS n FROM src GROUP BY SESSION(ts, INTERVAL '10' SECOND)").window == ("session", 10_000)
    for bad in ("SELECT 1", "SELECT k, sum(v) AS s FROM src GROUP BY k", "SELECT sum(v) FROM src GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)", "SELECT sum(v) AS s FROM src GROUP BY HOP(ts, INTERVAL '1' HOUR)", "SELECT sum(v) AS s FROM src GROUP BY TUMBLE(ts, 5)"):
        with pytest.raises(ValueError):
            compile_window_sql(bad)

"""Event-time operators, bounded and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cep, events
from tessera.storage import materialize, state_path

from .registry import register, table

DF, S = DataFrame, SparkSession
HOUR = 3_600_000
_MS = "epoch_us(ts) // 1000"
_E = f"(SELECT event_id, user_id, event_type, value, {_MS} AS ms FROM events)"


def timed(spark: S, d: str) -> DF:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", events.epoch_ms(F.col("ts")).alias("ms"))



def _aggs() -> tuple:
    return F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")


@register("window_tumbling", f"SELECT user_id, ms - ms % {HOUR} AS window_start_ms, ms - ms % {HOUR} + {HOUR} AS window_end_ms, count(*) AS n, round(sum(value), 2) AS total FROM {_E} GROUP BY 1, 2, 3")
def window_tumbling(spark: S, d: str) -> DF:
    return events.tumbling(timed(spark, d), "ms", HOUR, ["user_id"], *_aggs())


@register("window_sliding", f"SELECT event_type, ms - ms % 1800000 - i * 1800000 AS window_start_ms, ms - ms % 1800000 - i * 1800000 + {HOUR} AS window_end_ms, count(*) AS n, round(sum(value), 2) AS total FROM {_E}, range(2) t(i) GROUP BY 1, 2, 3")
def window_sliding(spark: S, d: str) -> DF:
    return events.sliding(timed(spark, d), "ms", HOUR, 1_800_000, ["event_type"], *_aggs())


@register(
    "window_session",
    f"""
    WITH e AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS away FROM {_E}),
    s AS (SELECT *, sum(CASE WHEN away IS NULL OR away >= 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM e)
    SELECT user_id, min(ms) AS window_start_ms, max(ms) + 1800000 AS window_end_ms, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k
    """,
)
def window_session(spark: S, d: str) -> DF:
    return events.sessions(timed(spark, d), "ms", 1_800_000, ["user_id"], *_aggs())


@register("window_count", f"SELECT user_id, i // 5 AS window_index, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i FROM {_E}) GROUP BY 1, 2")
def window_count(spark: S, d: str) -> DF:
    out = events.count_windows(timed(spark, d), ["ms", "event_id"], 5, ["user_id"], *_aggs())
    return out.withColumn("window_index", F.col("window_index").cast("long"))


@register("interval_join", f"SELECT a.event_id AS a, b.event_id AS b FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ms - a.ms BETWEEN -60000 AND 3600000")
def interval_join(spark: S, d: str) -> DF:
    e = timed(spark, d)
    out = events.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ms", "ms", -60_000, HOUR)
    return out.select(F.col("event_id").alias("a"), F.col("r_event_id").alias("b"))


@register("window_join", f"SELECT a.event_id AS a, b.event_id AS b FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'error' AND abs(b.ms - a.ms) <= 600000")
def window_join(spark: S, d: str) -> DF:
    e = timed(spark, d)
    out = events.window_join(e.where("event_type = 'view'"), e.where("event_type = 'error'"), "user_id", "ms", "ms", 600_000)
    return out.select(F.col("event_id").alias("a"), F.col("r_event_id").alias("b"))


_STREAM = f"(SELECT event_id, user_id, ms FROM {_E} WHERE event_type = 'purchase')"
_VERSIONS = f"(SELECT user_id, ms, max(event_id) AS v FROM {_E} WHERE event_type = 'signup' GROUP BY 1, 2)"


def _as_of(spark: S, d: str, how: str, keys: tuple[str, ...] = ("user_id",), slots: int | None = None) -> DF:
    e = timed(spark, d)
    stream = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms")
    versions = e.where("event_type = 'signup'").groupBy("user_id", "ms").agg(F.max("event_id").alias("v"))
    out = events.as_of_join(stream, versions, keys, "ms", "ms", how, slots=slots)
    return out.select("event_id", F.col("v_v").alias("v")) if keys else out.select("event_id", F.col("v_ms").alias("at"))


@register("temporal_join_inner", f"SELECT s.event_id, t.v FROM {_STREAM} s ASOF JOIN {_VERSIONS} t ON s.user_id = t.user_id AND s.ms >= t.ms")
def temporal_inner(spark: S, d: str) -> DF:
    return _as_of(spark, d, "inner")


@register("temporal_join_left", f"SELECT s.event_id, t.v FROM {_STREAM} s ASOF LEFT JOIN {_VERSIONS} t ON s.user_id = t.user_id AND s.ms >= t.ms")
def temporal_left(spark: S, d: str) -> DF:
    return _as_of(spark, d, "left")


@register("temporal_join_slots", f"SELECT s.event_id, t.v FROM {_STREAM} s ASOF LEFT JOIN {_VERSIONS} t ON s.user_id = t.user_id AND s.ms >= t.ms")
def temporal_slots(spark: S, d: str) -> DF:
    return _as_of(spark, d, "left", slots=40)


@register("temporal_join_no_key", f"SELECT s.event_id, t.ms AS at FROM {_STREAM} s ASOF LEFT JOIN (SELECT DISTINCT ms FROM {_VERSIONS}) t ON s.ms >= t.ms")
def temporal_no_key(spark: S, d: str) -> DF:
    return _as_of(spark, d, "left", keys=())


@register("late_side_output", f"SELECT event_id, ms < 1705000000000 AS late FROM {_E}")
def late_side_output(spark: S, d: str) -> DF:
    on_time, late = events.split_late(timed(spark, d), "ms", 1_705_000_000_000)
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@register("first_event_of_key", f"SELECT user_id, event_type, arg_min(event_id, ms * 1000000 + event_id) AS event_id FROM {_E} GROUP BY 1, 2")
def first_event(spark: S, d: str) -> DF:
    return events.first_per_key(timed(spark, d), ["user_id", "event_type"], ["ms", "event_id"]).select("user_id", "event_type", "event_id")


@register(
    "match_recognize",
    f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM {_E})
    SELECT user_id, event_id, i // 3 AS match_id, (i % 3)::INT AS match_stage FROM n WHERE i // 3 < c // 3
    """,
)
def match_recognize(spark: S, d: str) -> DF:
    out = cep.match_any(timed(spark, d), "user_id", "ms", 3, within_ms=10**12, ties=["event_id"])
    return out.select("user_id", "event_id", "match_id", "match_stage")


def _limited(within: int) -> str:
    """SQL of the same with a limit, one row of each key at a time."""
    new = f"s.cnt = 3 OR n.ms - s.start > {within}"
    return f"""
    WITH RECURSIVE n AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM {_E}),
    s AS (
        SELECT user_id, i, event_id, ms AS start, i AS head, 1 AS cnt FROM n WHERE i = 1
        UNION ALL
        SELECT n.user_id, n.i, n.event_id, CASE WHEN {new} THEN n.ms ELSE s.start END, CASE WHEN {new} THEN n.i ELSE s.head END, CASE WHEN {new} THEN 1 ELSE s.cnt + 1 END
        FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1),
    m AS (SELECT user_id, head FROM s WHERE cnt = 3)
    SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY head) - 1 AS match_id, (i - head)::INT AS match_stage FROM s JOIN m USING (user_id, head)
    """


@register("match_recognize_within", _limited(30 * HOUR))
def match_recognize_within(spark: S, d: str) -> DF:
    out = cep.match_any(timed(spark, d), "user_id", "ms", 3, within_ms=30 * HOUR, ties=["event_id"])
    return out.select("user_id", "event_id", "match_id", "match_stage")


_GONE = f"(CASE WHEN s.nxt > 0 AND n.ms - s.start > {24 * HOUR} THEN 0 ELSE s.nxt END)"


@register(
    "match_stages",
    f"""
    WITH RECURSIVE e AS (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS k FROM {_E}),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e WHERE k IS NOT NULL),
    s AS (
        SELECT user_id, i, event_id, k, CASE WHEN k = 0 THEN 1 ELSE 0 END AS nxt, ms AS start, i AS head, k = 0 AS taken FROM n WHERE i = 1
        UNION ALL
        SELECT n.user_id, n.i, n.event_id, n.k,
               CASE WHEN {_GONE} = n.k THEN (n.k + 1) % 3 ELSE {_GONE} END,
               CASE WHEN {_GONE} = 0 THEN n.ms ELSE s.start END, CASE WHEN {_GONE} = 0 THEN n.i ELSE s.head END, {_GONE} = n.k
        FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1),
    m AS (SELECT user_id, head FROM s WHERE taken AND k = 2)
    SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY head) - 1 AS match_id, k::INT AS match_stage FROM s JOIN m USING (user_id, head) WHERE taken
    """,
)
def match_stages(spark: S, d: str) -> DF:
    pattern = cep.Pattern.begin("view").followed_by("click").followed_by("purchase").within(24 * HOUR)
    return cep.match_stages(timed(spark, d), "user_id", "ms", "event_type", pattern, ties=["event_id"]).select("user_id", "event_id", "match_id", "match_stage")


# the same as streams, run until their input ends


def _stream(spark: S, d: str):
    """Events as a bounded stream of two batches in time order, as many files each as tasks run at a time."""
    from tessera.streaming.frame import StreamingFrame, file_stream

    e = timed(spark, d)
    path = state_path(spark, "stream")
    edge, n = 1_705_276_800_000, spark.sparkContext.defaultParallelism
    e.where(F.col("ms") < edge).repartition(n).write.mode("append").parquet(path)
    e.where(F.col("ms") >= edge).repartition(n).write.mode("append").parquet(path)
    return StreamingFrame(file_stream(spark, path, e.schema, files_per_trigger=n), "ms", 60 * 24 * HOUR, ("user_id",))


def _finish(df: DF, mode: str) -> DF:
    """All output of a stream run to its end, as a table in shared storage."""
    spark = df.sparkSession
    out, state = state_path(spark, "stream-out"), state_path(spark, "stream-state")
    schema = df.schema

    def write(batch: DF, n: int) -> None:
        batch.write.mode("append").parquet(f"{out}/{n}" if mode == "append" else f"{out}/{n:06d}")

    df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    from tessera.storage import filesystem

    fs, p = filesystem(spark, out)
    last = max(s.getPath().getName() for s in fs.listStatus(p))
    return spark.read.schema(schema).parquet(f"{out}/{last}")


@register("stream_tumble_complete", f"SELECT user_id, ms - ms % {24 * HOUR} AS window_start_ms, ms - ms % {24 * HOUR} + {24 * HOUR} AS window_end_ms, count(*) AS n, round(sum(value), 2) AS total FROM {_E} GROUP BY 1, 2, 3")
def stream_tumble(spark: S, d: str) -> DF:
    return _finish(_stream(spark, d).tumbling_window(24 * HOUR).aggregate(*_aggs()), "complete")


@register("stream_sliding_complete", f"SELECT user_id, ms - ms % {12 * HOUR} - i * {12 * HOUR} AS window_start_ms, ms - ms % {12 * HOUR} - i * {12 * HOUR} + {24 * HOUR} AS window_end_ms, count(*) AS n, round(sum(value), 2) AS total FROM {_E}, range(2) t(i) GROUP BY 1, 2, 3")
def stream_sliding(spark: S, d: str) -> DF:
    return _finish(_stream(spark, d).sliding_window(24 * HOUR, 12 * HOUR).aggregate(*_aggs()), "complete")


@register("stream_filter_append", f"SELECT event_id, value FROM {_E} WHERE event_type = 'purchase' AND value > 10")
def stream_filter(spark: S, d: str) -> DF:
    return _finish(_stream(spark, d).filter("event_type = 'purchase' AND value > 10").select("event_id", "value").df, "append")


@register("stream_dedup", f"SELECT DISTINCT user_id, event_type FROM {_E}")
def stream_dedup(spark: S, d: str) -> DF:
    return _finish(_stream(spark, d).drop_duplicates("user_id", "event_type", within_watermark=False).select("user_id", "event_type"), "append")


@register("stream_interval_join", f"SELECT a.event_id AS a, b.event_id AS b FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error' AND b.ms - a.ms BETWEEN 0 AND 3600000")
def stream_interval_join(spark: S, d: str) -> DF:
    s = _stream(spark, d)
    out = s.filter("event_type = 'signup'").interval_join(s.filter("event_type = 'error'"), 0, HOUR)
    return _finish(out.select(F.col("event_id").alias("a"), F.col("r_event_id").alias("b")), "append")


@register("stream_vs_batch_total", f"SELECT event_type, count(*) AS n FROM {_E} GROUP BY 1")
def stream_totals(spark: S, d: str) -> DF:
    s = _stream(spark, d)
    return materialize(_finish(s.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete"), "totals")


@register("stream_two_phase", f"SELECT event_id, user_id FROM {_E} WHERE value > 10")
def stream_two_phase(spark: S, d: str) -> DF:
    """Epochs that are delivered twice are there once."""
    from tessera.streaming.delivery import TwoPhaseParquetSink

    sink = TwoPhaseParquetSink(state_path(spark, "two-phase"))
    df = _stream(spark, d).filter("value > 10").select("event_id", "user_id").df

    def twice(batch: DF, epoch: int) -> None:
        sink.prepare(batch, epoch)  # a first try that ends before its commit
        sink(batch, epoch)
        sink(batch, epoch)

    df.writeStream.foreachBatch(twice).option("checkpointLocation", state_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark)


@register("stream_of_table", f"SELECT user_id, count(*) AS n FROM {_E} WHERE value > 5 GROUP BY 1")
def stream_of_table(spark: S, d: str) -> DF:
    """A table's versions as a stream of changes, added up; a deletion comes as negative weights."""
    from tessera.ivm import ZSet
    from tessera.sources.versioned import VersionedTable
    from tessera.streaming.delivery import TableStream

    e = timed(spark, d).select("event_id", "user_id", "value")
    t = VersionedTable(spark, state_path(spark, "followed"))
    stream, got = TableStream(t, state_path(spark, "followed-at")), []
    t.append(e.where("value < 50"))
    stream.run(lambda df, v: got.append(df))
    t.append(e.where("value >= 50"))
    t.delete("value <= 5")
    stream.run(lambda df, v: got.append(df))
    stream.run(lambda df, v: got.append(df))
    whole = got[0]
    for df in got[1:]:
        whole = whole.unionByName(df)
    return ZSet(whole).consolidate().df.groupBy("user_id").agg(F.sum("_weight").alias("n"))


@register("streaming_table_sql", f"SELECT event_type, user_id, event_id FROM {_E} WHERE event_type <> 'error'")
def streaming_table_sql(spark: S, d: str) -> DF:
    from tessera.session import Engine

    e, events_ = Engine(spark, lake=state_path(spark, "lake")), timed(spark, d).select("event_type", "user_id", "event_id", "value")
    path = state_path(spark, "arriving")
    events_.where("value < 50").write.mode("append").parquet(path)
    e.register_stream("arriving", path, events_.schema)
    e.sql("CREATE STREAMING TABLE kept AS SELECT event_type, user_id, event_id FROM arriving WHERE event_type <> 'error'")
    events_.where("value >= 50").write.mode("append").parquet(path)
    e.sql("REFRESH STREAMING TABLE kept; REFRESH STREAMING TABLE kept")
    return e.sql("SELECT * FROM kept")


@register("stream_early_fire", f"SELECT user_id, ms - ms % {24 * HOUR} AS window_start_ms, count(*) AS n FROM {_E} GROUP BY 1, 2")
def stream_early_fire(spark: S, d: str) -> DF:
    """Open windows report at every trigger; the last report of each is its result."""
    from tessera.streaming.frame import StreamWriter

    out = state_path(spark, "early")
    df = _stream(spark, d).tumbling_window(24 * HOUR).aggregate(F.count(F.lit(1)).alias("n"))
    writer = StreamWriter(df).early_fire().checkpoint(state_path(spark, "stream-state")).trigger("available_now")
    writer.foreach_batch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start().awaitTermination()
    got = spark.read.parquet(out)
    last = got.groupBy("user_id", "window_start_ms").agg(F.max_by("n", "batch").alias("n"))
    return last.select("user_id", "window_start_ms", "n")


@register("stream_push_poll", f"SELECT event_type, count(*) AS n FROM {_E} WHERE value > 10 GROUP BY 1")
def stream_push_poll(spark: S, d: str) -> DF:
    """Batches pushed by hand; a job opened anew polls what the first left."""
    from tessera.streaming.delivery import ContinuousJob

    e, path = timed(spark, d).select("event_type", "value"), state_path(spark, "job")
    made = lambda: ContinuousJob(spark, path, e.schema, lambda df: df.where("value > 10").select("event_type"))
    job = made()
    job.push(e.where("value < 50"))
    first = job.poll()
    job.push(e.where("value >= 50"))
    second = made().poll()
    return first.unionByName(second).unionByName(made().poll()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_checked", f"SELECT event_id, value > 100 AS broken FROM {_E}")
def stream_checked(spark: S, d: str) -> DF:
    from tessera.operators.quality import Rule
    from tessera.streaming.frame import StreamWriter

    out = state_path(spark, "checked")
    df = _stream(spark, d).df.select("event_id", "value")
    put = lambda broken: lambda batch, n: batch.select("event_id", F.lit(broken).alias("broken")).write.mode("append").parquet(out)
    w = StreamWriter(df).checked([Rule("high", "value", "range", "reject", None, 100.0)], put(False), put(True))
    w.checkpoint(state_path(spark, "stream-state")).trigger("available_now").start().awaitTermination()
    return spark.read.parquet(out)


@register("window_sql_compiled", f"SELECT user_id, ms - ms % {24 * HOUR} AS window_start_ms, count(*) AS n, round(sum(value), 2) AS total FROM {_E} WHERE value > 5 GROUP BY 1, 2 HAVING count(*) > 1")
def window_sql_compiled(spark: S, d: str) -> DF:
    """A windowed statement as a stream: compiled, run to its end, filtered by its HAVING."""
    from tessera.streaming.frame import compile_window_sql

    spec = compile_window_sql("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 5 GROUP BY user_id, TUMBLE(ms, INTERVAL '1' DAY) HAVING n > 1")
    return _finish(spec.apply(_stream(spark, d).df), "complete").select("user_id", "window_start_ms", "n", "total")

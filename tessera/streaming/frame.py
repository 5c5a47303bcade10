"""Streams with an event time, a key, one window and their writers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "__event_time"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """A stream over files that arrive in a folder; ``files_per_trigger`` limits the rate."""
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def memory_stream(batches: Sequence[DataFrame], path: str) -> DataFrame:
    """A bounded stream of the given batches, one file each, in their order."""
    spark = batches[0].sparkSession
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, batches[0].schema, files_per_trigger=1)


class StreamingFrame:
    """A DataFrame, bounded or not, with its event time, key, watermark and window.

    The event time is a column of epoch milliseconds or a timestamp.  Rows later
    than the watermark of the batch before are dropped by stateful operators.
    """

    def __init__(self, df: DataFrame, event_time: str | None = None, lag_ms: int = 0, key: Sequence[str] = (), window: tuple | None = None, zone: str | None = None):
        self.df, self.event_time, self.lag_ms, self.key, self.window, self.zone = df, event_time, lag_ms, tuple(key), window, zone

    def _with(self, **changes) -> StreamingFrame:
        state = {"df": self.df, "event_time": self.event_time, "lag_ms": self.lag_ms, "key": self.key, "window": self.window, "zone": self.zone}
        return StreamingFrame(**(state | changes))

    def with_event_time(self, column: str) -> StreamingFrame:
        return self._with(event_time=column)

    def with_watermark(self, lag_ms: int, allowed_lateness_ms: int = 0) -> StreamingFrame:
        return self._with(lag_ms=lag_ms + allowed_lateness_ms)

    def key_by(self, *columns: str) -> StreamingFrame:
        return self._with(key=columns)

    def tumbling_window(self, size_ms: int) -> StreamingFrame:
        return self._with(window=("tumbling", size_ms))

    def sliding_window(self, size_ms: int, slide_ms: int) -> StreamingFrame:
        return self._with(window=("sliding", size_ms, slide_ms))

    def session_window(self, gap_ms: int) -> StreamingFrame:
        return self._with(window=("session", gap_ms))

    def window_timezone(self, zone: str) -> StreamingFrame:
        """Windows follow civil time of a zone; the watermark stays in UTC."""
        return self._with(zone=zone)

    def filter(self, condition: str | Column) -> StreamingFrame:
        return self._with(df=self.df.where(condition))

    def select(self, *columns: str | Column) -> StreamingFrame:
        return self._with(df=self.df.select(*columns))

    def map_batches(self, f: Callable, schema) -> StreamingFrame:
        """``f`` maps an iterator of pandas frames."""
        return self._with(df=self.df.mapInPandas(f, schema))

    def timed(self) -> DataFrame:
        """With the event time as a timestamp and its watermark."""
        kind = dict(self.df.dtypes)[self.event_time]
        at = F.timestamp_millis(F.col(self.event_time)) if kind in ("bigint", "int") else F.col(self.event_time).cast("timestamp")
        return self.df.withColumn(EVENT, at).withWatermark(EVENT, f"{self.lag_ms} milliseconds")

    def aggregate(self, *aggs: Column) -> DataFrame:
        """(key, window_start_ms, window_end_ms, aggregates) of the window."""
        df, (kind, *sizes) = self.timed(), self.window
        at = F.from_utc_timestamp(F.col(EVENT), self.zone) if self.zone else F.col(EVENT)
        if kind == "session":
            # sessions exactly a gap apart are separate
            w = F.session_window(at, f"{sizes[0] - 1} milliseconds")
        else:
            w = F.window(at, *[f"{s} milliseconds" for s in sizes])
        out = df.groupBy(*self.key, w.alias("__w")).agg(*aggs)
        end = F.unix_millis("__w.end") + (1 if kind == "session" else 0)
        names = [c for c in out.columns if c not in (*self.key, "__w")]
        return out.select(*self.key, F.unix_millis("__w.start").alias("window_start_ms"), end.alias("window_end_ms"), *names)

    def drop_duplicates(self, *subset: str, within_watermark: bool = True) -> DataFrame:
        """The first row of each combination; with ``within_watermark`` its memory ends with the watermark."""
        df = self.timed()
        out = df.dropDuplicatesWithinWatermark(list(subset)) if within_watermark and df.isStreaming else df.dropDuplicates(list(subset))
        return out.drop(EVENT)

    def interval_join(self, other: StreamingFrame, lower_ms: int, upper_ms: int, how: str = "inner") -> DataFrame:
        """Pairs of equal keys with lower <= other's time - own time <= upper; other's columns get the prefix r_."""
        left = self.timed()
        right = other.timed().select(*[F.col(c).alias(f"r_{c}") for c in (*other.df.columns, EVENT)])
        cond = F.col(f"r_{EVENT}").between(F.col(EVENT) + F.make_dt_interval(secs=F.lit(lower_ms / 1000)), F.col(EVENT) + F.make_dt_interval(secs=F.lit(upper_ms / 1000)))
        for a, b in zip(self.key, other.key, strict=True):
            cond = cond & (F.col(a) == F.col(f"r_{b}"))
        return left.join(right, cond, how)

    def window_join(self, other: StreamingFrame, within_ms: int) -> DataFrame:
        return self.interval_join(other, -within_ms, within_ms)

    def enrich(self, f: Callable, schema, concurrency: int = 16) -> DataFrame:
        """Asynchronous lookups: ``async f(row dict) -> row dict``, at most ``concurrency`` at a time in a task."""

        def run(frames):
            import asyncio

            import pandas as pd

            async def all_of(rows):
                gate = asyncio.Semaphore(concurrency)

                async def one(r):
                    async with gate:
                        return await f(r)

                return await asyncio.gather(*[one(r) for r in rows])

            for pdf in frames:
                yield pd.DataFrame(asyncio.run(all_of(pdf.to_dict("records"))))

        return self.df.mapInPandas(run, schema)

    def with_control(self, control: Callable[[], DataFrame], on: Sequence[str], write: Callable[[DataFrame, int], None]) -> StreamWriter:
        """Broadcast state: each micro-batch is joined with the control table as it is then."""
        return StreamWriter(self.df).foreach_batch(lambda df, n: write(df.join(control(), list(on), "left"), n))

    def write(self, df: DataFrame | None = None) -> StreamWriter:
        return StreamWriter(df if df is not None else self.df)


_WINDOW_SQL = re.compile(
    r"(?is)^\s*SELECT\s+(?P<list>.+?)\s+FROM\s+(?P<src>\w+)(?:\s+WHERE\s+(?P<where>.+?))?\s+GROUP\s+BY\s+(?P<by>.+?)(?:\s+HAVING\s+(?P<having>.+?))?\s*;?\s*$"
)
_WINDOW_CALL = re.compile(r"(?is)^(TUMBLE|HOP|SESSION)\s*\((.+)\)$")


@dataclass(frozen=True)
class WindowSpec:
    """What a windowed statement asks of a stream."""

    source: str
    keys: tuple[str, ...]
    event_time: str
    window: tuple
    aggregates: tuple[str, ...]
    where: str | None = None
    having: str | None = None

    def apply(self, df: DataFrame, lag_ms: int = 0) -> DataFrame:
        """(keys, window_start_ms, window_end_ms, aggregates), bounded or not."""
        rows = df.where(self.where) if self.where else df
        out = StreamingFrame(rows, self.event_time, lag_ms, self.keys, self.window).aggregate(*[F.expr(a) for a in self.aggregates])
        return out.where(self.having) if self.having else out


def compile_window_sql(sql: str) -> WindowSpec:
    """``SELECT keys, aggregates AS names FROM source GROUP BY keys, TUMBLE(ts, size)``, or HOP(ts, slide, size), or SESSION(ts, gap).

    Sizes are intervals like ``INTERVAL '1' HOUR``.  HAVING names the aggregates
    by their aliases.  Anything else is an error.
    """
    from tessera.plans import dialect

    m = _WINDOW_SQL.match(sql)
    if not m:
        raise ValueError("not a windowed aggregate")
    by = dialect.split_arguments(m["by"])
    calls = [c for b in by if (c := _WINDOW_CALL.match(b.strip()))]
    keys = tuple(b.strip() for b in by if not _WINDOW_CALL.match(b.strip()))
    if len(calls) != 1 or any(not re.fullmatch(r"\w+", k) for k in keys):
        raise ValueError("GROUP BY takes plain columns and one window")
    kind, (ts, *sizes) = calls[0][1].upper(), [a.strip() for a in dialect.split_arguments(calls[0][2])]
    ms = []
    for x in sizes:
        i = re.fullmatch(r"(?i)INTERVAL\s+'(\d+)'\s+(\w+)", x)
        if not i:
            raise ValueError(f"{x} is not an interval")
        ms.append(dialect.milliseconds(f"{i[1]} {i[2]}"))
    if len(ms) != (2 if kind == "HOP" else 1):
        raise ValueError(f"{kind} takes {2 if kind == 'HOP' else 1} intervals")
    window = {"TUMBLE": ("tumbling", *ms), "HOP": ("sliding", ms[-1], ms[0]), "SESSION": ("session", *ms)}[kind]
    items = [x.strip() for x in dialect.split_arguments(m["list"])]
    aggregates = tuple(x for x in items if x not in keys and x.lower() not in ("window_start_ms", "window_end_ms"))
    if any(not re.search(r"(?i)\)\s+AS\s+\w+$", a) for a in aggregates):
        raise ValueError("aggregates need names")
    return WindowSpec(m["src"], keys, ts, window, aggregates, m["where"], m["having"])


class LateSplitter:
    """For foreachBatch: sends rows later than the last batch's watermark, less a threshold, to a side output."""

    def __init__(self, ts: str, lag_ms: int, threshold_ms: int, main: Callable[[DataFrame, int], None], side: Callable[[DataFrame, int], None]):
        self.ts, self.lag, self.threshold, self.main, self.side = ts, lag_ms, threshold_ms, main, side
        self.newest: int | None = None
        self.late_rows = 0

    def __call__(self, df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            if not df.where(F.col(self.ts).isNull()).isEmpty():
                raise ValueError("event time is NULL")
            if self.newest is None:
                self.main(df, batch)
            else:
                edge = self.newest - self.lag - self.threshold
                late = df.where(F.col(self.ts) < edge)
                self.late_rows += late.count()
                self.main(df.where(F.col(self.ts) >= edge), batch)
                self.side(late, batch)
            top = df.agg(F.max(self.ts)).first()[0]
            if top is not None:
                self.newest = top if self.newest is None else max(self.newest, top)
        finally:
            df.unpersist()


class StreamWriter:
    """Output mode, trigger, sink; ``start`` gives Spark's StreamingQuery."""

    TRIGGERS = ("once", "available_now", "processing_time", "continuous")

    def __init__(self, df: DataFrame):
        self._w, self._df = df.writeStream, df

    def output_mode(self, mode: str) -> StreamWriter:
        self._w = self._w.outputMode(mode)
        return self

    def trigger(self, kind: str, interval: str | None = None) -> StreamWriter:
        made = {"once": {"once": True}, "available_now": {"availableNow": True}, "processing_time": {"processingTime": interval}, "continuous": {"continuous": interval}}
        self._w = self._w.trigger(**made[kind])
        return self

    def checkpoint(self, path: str) -> StreamWriter:
        self._w = self._w.option("checkpointLocation", path)
        return self

    def name(self, name: str) -> StreamWriter:
        self._w = self._w.queryName(name)
        return self

    def option(self, key: str, value) -> StreamWriter:
        self._w = self._w.option(key, value)
        return self

    def early_fire(self) -> StreamWriter:
        """Windows that are still open give what they hold at every trigger, and again when it changes."""
        return self.output_mode("update")

    def two_phase(self, path: str, partition_by: Sequence[str] = ()) -> StreamWriter:
        """Parquet by epoch, each moved into place once; see ``delivery.TwoPhaseParquetSink``."""
        from .delivery import TwoPhaseParquetSink

        return self.foreach_batch(TwoPhaseParquetSink(path, partition_by))

    def checked(self, rules, accept: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None] | None = None, report: Callable[[dict, int], None] | None = None) -> StreamWriter:
        """Quality rules on every batch: rows that break none go to ``accept``, the others, with what they break, to ``reject``."""
        from tessera.operators.quality import check

        def apply(df: DataFrame, n: int) -> None:
            good, bad, counts = check(df, rules)
            accept(good, n)
            if reject:
                reject(bad, n)
            if report:
                report(counts.first().asDict(), n)

        return self.foreach_batch(apply)

    def append_to(self, table) -> StreamWriter:
        """Append to a versioned table, each batch once: a batch's number is kept with its version."""

        def apply(df: DataFrame, n: int) -> None:
            if all(e.get("batch") != n for e in table.versions()):
                table.append(df, batch=n)

        return self.foreach_batch(apply)

    def foreach_batch(self, f: Callable[[DataFrame, int], None]) -> StreamWriter:
        self._w = self._w.foreachBatch(f)
        return self

    def consolidating(self, sink: Callable[[DataFrame, int], None]) -> StreamWriter:
        """Nets weights before the sink sees a batch."""
        from tessera.ivm.zset import ZSet

        return self.foreach_batch(lambda df, n: sink(ZSet(df).consolidate().df, n))

    def upsert(self, table, order: str, deleted: str | None = None) -> StreamWriter:
        """The last change of a key wins; the table has a key."""

        def apply(df: DataFrame, n: int) -> None:
            if not table.exists():
                table.append(df.where(F.lit(False)).drop(*([deleted] if deleted else [])))
            table.upsert(df, order, deleted)

        return self.foreach_batch(apply)

    def format(self, fmt: str) -> StreamWriter:
        self._w = self._w.format(fmt)
        return self

    def start(self, path: str | None = None) -> StreamingQuery:
        return self._w.start(path) if path else self._w.start()

    def to_table(self, name: str) -> StreamingQuery:
        return self._w.toTable(name)


def run_once(df: DataFrame, path: str, mode: str = "append") -> list[dict]:
    """Run all there is to a collecting sink and return the rows; the last batch's rows for complete mode."""
    rows: list[dict] = []

    def collect(batch: DataFrame, n: int) -> None:
        got = [r.asDict() for r in batch.collect()]
        if mode == "complete":
            rows.clear()
        rows.extend(got)

    q = df.writeStream.outputMode(mode).foreachBatch(collect).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows

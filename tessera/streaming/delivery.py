"""Exactly-once delivery, table streams, state reads and query management for Structured Streaming."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.sources.versioned import VersionedTable
from tessera.storage import filesystem, path_exists, read_text, write_text

from .frame import StreamingFrame


class TwoPhaseParquetSink:
    """For foreachBatch: an epoch's files are written aside and then moved into place at once.

    An epoch that is in place is not written again, so a batch that Spark
    replays after a failure changes nothing; what a failed try left aside is
    overwritten by the next.
    """

    def __init__(self, path: str, partition_by: Sequence[str] = ()):
        self.path, self.partition_by = path.rstrip("/"), list(partition_by)

    def prepare(self, batch: DataFrame, epoch: int) -> str:
        """Write an epoch aside; returns where."""
        staged = f"{self.path}/_staged/{epoch:012d}"
        w = batch.write.mode("overwrite")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(staged)
        return staged

    def commit(self, spark: SparkSession, epoch: int) -> bool:
        """Move an epoch into place; false if it is there already."""
        fs, staged = filesystem(spark, f"{self.path}/_staged/{epoch:012d}")
        _, final = filesystem(spark, f"{self.path}/epoch={epoch}")
        if fs.exists(final):
            fs.delete(staged, True)
            return False
        fs.mkdirs(final.getParent())
        if not fs.rename(staged, final):
            raise OSError(f"epoch {epoch} could not be moved into place")
        return True

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if not path_exists(batch.sparkSession, f"{self.path}/epoch={epoch}"):
            self.prepare(batch, epoch)
            self.commit(batch.sparkSession, epoch)

    def epochs(self, spark: SparkSession) -> list[int]:
        fs, p = filesystem(spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))

    def read(self, spark: SparkSession) -> DataFrame:
        """All committed epochs."""
        return spark.read.option("basePath", self.path).parquet(*[f"{self.path}/epoch={e}" for e in self.epochs(spark)]).drop("epoch")


class TableStream:
    """The changes of a versioned table, version by version, each handed over once.

    How far the stream has come is kept in a file beside the checkpoint; a
    version whose hand-over failed is handed over again with the same number.
    """

    def __init__(self, table: VersionedTable, checkpoint: str, start: int = -1):
        self.table, self.path = table, f"{checkpoint.rstrip('/')}/version.json"
        self.start = start

    def position(self) -> int:
        """The last version that was handed over."""
        spark = self.table.spark
        return json.loads(read_text(spark, self.path))["version"] if path_exists(spark, self.path) else self.start

    def run(self, apply: Callable[[DataFrame, int], None]) -> int:
        """Hand over what came since; the first version as inserts of all its rows.  Returns how many versions."""
        at, n = self.position(), 0
        for e in self.table.versions():
            v = e["version"]
            if v <= at:
                continue
            apply(self.table.changes(at, v) if at >= 0 else self.table.read(version=v).withColumn("_weight", F.lit(1).cast("long")), v)
            write_text(self.table.spark, self.path, json.dumps({"version": v}), overwrite=True)
            at, n = v, n + 1
        return n


def union_streams(frames: Sequence[StreamingFrame]) -> StreamingFrame:
    """Several sources as one stream whose watermark is the least of theirs, so that a slow source loses nothing."""
    spark = frames[0].df.sparkSession
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    timed = [f.timed() for f in frames]
    out = reduce(lambda a, b: a.unionByName(b), timed)
    return frames[0]._with(df=out.drop("__event_time"))


def read_state(spark: SparkSession, checkpoint: str, **options) -> DataFrame:
    """The keys and values that a query's operators hold, from its checkpoint, without stopping it."""
    return spark.read.format("statestore").options(**options).load(checkpoint)


def state_metadata(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a checkpoint."""
    return spark.read.format("state-metadata").load(checkpoint)


class QueryManager:
    """The session's streaming queries by name, and what is called when they start, progress and end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.events, self._changed = spark, [], threading.Condition()
        manager = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                manager._tell("started", str(event.id), event.name, {})

            def onQueryProgress(self, event):
                p = event.progress
                manager._tell("progress", str(p.id), p.name, {"batch": p.batchId, "rows": p.numInputRows})

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                manager._tell("terminated", str(event.id), None, {"error": event.exception})

        self._listener = Listener()
        spark.streams.addListener(self._listener)

    def _tell(self, kind: str, query: str, name: str | None, more: dict) -> None:
        with self._changed:
            self.events.append({"kind": kind, "query": query, "name": name} | more)
            self._changed.notify_all()

    def wait_for(self, kind: str, query: str, timeout: float = 30.0) -> bool:
        """Until a query's event has been reported."""
        with self._changed:
            return self._changed.wait_for(lambda: any(e["kind"] == kind and e["query"] == query for e in self.events), timeout)

    def active(self) -> list[StreamingQuery]:
        return list(self.spark.streams.active)

    def get(self, name: str) -> StreamingQuery | None:
        return next((q for q in self.active() if name in (q.name, str(q.id))), None)

    def await_any(self, timeout: float | None = None) -> bool:
        return bool(self.spark.streams.awaitAnyTermination(timeout)) if timeout is not None else self.spark.streams.awaitAnyTermination() is None

    def stop_all(self) -> None:
        for q in self.active():
            q.stop()

    def close(self) -> None:
        self.spark.streams.removeListener(self._listener)


def registry_message(value: Column | str) -> Column:
    """(schema_id, payload) of a message framed for a schema registry: a zero byte, four bytes of id, the payload; null if it isn't."""
    v = F.col(value) if isinstance(value, str) else value
    framed = (F.octet_length(v) >= 5) & (F.hex(F.substring(v, 1, 1)) == "00")
    return F.when(framed, F.struct(F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("int").alias("schema_id"), F.substring(v, 6, (1 << 31) - 1).alias("payload")))


def decode_registered(df: DataFrame, value: str, schemas: dict[int, str], into: str = "decoded") -> DataFrame:
    """JSON payloads decoded by the schema that each message names; messages of unknown schemas, or broken ones, give null.

    ``schemas`` maps ids to DDL; all must fit one result, columns of others are null.
    """
    m = df.withColumn("__m", registry_message(value))
    fields = {f.name: f.dataType.simpleString() for ddl in schemas.values() for f in _fields(ddl)}
    cases = None
    for i, ddl in schemas.items():
        own = F.from_json(F.col("__m.payload").cast("string"), ddl)
        have = {f.name for f in _fields(ddl)}
        row = F.struct(*[(own[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
        case = (F.col("__m.schema_id") == i, F.when(own.isNotNull(), row))
        cases = F.when(*case) if cases is None else cases.when(*case)
    return m.withColumn(into, cases).drop("__m")


def _fields(ddl: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(ddl).fields


class ContinuousJob:
    """A stream that is fed and read by hand: push batches, poll for what they give.

    Pushed batches are files of a folder, and a poll runs the stream until it has
    taken them all.  Everything lies under ``path``, so a job that opens the same
    path again carries on where the last one stopped: what was pushed but not
    polled is taken then, and what was polled comes no more.
    """

    def __init__(self, spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], mode: str = "append"):
        from .frame import file_stream

        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        filesystem(spark, f"{self.path}/in")[0].mkdirs(filesystem(spark, f"{self.path}/in")[1])
        self.df = build(file_stream(spark, f"{self.path}/in", schema))
        self.sink = TwoPhaseParquetSink(f"{self.path}/out")

    def push(self, batch: DataFrame) -> None:
        batch.write.mode("append").parquet(f"{self.path}/in")

    def poll(self) -> DataFrame:
        """The rows that came out since the last poll."""
        before = set(self.sink.epochs(self.spark))
        w = self.df.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.path}/checkpoint")
        w.trigger(availableNow=True).foreachBatch(self.sink).start().awaitTermination()
        new = [e for e in self.sink.epochs(self.spark) if e not in before]
        if not new:
            return self.spark.createDataFrame([], self.df.schema)
        return self.spark.read.schema(self.df.schema).parquet(*[f"{self.path}/out/epoch={e}" for e in new])

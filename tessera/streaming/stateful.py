"""Keyed state: process functions with timers, group state, count windows and pattern matching on streams.

Each is a StatefulProcessor for ``transformWithStateInPandas``, which needs the
RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_process(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema, output_mode: str = "append", time_mode: str = "none", event_time: str | None = None) -> DataFrame:
    """A process function: ``time_mode`` none, processingTime or eventTime (timers on that time)."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode=output_mode, timeMode=time_mode, eventTimeColumnName=event_time or "")


def group_state(df: DataFrame, keys: Sequence[str], f: Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterable[pd.DataFrame]], schema, state_schema, timeout: str = GroupStateTimeout.NoTimeout, output_mode: str = "update") -> DataFrame:
    """Arbitrary state of a key with update, removal and timeouts."""
    return df.groupBy(*keys).applyInPandasWithState(f, schema, state_schema, output_mode, timeout)


class CountWindow(StatefulProcessor):
    """Sums every ``size`` rows of a key, in arrival order."""

    def __init__(self, size: int, value: str, ttl_ms: int | None = None):
        self.size, self.value, self.ttl = size, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "n LONG, total DOUBLE, window LONG", self.ttl) if self.ttl else handle.getValueState("window", "n LONG, total DOUBLE, window LONG")

    def handleInputRows(self, key, rows, timerValues):
        n, total, window = self.state.get() if self.state.exists() else (0, 0.0, 0)
        out = []
        for pdf in rows:
            for v in pdf[self.value]:
                n, total = n + 1, total + float(v)
                if n == self.size:
                    out.append((*key, window, n, total))
                    n, total, window = 0, 0.0, window + 1
        self.state.update((n, total, window))
        yield pd.DataFrame(out, columns=["key", "window_index", "n", "total"])

    def close(self) -> None:
        pass


class StageMatcher(StatefulProcessor):
    """A key's partial match of a sequence of stages, carried from batch to batch."""

    def __init__(self, stages: Sequence[str], within_ms: int, ts: str, stage: str):
        self.stages, self.within, self.ts, self.stage = tuple(stages), within_ms, ts, stage

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("match", "next INT, start LONG")

    def handleInputRows(self, key, rows, timerValues):
        from tessera.operators.cep import advance

        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for pdf in rows:
            for t, s in sorted(zip(pdf[self.ts], pdf[self.stage], strict=True), key=lambda x: x[0]):
                before = state
                state, _, done = advance(state, int(t), lambda k, s=s: s == self.stages[k], len(self.stages), self.within)
                if done:
                    out.append((*key, int(before[1]) if before else int(t), int(t)))
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        yield pd.DataFrame(out, columns=["key", "start_ms", "end_ms"])

    def close(self) -> None:
        pass


def count_window_processor(df: DataFrame, key: str, value: str, size: int, key_type: str = "LONG") -> DataFrame:
    return keyed_process(df, [key], CountWindow(size, value), f"key {key_type}, window_index LONG, n LONG, total DOUBLE")


def match_processor(df: DataFrame, key: str, ts: str, stage: str, stages: Sequence[str], within_ms: int, key_type: str = "LONG") -> DataFrame:
    return keyed_process(df, [key], StageMatcher(stages, within_ms, ts, stage), f"key {key_type}, start_ms LONG, end_ms LONG")


def connected(left: DataFrame, right: DataFrame, key: str, processor: StatefulProcessor, schema) -> DataFrame:
    """Two streams into one processor with shared state: rows carry ``side`` 0 or 1 and the other side's columns as NULL."""
    from pyspark.sql import functions as F

    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return keyed_process(both, [key], processor, schema)

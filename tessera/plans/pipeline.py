"""Declarative pipelines, materialized tables and the choice of an engine."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quality import expect
from tessera.sources.versioned import VersionedTable


def infer_engine(cdc: bool = False, windowed: bool = False, unbounded: bool = False) -> str:
    """incremental for change data, streaming for windows or unbounded input, else batch."""
    return "incremental" if cdc else "streaming" if windowed or unbounded else "batch"


@dataclass
class Pipeline:
    """Sources, views, flows and sinks under one name; views run after what they read."""

    spark: SparkSession
    name: str
    mode: str = "batch"
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    views: dict[str, tuple[str, bool]] = field(default_factory=dict)
    expectations: list[tuple[str, str, str, str]] = field(default_factory=list)
    sinks: dict[str, tuple[str, Callable[[DataFrame], None]]] = field(default_factory=dict)

    def source(self, name: str, read: Callable[[], DataFrame] | DataFrame) -> Pipeline:
        self.sources[name] = read if callable(read) else lambda: read
        return self

    def view(self, name: str, sql: str, temporary: bool = False) -> Pipeline:
        self.views[name] = (sql, temporary)
        return self

    def expect(self, view: str, name: str, predicate: str, on_violation: str = "drop") -> Pipeline:
        self.expectations.append((view, name, predicate, on_violation))
        return self

    def sink(self, name: str, view: str, write: Callable[[DataFrame], None]) -> Pipeline:
        self.sinks[name] = (view, write)
        return self

    def order(self) -> list[str]:
        import re

        done, out, open_ = set(self.sources), [], dict(self.views)
        while open_:
            ready = [v for v, (sql, _) in open_.items() if not any(o != v and re.search(rf"\b{re.escape(o)}\b", sql) for o in open_)]
            if not ready:
                raise ValueError(f"views depend on each other in a circle: {sorted(open_)}")
            for v in ready:
                out.append(v)
                done.add(v)
                del open_[v]
        return out

    def validate(self) -> list[str]:
        """Problems, without running anything."""
        found = [f"expectation {n} is about unknown view {v}" for v, n, _, _ in self.expectations if v not in self.views and v not in self.sources]
        found += [f"sink {n} reads unknown view {v}" for n, (v, _) in self.sinks.items() if v not in self.views and v not in self.sources]
        try:
            self.order()
        except ValueError as e:
            found.append(str(e))
        return found

    def build(self) -> dict[str, DataFrame]:
        """All relations as lazy DataFrames, under their names as temporary views."""
        if problems := self.validate():
            raise ValueError("; ".join(problems))
        made: dict[str, DataFrame] = {}
        for name, read in self.sources.items():
            made[name] = self._expected(name, read())
            made[name].createOrReplaceTempView(name)
        for name in self.order():
            made[name] = self._expected(name, self.spark.sql(self.views[name][0]))
            made[name].createOrReplaceTempView(name)
        return made

    def _expected(self, view: str, df: DataFrame) -> DataFrame:
        for v, n, predicate, action in self.expectations:
            if v == view:
                df = expect(df, n, predicate, action)
        return df

    def run(self) -> dict[str, DataFrame]:
        """Build, write all sinks, and return the views that aren't temporary."""
        made = self.build()
        for view, write in self.sinks.values():
            write(made[view])
        return {n: made[n] for n, (_, temporary) in self.views.items() if not temporary}

    refresh = run


@dataclass
class MaterializedTable:
    """A query's result in a versioned table.

    ``full`` refreshes replace it; ``incremental`` ones append the rows whose
    change column is greater than any that the table has.
    """

    spark: SparkSession
    name: str
    query: Callable[[], DataFrame]
    table: VersionedTable
    refresh_mode: str = "full"
    change_column: str | None = None
    interval: float | None = None
    once_at: float | None = None
    history: list[dict] = field(default_factory=list)

    def due(self, now: float | None = None) -> bool:
        """By schedule: an interval, one moment, or (with neither) never by itself."""
        now = time.time() if now is None else now
        last = self.history[-1]["time"] if self.history else None
        if self.interval is not None:
            return last is None or now - last >= self.interval
        return self.once_at is not None and now >= self.once_at and last is None

    def refresh(self) -> dict:
        df = self.query()
        before = self.table.read().count() if self.table.exists() else 0
        if self.refresh_mode == "incremental" and self.table.exists():
            top = self.table.read().agg(F.max(self.change_column)).first()[0]
            fresh = df if top is None else df.where(F.col(self.change_column) > F.lit(top))
            self.table.append(fresh)
        else:
            self.table.overwrite(df)
        entry = {"time": time.time(), "version": self.table.current_version(), "rows": self.table.read().count(), "before": before}
        self.history = [*self.history, entry][-64:]
        return entry

    def read(self) -> DataFrame:
        return self.table.read()


class Memo:
    """Results by fingerprint of plan and version of the logic."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def fingerprint(text: str, version: str = "1") -> str:
        return hashlib.sha256(f"{version}\n{text}".encode()).hexdigest()

    def get(self, text: str, compute: Callable[[], DataFrame], version: str = "1") -> DataFrame:
        from tessera.storage import path_exists

        path = f"{self.folder}/{self.fingerprint(text, version)}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

"""Views kept up to date tick by tick.

A view whose SQL is one aggregate, one two-way join or one DISTINCT over its
sources, with a WHERE, is maintained from deltas; any other SQL is run again over
the changed sources and compared with its last result.  Sources, states and
results are logs: a tick writes its delta to the shared folder, and FAN logs of
one size become one of the next, so a row is rewritten a logarithmic number of
times and plans stay short.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import materialize, path_exists, read_text, state_path, write_text

from . import operators as op
from .zset import WEIGHT, ZSet


class CycleLimitExceeded(RuntimeError):
    """A recursive view went on changing after its last allowed round."""


#: So many parts of a log are put together.
FAN = 4


class Log:
    """A table as the sum of written parts; ``put`` adds a part, ``merge`` says how parts are put together."""

    def __init__(self, merge: Callable[[DataFrame], DataFrame]):
        self.merge, self.parts = merge, []  # (level, table)

    def put(self, df: DataFrame, name: str, level: int = 0) -> DataFrame:
        """Write a part; returns it."""
        part = materialize(df, name)
        self.parts.append((level, part))
        while len(self.parts) >= FAN and len({level for level, _ in self.parts[-FAN:]}) == 1:
            last = self.parts[-FAN:]
            whole = reduce(lambda a, b: a.unionByName(b), [p for _, p in last])
            self.parts[-FAN:] = [(last[0][0] + 1, materialize(self.merge(whole), name))]
        return part

    def rows(self) -> DataFrame | None:
        """All parts: what stands in several of them is to be added up."""
        return reduce(lambda a, b: a.unionByName(b), [p for _, p in self.parts]) if self.parts else None

    @classmethod
    def of(cls, merge: Callable[[DataFrame], DataFrame], df: DataFrame | None) -> Log:
        """A log that begins with a table that is written already."""
        log = cls(merge)
        if df is not None:
            log.parts.append((1 << 30, df))
        return log


def _weights(df: DataFrame) -> DataFrame:
    return ZSet(df).consolidate().df


@dataclass
class View:
    name: str
    sql: str
    sources: list[str]
    plan: tuple
    lateness: tuple[str, int] | None = None
    state: Log | None = None
    results: Log = field(default_factory=lambda: Log(_weights))
    delta: ZSet | None = None

    @property
    def result(self) -> ZSet | None:
        """The view's rows; those of several ticks are to be added up."""
        rows = self.results.rows()
        return None if rows is None else ZSet(rows)


_AGG = re.compile(r"^\s*select\s+(?P<list>.+?)\s+from\s+(?P<t>\w+)(?:\s+where\s+(?P<where>.+?))?\s+group\s+by\s+(?P<keys>[\w\s,]+?)\s*;?\s*$", re.I | re.S)
_DISTINCT = re.compile(r"^\s*select\s+distinct\s+(?P<list>[\w\s,]+?)\s+from\s+(?P<t>\w+)(?:\s+where\s+(?P<where>.+?))?\s*;?\s*$", re.I | re.S)
_JOIN = re.compile(r"^\s*select\s+(?P<list>\*|[\w\s,]+?)\s+from\s+(?P<l>\w+)\s+(?P<how>left\s+(?:outer\s+)?|inner\s+)?join\s+(?P<r>\w+)\s+using\s*\((?P<on>[\w\s,]+)\)(?:\s+where\s+(?P<where>.+?))?\s*;?\s*$", re.I | re.S)
_ITEM = re.compile(r"^(?P<f>count|sum|avg|min|max)\s*\(\s*(?P<x>\*|\w+)\s*\)\s+as\s+(?P<a>\w+)$", re.I)
_LINEAR = re.compile(r"^\s*select\s+(?P<list>\*|[\w\s,]+?)\s+from\s+(?P<t>\w+)(?:\s+where\s+(?P<where>(?:(?!\b(?:group|order|limit|having|union)\b).)+?))?\s*;?\s*$", re.I | re.S)


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def plan_view(sql: str, known: Iterable[str]) -> tuple:
    """(kind, details): ``aggregate``, ``join``, ``distinct`` or ``linear`` cost as much as the delta; ``diff`` runs all again."""
    known = set(known)
    nested = re.search(r"\bselect\b", sql[6:].lstrip(), re.I) or re.search(r"\b(having|order\s+by|limit|union|intersect|except|over)\b", sql, re.I)
    if not nested:
        if m := _DISTINCT.match(sql):
            if m["t"] in known:
                return "distinct", {"source": m["t"], "columns": _names(m["list"]), "where": m["where"]}
        elif (m := _JOIN.match(sql)) and {m["l"], m["r"]} <= known and m["l"] != m["r"]:
            return "join", {"left": m["l"], "right": m["r"], "on": _names(m["on"]), "outer": bool(m["how"] and m["how"].lower().startswith("left")), "columns": None if m["list"] == "*" else _names(m["list"]), "where": m["where"]}
        elif (m := _AGG.match(sql)) and m["t"] in known:
            keys, aggs, order = _names(m["keys"]), [], []
            for item in _names(m["list"]):
                if a := _ITEM.match(item):
                    kind = a["f"].lower()
                    kind = "count" if a["x"] == "*" else "count_col" if kind == "count" else kind
                    aggs.append(op.Agg(kind, None if a["x"] == "*" else a["x"], a["a"]))
                    order.append(a["a"])
                elif item in keys:
                    order.append(item)
                else:
                    return "diff", {}
            return "aggregate", {"source": m["t"], "keys": keys, "aggs": aggs, "columns": order, "where": m["where"]}
        elif (m := _LINEAR.match(sql)) and m["t"] in known:
            return "linear", {"source": m["t"], "columns": None if m["list"] == "*" else _names(m["list"]), "where": m["where"]}
    return "diff", {}


class IncrementalFlow:
    """Sources, views over them and over each other, and ticks."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Log] = {}
        self.schemas: dict[str, list[str]] = {}
        self.views: dict[str, View] = {}
        self.pending: dict[str, list[ZSet]] = {}
        self.ordinals: dict[str, int] = {}
        self.late: dict[str, tuple[str, int]] = {}
        self.newest: dict[str, object] = {}
        self.watchers: dict[str, list[Callable[[DataFrame], None]]] = {}

    # declaring
    def register_source(self, name: str, like: DataFrame, lateness: tuple[str, int] | None = None) -> None:
        """``lateness`` (column, allowed): rows older than the greatest value seen less ``allowed`` are dropped."""
        empty = like.where(F.lit(False)).withColumn(WEIGHT, F.lit(1).cast("long"))
        self.sources[name] = Log.of(_weights, empty)
        if lateness:
            self.late[name] = lateness

    def register_view(self, name: str, sql: str, sources: Iterable[str] | None = None) -> View:
        known = [*self.sources, *self.views]
        used = list(sources) if sources else [k for k in known if re.search(rf"\b{re.escape(k)}\b", sql)]
        if name in used:
            raise ValueError(f"view {name} refers to itself; use RecursiveView")
        view = View(name, sql, used, plan_view(sql, known))
        self.views[name] = view
        return view

    def drop_view(self, name: str) -> None:
        if any(name in v.sources for v in self.views.values()):
            raise ValueError(f"other views use {name}")
        del self.views[name]

    def watch(self, name: str, callback: Callable[[DataFrame], None]) -> None:
        self.watchers.setdefault(name, []).append(callback)

    def topological(self) -> list[View]:
        """Views after all that they use; a cycle is an error."""
        done, out, open_ = set(self.sources), [], dict(self.views)
        while open_:
            ready = [v for v in open_.values() if set(v.sources) <= done]
            if not ready:
                raise ValueError(f"views depend on each other in a circle: {sorted(open_)}")
            for v in ready:
                out.append(v)
                done.add(v.name)
                del open_[v.name]
        return out

    # feeding
    def feed(self, source: str, delta: ZSet | DataFrame) -> None:
        z = delta if isinstance(delta, ZSet) else ZSet(delta) if WEIGHT in delta.columns else ZSet.inserts(delta)
        if source in self.late:
            column, allowed = self.late[source]
            if source in self.newest:
                z = z.filter(F.col(column) >= F.lit(self.newest[source]) - allowed)
            top = z.df.agg(F.max(column)).first()[0]
            if top is not None:
                self.newest[source] = max(top, self.newest.get(source, top))
        self.pending.setdefault(source, []).append(z)

    def feed_if_advanced(self, source: str, ordinal: int, delta: ZSet | DataFrame) -> bool:
        """Ignores a batch whose ordinal isn't past the last one: sources may deliver twice."""
        if ordinal <= self.ordinals.get(source, -1):
            return False
        self.ordinals[source] = ordinal
        self.feed(source, delta)
        return True

    def feed_snapshot(self, source: str, snapshot: DataFrame) -> None:
        """All rows that the source has now; the difference from what is stored is fed."""
        now = self.snapshot(source)
        self.feed(source, ZSet.differentiate(now, snapshot.select(*now.columns)))

    # ticking
    def step(self) -> dict[str, DataFrame]:
        """Apply all that was fed; returns each changed view's delta."""
        before = {name: ZSet(log.rows()) for name, log in self.sources.items()}
        deltas: dict[str, ZSet] = {}
        for source, parts in self.pending.items():
            z = parts[0]
            for p in parts[1:]:
                z = z.concat(p)
            deltas[source] = ZSet(self.sources[source].put(z.consolidate().df, f"source-{source}"))
        self.pending = {}
        out: dict[str, DataFrame] = {}
        for view in self.topological():
            view.delta = None
            if not any(s in deltas for s in view.sources):
                continue
            before[view.name] = view.result
            view.delta = ZSet(view.results.put(self._advance(view, deltas, before).consolidate().df, f"view-{view.name}"))
            deltas[view.name] = view.delta
            out[view.name] = view.delta.df
            for callback in self.watchers.get(view.name, []):
                callback(view.delta.df)
        return out

    def _state(self, name: str) -> ZSet | None:
        return ZSet(self.sources[name].rows()) if name in self.sources else self.views[name].result

    def _advance(self, view: View, deltas: dict[str, ZSet], before: dict[str, ZSet | None]) -> ZSet:
        kind, p = view.plan
        if kind == "diff":
            for s in view.sources:
                self.snapshot(s).createOrReplaceTempView(s)
            now = self.spark.sql(view.sql)
            if view.result is None:
                return ZSet.inserts(now).consolidate()
            return ZSet.inserts(now).concat(view.result.negate()).consolidate()
        where = (lambda z: z.filter(p["where"]) if p.get("where") else z)
        if kind == "linear":
            d = where(deltas[p["source"]])
            return (d.project(*p["columns"]) if p["columns"] else d).consolidate()
        if kind == "distinct":
            view.state = view.state or Log(_weights)
            old = view.state.rows()
            d = view.state.put(where(deltas[p["source"]]).project(*p["columns"]).consolidate().df, f"state-{view.name}")
            return op.distinct(ZSet(old) if old is not None else None, ZSet(d))[0]
        if kind == "aggregate":
            return self._aggregate(view, where(deltas[p["source"]]), p["keys"], p["aggs"]).project(*p["columns"])
        l, r, on = p["left"], p["right"], p["on"]
        empty = lambda n: ZSet(self._state(n).df.where(F.lit(False)))
        dl, dr = deltas.get(l, empty(l)), deltas.get(r, empty(r))
        if p["outer"]:
            delta, _, _ = op.left_join(before.get(l) or empty(l), before.get(r) or empty(r), dl, dr, on)
        else:
            delta, _, _ = op.join(before.get(l) or empty(l), before.get(r) or empty(r), dl, dr, on)
        delta = where(delta)
        return delta.project(*p["columns"]) if p["columns"] else delta

    def _aggregate(self, view: View, delta: ZSet, keys: list[str], aggs: list[op.Agg]) -> ZSet:
        """Sums by key are the state where they do; else the rows themselves, of which the touched keys' are looked at."""
        if op.additive(dict(delta.df.dtypes), aggs):
            view.state = view.state or Log(lambda df: op.added(df, keys))
            old = view.state.rows()
            return op.aggregate_sums(old, view.state.put(op.sums(delta, keys, aggs), f"state-{view.name}"), keys, aggs)
        view.state = view.state or Log(_weights)
        old = view.state.rows()
        d = view.state.put(op.aggregate_input(delta, keys, aggs).df, f"state-{view.name}")
        return op.aggregate(ZSet(old) if old is not None else None, ZSet(d), keys, aggs)[0]

    # reading
    def snapshot(self, name: str) -> DataFrame:
        state = self._state(name)
        if state is None:
            raise ValueError(f"view {name} has had no tick yet")
        return state.consolidate().expanded()

    def changes(self, name: str) -> DataFrame:
        """The last tick's changelog of a view."""
        view = self.views[name]
        if view.delta is None:
            return self._state(name).changelog().where(F.lit(False))
        return view.delta.changelog()

    # checkpoints
    def checkpoint(self, path: str | None = None) -> str:
        """Write sources, states, results, what was fed but not ticked, and how far each source has come; returns the folder."""
        path = path or state_path(self.spark, "ivm-checkpoint")
        logs = {f"source/{n}": log for n, log in self.sources.items()} | {f"view/{n}": v.results for n, v in self.views.items()} | {f"state/{n}": v.state for n, v in self.views.items() if v.state}
        for where, log in logs.items():
            if log.parts:
                log.merge(log.rows()).write.mode("overwrite").parquet(f"{path}/{where}")
        for name, parts in self.pending.items():
            z = parts[0]
            for more in parts[1:]:
                z = z.concat(more)
            z.df.write.mode("overwrite").parquet(f"{path}/pending/{name}")
        for name, top in self.newest.items():
            self.spark.range(1).select(F.lit(top).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/{name}")
        write_text(self.spark, f"{path}/progress.json", json.dumps({"ordinals": self.ordinals, "pending": sorted(self.pending), "newest": sorted(self.newest)}), overwrite=True)
        return path

    def restore(self, path: str) -> None:
        """Into a flow that declares the same sources and views; a batch that the checkpoint has seen is ignored again."""
        read = lambda p: self.spark.read.parquet(p) if path_exists(self.spark, p) else None
        for name, log in self.sources.items():
            self.sources[name] = Log.of(_weights, df) if (df := read(f"{path}/source/{name}")) is not None else log
        for name, v in self.views.items():
            v.results = Log.of(_weights, read(f"{path}/view/{name}"))
            if (df := read(f"{path}/state/{name}")) is not None:
                v.state = Log.of(_weights if WEIGHT in df.columns else (lambda rows, keys=v.plan[1]["keys"]: op.added(rows, keys)), df)
        progress = json.loads(read_text(self.spark, f"{path}/progress.json"))
        self.ordinals = dict(progress["ordinals"])
        self.pending = {name: [ZSet(read(f"{path}/pending/{name}"))] for name in progress["pending"]}
        self.newest = {name: self.spark.read.parquet(f"{path}/newest/{name}").first()[0] for name in progress["newest"]}

    def provenance(self, view: str, on: list[str]) -> DataFrame:
        """(input_hash, output_hash): which source rows stand behind which view rows, by the columns that they share."""
        v = self.views[view]
        out = self.snapshot(view)
        pairs = None
        for s in v.sources:
            rows = self.snapshot(s)
            a = rows.select(*on, F.xxhash64(*rows.columns).alias("input_hash"))
            b = out.select(*on, F.xxhash64(*out.columns).alias("output_hash"))
            got = a.join(b, on).select(F.lit(s).alias("source"), "input_hash", "output_hash").distinct()
            pairs = got if pairs is None else pairs.unionByName(got)
        return pairs


class IncrementalDataFrame:
    """One source and one view: apply changes, step, read."""

    def __init__(self, df: DataFrame, name: str, sql: str | None = None):
        self.flow, self.name = IncrementalFlow(df.sparkSession), name
        self.flow.register_source(name, df)
        self.view = self.flow.register_view(f"{name}_view", sql or f"SELECT * FROM {name}")
        self.flow.feed(name, ZSet.inserts(df))

    def apply(self, delta: ZSet | DataFrame) -> IncrementalDataFrame:
        self.flow.feed(self.name, delta)
        return self

    def step(self) -> DataFrame:
        return self.flow.step().get(self.view.name, self.flow.changes(self.view.name))

    def snapshot(self) -> DataFrame:
        return self.flow.snapshot(self.view.name)


class PartitionedFlow:
    """Several flows with the same views, each with the rows of some keys.

    ``keys`` names each source's column by which its rows are dealt; views whose
    groups and joins keep to that column give, put together, what one flow gives.
    The flows share nothing, so each can be checkpointed and ticked apart.
    """

    def __init__(self, spark: SparkSession, parts: int, keys: dict[str, str]):
        self.parts, self.keys = [IncrementalFlow(spark) for _ in range(parts)], keys

    def register_source(self, name: str, like: DataFrame, lateness: tuple[str, int] | None = None) -> None:
        for f in self.parts:
            f.register_source(name, like, lateness)

    def register_view(self, name: str, sql: str) -> None:
        for f in self.parts:
            f.register_view(name, sql)

    def feed(self, source: str, delta: ZSet | DataFrame) -> None:
        z = delta if isinstance(delta, ZSet) else ZSet(delta) if WEIGHT in delta.columns else ZSet.inserts(delta)
        part = F.pmod(F.xxhash64(self.keys[source]), F.lit(len(self.parts)))
        for i, f in enumerate(self.parts):
            f.feed(source, z.filter(part == i))

    def step(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for f in self.parts:
            for name, delta in f.step().items():
                out[name] = out[name].unionByName(delta) if name in out else delta
        return out

    def snapshot(self, name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [f.snapshot(name) for f in self.parts])

    def checkpoint(self, path: str) -> str:
        for i, f in enumerate(self.parts):
            f.checkpoint(f"{path}/part={i}")
        return path

    def restore(self, path: str) -> None:
        for i, f in enumerate(self.parts):
            f.restore(f"{path}/part={i}")


class RecursiveView:
    """A fixpoint of ``step`` over sets: each round joins only the rows that the last round added."""

    def __init__(self, step: Callable[[DataFrame], DataFrame], limit: int = 100):
        self.step, self.limit = step, limit

    def run(self, seed: DataFrame) -> DataFrame:
        known = materialize(seed.distinct(), "recursive")
        fresh = known
        for _ in range(self.limit):
            fresh = materialize(self.step(fresh).select(*known.columns).distinct().exceptAll(known), "recursive-new")
            if fresh.isEmpty():
                return known
            known = materialize(known.unionByName(fresh), "recursive")
        raise CycleLimitExceeded(f"still changing after {self.limit} rounds")

"""The SQL front door: statements that Spark lacks are carried out here, all others are rewritten and passed on."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ivm import IncrementalFlow, ZSet
from tessera.operators import cep
from tessera.plans import dialect
from tessera.plans.pipeline import Pipeline
from tessera.sources import files
from tessera.sources.versioned import VersionedTable
from tessera.storage import shared_dir

#: What the reference values of a big-data session are: broadcast up to 32 MiB, adaptive plans, UTC.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.session.timeZone": "UTC",
}


class AccessDenied(PermissionError):
    """A statement names a table that the policy doesn't allow."""


class OperationHandle:
    """A running statement: id, status, progress, cancel, result."""

    def __init__(self, engine: Engine, sql: str, timeout: float | None):
        self.id, self.sql, self._engine = f"op-{uuid.uuid4().hex}", sql, engine
        self._future: Future = Future()
        self.started, self.cancelled = time.time(), False
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._timer = threading.Timer(timeout, self.cancel) if timeout else None
        self._thread.start()
        if self._timer:
            self._timer.daemon = True
            self._timer.start()

    def _run(self) -> None:
        spark = self._engine.spark
        spark.addTag(self.id)
        try:
            self._future.set_result(self._engine.sql(self.sql).toArrow())
        except BaseException as e:  # handed to whoever asks for the result
            self._future.set_exception(e)
        finally:
            spark.removeTag(self.id)
            if self._timer:
                self._timer.cancel()

    def status(self) -> str:
        if not self._future.done():
            return "running"
        return "cancelled" if self.cancelled else "failed" if self._future.exception() else "finished"

    def cancel(self) -> None:
        if not self._future.done():
            self.cancelled = True
            self._engine.spark.interruptTag(self.id)

    def progress(self) -> dict:
        tracker = self._engine.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return {"active_tasks": sum(s.numActiveTasks for s in stages if s), "completed_tasks": sum(s.numCompletedTasks for s in stages if s), "seconds": time.time() - self.started}

    def result(self, timeout: float | None = None):
        return self._future.result(timeout)


class Prepared:
    """A statement with parameters $1, $2, ..., bound by Spark, never by text."""

    def __init__(self, engine: Engine, sql: str):
        self.engine, self.sql, self.open = engine, dialect.rewrite(dialect.rewrite_parameters(sql)), True

    def bind(self, *values) -> DataFrame:
        if not self.open:
            raise ValueError("the statement is closed")
        return self.engine.spark.sql(self.sql, args={f"p{i + 1}": v for i, v in enumerate(values)})

    def bind_many(self, rows: Sequence[Sequence]) -> list[DataFrame]:
        return [self.bind(*r) for r in rows]

    def close(self) -> None:
        self.open = False


class Engine:
    """Batch, streaming and incremental statements over one Spark session."""

    def __init__(self, spark: SparkSession, allowed: Sequence[str] | None = None, lake: str | None = None):
        self.spark = spark
        for k, v in DEFAULTS.items():
            spark.conf.set(k, v)
        self.allowed = set(allowed) if allowed is not None else None
        self.prepared: dict[str, Prepared] = {}
        self.lake_dir = lake
        self.lake: dict[str, VersionedTable] = {}
        self.flow: IncrementalFlow | None = None
        self.keys: dict[str, list[str]] = {}
        self.live: dict[str, str] = {}
        self.streams: dict[str, str] = {}
        self.pipelines: dict[str, Pipeline] = {}
        self.connectors: dict[str, dict[str, str]] = {}
        self.history: list[dict] = []

    # registration
    def register_parquet(self, name: str, path: str, primary_key: Sequence[str] = ()) -> DataFrame:
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        if primary_key:
            self.keys[name] = list(primary_key)  # informational, not checked
        return df

    def register_csv(self, name: str, path: str, **options) -> DataFrame:
        df = files.read_csv(self.spark, path, **options)
        df.createOrReplaceTempView(name)
        return df

    def register_json(self, name: str, path: str, **options) -> DataFrame:
        df = files.read_json(self.spark, path, **options)
        df.createOrReplaceTempView(name)
        return df

    def register(self, name: str, data) -> DataFrame:
        """A DataFrame, Arrow table, pandas frame or list of rows under a name."""
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        df.createOrReplaceTempView(name)
        return df

    def register_stream(self, name: str, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
        """A folder in which files arrive, as an unbounded table."""
        from tessera.streaming.frame import file_stream

        df = file_stream(self.spark, path, schema, fmt, **options)
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        self._check(name)
        return self.lake[name].read() if name in self.lake else self.spark.table(name)

    def create_lake_table(self, name: str, key: Sequence[str] = ()) -> VersionedTable:
        base = self.lake_dir or f"{shared_dir(self.spark)}/lake"
        self.lake[name] = VersionedTable(self.spark, f"{base}/{name}", key)
        return self.lake[name]

    # functions
    def register_scalar(self, name: str, f: Callable, returns: str, vectorized: bool = True) -> None:
        """With ``vectorized`` the function takes and returns pandas series, sent as Arrow batches."""
        self.spark.udf.register(name, F.pandas_udf(f, returns) if vectorized else F.udf(f, returns, useArrow=True))

    def register_aggregate(self, name: str, f: Callable[[pd.Series], float], returns: str) -> None:
        from pyspark.sql.pandas.functions import PandasUDFType

        self.spark.udf.register(name, F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG))

    def register_table_function(self, name: str, handler: type, returns: str) -> None:
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def register_sql_function(self, name: str, parameters: str, returns: str, body: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {dialect.rewrite(body)}")

    # statements
    def prepare(self, sql: str) -> Prepared:
        self._check_sql(sql)
        return Prepared(self, sql)

    def submit(self, sql: str, timeout: float | None = None) -> OperationHandle:
        return OperationHandle(self, sql, timeout)

    def sql_with_timeout(self, sql: str, seconds: float):
        handle = self.submit(sql, seconds)
        try:
            return handle.result(seconds + 30)
        except BaseException as e:
            raise TimeoutError(f"stopped after {seconds} s") if handle.cancelled else e from e

    def sql(self, text: str) -> DataFrame:
        """Run all statements of a script; returns the last one's result."""
        out = None
        for statement in dialect.split_statements(text):
            out = self._statement(statement)
        return out if out is not None else self._message("status", "OK")

    def _message(self, column: str, value) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{column} {'BIGINT' if isinstance(value, int) else 'STRING'}")

    def _statement(self, sql: str) -> DataFrame:
        started = time.time()
        self._check_sql(sql)
        for pattern, handler in _HANDLERS:
            if m := pattern.match(sql):
                out = getattr(self, handler)(m, sql)
                if out is not None:
                    self.history.append({"sql": sql, "handler": handler, "seconds": time.time() - started})
                    return out
        out = self.spark.sql(self._lake_views(dialect.rewrite(sql)))
        self.history.append({"sql": sql, "handler": "spark", "seconds": time.time() - started})
        return out

    # policy
    def _check(self, name: str) -> None:
        if self.allowed is not None and name.lower() not in {a.lower() for a in self.allowed}:
            raise AccessDenied(f"table {name} is not allowed")

    def _check_sql(self, sql: str) -> None:
        """Every relation that the parsed statement names must be allowed; what can't be parsed is denied.

        Statements that only this engine knows are parsed in their parts: the
        names they carry are checked, and their inner queries are parsed.
        """
        if self.allowed is None:
            return
        handler, m = next(((h, m) for p, h in _HANDLERS if (m := p.match(sql))), (None, None))
        if handler in ("_execute", "_deallocate"):  # checked when it was prepared
            for a in dialect.split_arguments(m["a"] or "") if handler == "_execute" else ():
                self._check_parsed(f"SELECT {a}")
            return
        if handler in _OWN:
            names, bodies = _OWN[handler]
            for n in names:
                self._check(m[n])
            for q in bodies:
                text = m[q].strip()
                if re.fullmatch(r"\w+", text):
                    self._check(text)
                else:
                    self._check_parsed(text[1:-1] if text.startswith("(") and text.endswith(")") else text)
            return
        if handler == "_call":
            self._check(dialect.split_arguments(m["a"])[0].split("=>")[-1].strip().strip("'"))
            return
        self._check_parsed(sql)

    def _check_parsed(self, sql: str) -> None:
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect.rewrite(dialect.rewrite_parameters(sql)))
        except Exception as e:
            raise AccessDenied("a statement that can't be parsed is not allowed under a policy") from e
        self._check_plan(plan, frozenset())

    def _check_plan(self, node, known: frozenset) -> None:
        """Walk a parsed plan, its expressions and their subqueries; ``known`` are the common table expressions in scope."""
        if not hasattr(node, "getClass"):
            return  # a number, text or truth value
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedView", "UnresolvedTableOrView", "UnresolvedIdentifier"):
            parts = node.multipartIdentifier() if kind != "UnresolvedIdentifier" else node.nameParts()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if not (parts.size() == 1 and name.lower() in known):
                self._check(name)
            return
        if kind in ("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "ExecuteImmediateQuery", "UnresolvedExecuteImmediate", "ExecuteImmediateCommand"):
            raise AccessDenied("names made at run time are not allowed under a policy")
        if kind == "UnresolvedWith":
            recursive = node.allowRecursion()
            relations = node.cteRelations()
            for i in range(relations.size()):
                pair = relations.apply(i)
                self._check_plan(pair._2(), known | {pair._1().lower()} if recursive else known)
                known = known | {pair._1().lower()}
            self._check_plan(node.child(), known)
            return
        jvm = self.spark._jvm
        if _is(jvm, "scala.collection.Iterable", node):
            it = node.iterator()
        elif _is(jvm, "scala.Product", node):
            it = node.productIterator()
        else:
            return
        while it.hasNext():
            self._check_plan(it.next(), known)

    # AS OF and lake tables
    def _lake_views(self, sql: str) -> str:
        """Lake tables become views of the version that the text asks for."""
        for name, table in self.lake.items():
            pattern = re.compile(rf"(?i)\b{name}\b(?:\s+(?:FOR\s+SYSTEM_(?:TIME|VERSION)\s+AS\s+OF|(?P<k>VERSION|TIMESTAMP)\s+AS\s+OF)\s+(?P<v>'[^']*'|\d+))?")

            def view(m: re.Match, name=name, table=table) -> str:
                v = m["v"]
                if v is None:
                    df, label = table.read(), name
                elif v.startswith("'") and not v.strip("'").isdigit():
                    ref = v.strip("'")
                    if ref in table.refs():
                        df = table.read(ref=ref)
                    else:
                        df = table.read(timestamp=pd.Timestamp(ref, tz="UTC").timestamp())
                    label = f"{name}_at_{abs(hash(ref))}"
                else:
                    n = int(v.strip("'"))
                    df, label = table.read(version=n), f"{name}_v{n}"
                df.createOrReplaceTempView(label)
                return label

            if table.exists():
                sql = pattern.sub(view, sql)
        return sql

    # handlers; None means: not for us
    def _prepare(self, m, sql):
        self.prepared[m["n"].lower()] = Prepared(self, m["q"])
        return self._message("status", "prepared")

    def _execute(self, m, sql):
        p = self.prepared.get(m["n"].lower())
        if p is None:
            raise ValueError(f"no prepared statement {m['n']}")
        args = dialect.split_arguments(m["a"] or "")
        values = [self.spark.sql(f"SELECT {a} AS v").first()[0] for a in args]
        return p.bind(*values)

    def _deallocate(self, m, sql):
        self.prepared.pop(m["n"].lower()).close()
        return self._message("status", "deallocated")

    def _create_external(self, m, sql):
        fmt = m["f"].lower()
        options = dict(re.findall(r"'([\w.]+)'\s*'?=?\s*'([^']*)'", m["o"] or ""))
        if fmt in files.CONNECTORS_ABSENT:
            files.reader_for(self.spark, fmt)
        r = self.spark.read.format(fmt).options(**options)
        if fmt == "csv":
            r = r.option("header", options.get("header", "true")).option("inferSchema", "true")
        if m["c"]:
            r = r.schema(dialect.rewrite_types("(" + m["c"] + ")")[1:-1])
        r.load(m["p"]).createOrReplaceTempView(m["n"])
        return self._message("status", "created")

    def _create_table_as(self, m, sql):
        df = self.sql(m["q"])
        if m["n"] in self.lake and not m["r"]:
            raise ValueError(f"table {m['n']} exists")
        table = self.create_lake_table(m["n"])
        parts = []
        for p in dialect.split_arguments(m["p"] or ""):
            t = re.match(r"(?i)(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?(\w+)(?:\s*,\s*(\d+))?\s*\)$", p)
            if not t:
                parts.append(p)
                continue
            kind, n, c = t[1].lower(), int(t[2] or t[4] or 0), t[3]
            made = {
                "bucket": lambda n=n, c=c: F.pmod(F.hash(c), F.lit(n)), "truncate": lambda n=n, c=c: F.substring(F.col(c).cast("string"), 1, n),
                "year": lambda c=c: F.year(c), "month": lambda c=c: F.date_format(c, "yyyy-MM"), "day": lambda c=c: F.to_date(c), "hour": lambda c=c: F.date_format(c, "yyyy-MM-dd-HH"),
            }[kind]()
            df = df.withColumn(f"{c}_{kind}", made)
            parts.append(f"{c}_{kind}")
        if table.exists():
            table.overwrite(df, parts)
        else:
            table.append(df, partition_by=parts)
        return self._message("count", table.read().count())

    def _insert(self, m, sql):
        if m["n"] not in self.lake:
            return None
        df = self.sql(m["q"])
        table = self.lake[m["n"]]
        names = [c.strip() for c in m["c"].split(",")] if m["c"] else table.read().columns if table.exists() else df.columns
        df = df.toDF(*names)
        if table.exists():
            schema = table.read().schema
            df = df.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        n = df.count()
        table.overwrite(df) if m["k"].lower().startswith("overwrite") else table.append(df)
        return self._message("count", n)

    def _delete(self, m, sql):
        if m["n"] not in self.lake:
            return None
        return self._message("deleted_rows", self.lake[m["n"]].delete(dialect.rewrite(m["w"] or "true")))

    def _update(self, m, sql):
        if m["n"] not in self.lake:
            return None
        sets = {}
        for a in dialect.split_arguments(m["s"]):
            k, _, v = a.partition("=")
            sets[k.strip()] = dialect.rewrite(v.strip())
        return self._message("updated_rows", self.lake[m["n"]].update(sets, dialect.rewrite(m["w"]) if m["w"] else None))

    def _merge(self, m, sql):
        if m["t"] not in self.lake:
            return None
        ta, sa = m["ta"] or m["t"], m["sa"] or m["s"]
        source = self.sql(m["s"][1:-1]) if m["s"].startswith("(") else self.table(m["s"])
        on = re.findall(rf"(?i)\b(?:{ta}|{sa})\.(\w+)\s*=\s*(?:{ta}|{sa})\.\w+", m["on"])
        if not on:
            raise ValueError("MERGE needs equality of key columns")

        def clean(e: str) -> str:
            return re.sub(rf"(?i)\b{ta}\.", "t.", re.sub(rf"(?i)\b{sa}\.", "s.", e)) if ta.lower() != "s" else e

        rest, matched, new, gone = m["rest"], None, None, None
        if d := re.search(r"(?is)WHEN\s+MATCHED(?:\s+AND\s+(?P<c>.+?))?\s+THEN\s+DELETE", rest):
            gone = clean(d["c"] or "true")
        if u := re.search(r"(?is)WHEN\s+MATCHED\s+THEN\s+UPDATE\s+SET\s+(?P<s>.+?)(?=\s+WHEN\s|$)", rest):
            matched = "all" if u["s"].strip() == "*" else {k.strip().split(".")[-1]: clean(v.strip()) for k, _, v in (a.partition("=") for a in dialect.split_arguments(u["s"]))}
        if i := re.search(r"(?is)WHEN\s+NOT\s+MATCHED\s+THEN\s+INSERT\s*(?:\*|\((?P<c>[^)]*)\)\s*VALUES\s*\((?P<v>.*?)\)\s*$)", rest):
            new = "all" if i["c"] is None else dict(zip([c.strip() for c in i["c"].split(",")], [clean(v) for v in dialect.split_arguments(i["v"])], strict=True))
        counts = self.lake[m["t"]].merge(source, on, matched, new, gone)
        return self.spark.createDataFrame([(counts["updated"], counts["deleted"], counts["inserted"])], "updated BIGINT, deleted BIGINT, inserted BIGINT")

    def _alter(self, m, sql):
        if m["n"] not in self.lake:
            return None
        t, a = self.lake[m["n"]], m["a"].strip()
        if x := re.match(r"(?i)ADD\s+COLUMN\s+(\w+)\s+(.+)$", a):
            t.add_column(x[1], dialect.rewrite_types(f"CAST(x AS {x[2]})")[10:-1])
        elif x := re.match(r"(?i)DROP\s+COLUMN\s+(\w+)$", a):
            t.drop_column(x[1])
        elif x := re.match(r"(?i)RENAME\s+COLUMN\s+(\w+)\s+TO\s+(\w+)$", a):
            t.rename_column(x[1], x[2])
        elif x := re.match(r"(?i)RENAME\s+TO\s+(\w+)$", a):
            self.lake[x[1]] = self.lake.pop(m["n"])
        else:
            raise ValueError(f"unknown change {a!r}")
        return self._message("status", "altered")

    def _drop(self, m, sql):
        if m["n"] in self.lake:
            del self.lake[m["n"]]
            self.spark.catalog.dropTempView(m["n"])  # the view of its last reading
            return self._message("status", "dropped")
        if m["k"].lower() == "table" and self.spark.catalog.dropTempView(m["n"]):
            return self._message("status", "dropped")
        return None

    def _truncate(self, m, sql):
        if m["n"] not in self.lake:
            return None
        self.lake[m["n"]].truncate()
        return self._message("status", "truncated")

    def _copy(self, m, sql):
        df = self.sql(m["q"][1:-1] if m["q"].startswith("(") else f"SELECT * FROM {m['q']}")
        fmt = (m["f"] or m["p"].rpartition(".")[2] or "parquet").lower()
        fmt = fmt if fmt in ("parquet", "csv", "json", "orc") else "parquet"
        n = df.count()
        df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(m["p"])
        return self._message("count", n)

    def _analyze(self, m, sql):
        from tessera.operators.frame import analyze

        return analyze(self.table(m["n"])) if m["n"] in self.lake or self.spark.catalog.tableExists(m["n"]) else None

    def _call(self, m, sql):
        args = [a.split("=>")[-1].strip().strip("'") for a in dialect.split_arguments(m["a"])]
        table, what = self.lake[args[0]], m["f"].lower()
        if what == "expire_snapshots":
            return self._message("expired", len(table.expire(int(args[1]) if len(args) > 1 else 1)))
        if what == "remove_orphan_files":
            return self._message("removed", len(table.remove_orphans()))
        if what == "compact_data_files":
            return self._message("version", table.compact(int(args[1]) if len(args) > 1 else 1))
        if what == "maintain":
            table.compact()
            table.expire()
            return self._message("removed", len(table.remove_orphans()))
        raise ValueError(f"no procedure {what}")

    def _flow(self) -> IncrementalFlow:
        if self.flow is None:
            self.flow = IncrementalFlow(self.spark)
        return self.flow

    def _incremental_view(self, m, sql):
        flow, name, body = self._flow(), m["n"], dialect.rewrite(m["q"])
        if name in flow.views:
            if not m["r"]:
                raise ValueError(f"view {name} exists")
            flow.drop_view(name)
        late = None
        if x := re.search(r"(?is)\s+LATENESS\s+(\w+)\s+(\d+)\s*$", body):
            late, body = (x[1], int(x[2])), body[: x.start()]
        for t in set(re.findall(r"(?i)\b(?:from|join)\s+(\w+)", body)):
            if t not in flow.sources and t not in flow.views and self.spark.catalog.tableExists(t):
                flow.register_source(t, self.table(t), late)
                flow.feed(t, ZSet.inserts(self.table(t)))
        flow.register_view(name, body)
        flow.step()
        flow.snapshot(name).createOrReplaceTempView(name)
        return self._message("status", f"created ({flow.views[name].plan[0]})")

    def _refresh_view(self, m, sql):
        flow = self._flow()
        if m["n"] not in flow.views:
            return None
        for t in list(flow.sources):
            if self.spark.catalog.tableExists(t):
                flow.feed_snapshot(t, self.table(t))
        flow.step()
        for v in flow.views:
            flow.snapshot(v).createOrReplaceTempView(v)
        return self._message("status", "refreshed")

    def _drop_view(self, m, sql):
        if self.flow is None or m["n"] not in self.flow.views:
            return None
        self.flow.drop_view(m["n"])
        self.spark.catalog.dropTempView(m["n"])
        return self._message("status", "dropped")

    def _recursive_view(self, m, sql):
        """Re-run the union with the view's last result until nothing changes."""
        from tessera.ivm.flow import CycleLimitExceeded
        from tessera.storage import materialize

        seed, _, step = re.split(r"(?i)\bUNION\b(\s+ALL\b)?", m["q"], maxsplit=1)
        known = materialize(self.sql(seed).distinct(), "recursive")
        fresh = known
        for _ in range(100):
            fresh.createOrReplaceTempView(m["n"])
            fresh = materialize(self.spark.sql(dialect.rewrite(step)).toDF(*known.columns).distinct().exceptAll(known), "recursive-new")
            if fresh.isEmpty():
                known.createOrReplaceTempView(m["n"])
                return self._message("status", "created")
            known = materialize(known.unionByName(fresh), "recursive")
        raise CycleLimitExceeded(f"{m['n']} still changes after 100 rounds")

    def _streaming_table(self, m, sql):
        """A versioned table fed by a stream: creating and refreshing it append what has arrived since, each batch once."""
        if m["n"] in self.streams and not m["r"]:
            raise ValueError(f"streaming table {m['n']} exists")
        self.streams[m["n"]] = m["q"]
        self.create_lake_table(m["n"])
        return self._refresh_streaming(m, sql)

    def _refresh_streaming(self, m, sql):
        from tessera.streaming.frame import StreamWriter

        table = self.lake[m["n"]]
        df = self.spark.sql(self._lake_views(dialect.rewrite(self.streams[m["n"]])))
        if not df.isStreaming:
            raise ValueError(f"{m['n']} must read a stream")
        StreamWriter(df).output_mode("append").trigger("available_now").checkpoint(f"{table.path}/_stream").append_to(table).start().awaitTermination()
        return self._message("status", "refreshed")

    def _drop_streaming(self, m, sql):
        del self.streams[m["n"]]
        self.lake.pop(m["n"], None)
        return self._message("status", "dropped")

    def _live_table(self, m, sql):
        self.live[m["n"]] = m["q"]
        table = self.create_lake_table(m["n"])
        (table.overwrite if table.exists() else table.append)(self.sql(m["q"]))
        return self._message("status", "created")

    def _refresh_live(self, m, sql):
        self.lake[m["n"]].overwrite(self.sql(self.live[m["n"]]))
        return self._message("status", "refreshed")

    def _drop_live(self, m, sql):
        del self.live[m["n"]]
        self.lake.pop(m["n"], None)
        return self._message("status", "dropped")

    def _connector(self, m, sql):
        options = dict(re.findall(r"'?([\w.]+)'?\s*=\s*'([^']*)'", m["o"]))
        kind = options.pop("connector")
        self.connectors[m["n"]] = options | {"connector": kind, "role": m["k"].lower()}
        if m["k"].lower() == "source":
            files.reader_for(self.spark, kind).options(**{k: v for k, v in options.items() if k != "path"}).load(options["path"]).createOrReplaceTempView(m["n"])
        return self._message("status", "created")

    def _start_pipeline(self, m, sql):
        self.pipelines[m["n"]].run()
        return self._message("status", "finished")

    def _match_recognize(self, m, sql):
        stages = m["pat"].split()
        if any(not re.fullmatch(r"\w+", s) for s in stages):
            raise cep.UnsupportedPattern("patterns are plain sequences of names")
        within = dialect.milliseconds(f"{m['w']} {m['u']}") if m["w"] else cep.DEFAULT_WITHIN_MS
        return cep.match_any(self.table(m["t"]), m["k"], m["ts"], len(stages), within)

    def _information_schema(self, m, sql):
        tables, columns = [], []
        for t in self.spark.catalog.listTables():
            tables.append((t.catalog or "spark_catalog", ".".join(t.namespace or ["default"]), t.name, "VIEW" if t.isTemporary else "BASE TABLE"))
            columns += [("default", t.name, f.name, i + 1, "YES" if f.nullable else "NO", f.dataType.simpleString()) for i, f in enumerate(self.spark.table(t.name).schema)]
        for n, table in self.lake.items():
            tables.append(("lake", "default", n, "BASE TABLE"))
            columns += [("lake", n, f.name, i + 1, "YES", f.dataType.simpleString()) for i, f in enumerate(table.read().schema)]
        made = {
            "tables": (tables, "table_catalog STRING, table_schema STRING, table_name STRING, table_type STRING"),
            "views": ([t for t in tables if t[3] == "VIEW"], "table_catalog STRING, table_schema STRING, table_name STRING, table_type STRING"),
            "columns": (columns, "table_schema STRING, table_name STRING, column_name STRING, ordinal_position INT, is_nullable STRING, data_type STRING"),
            "schemata": ([(d.catalog or "spark_catalog", d.name) for d in self.spark.catalog.listDatabases()], "catalog_name STRING, schema_name STRING"),
            "routines": ([(f.name,) for f in self.spark.catalog.listFunctions()], "routine_name STRING"),
            "df_settings": ([(r["key"], r["value"]) for r in self.spark.sql("SET").collect()], "name STRING, value STRING"),
        }
        for name, (rows, schema) in made.items():
            self.spark.createDataFrame(rows, schema).createOrReplaceTempView(f"information_schema_{name}")
        return self.spark.sql(dialect.rewrite(re.sub(r"(?i)\binformation_schema\.(\w+)", r"information_schema_\1", sql)))

    def _create_function(self, m, sql):
        body = m["b"].replace("''", "'")
        returns = m["r"].strip()
        params = dialect.rewrite_types(f"({m['a']})")[1:-1]
        if returns.upper().startswith("TABLE"):
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m['n']}({params}) RETURNS {dialect.rewrite_types(returns)} RETURN {dialect.rewrite(body)}")
        else:
            self.register_sql_function(m["n"], params, dialect.rewrite_types(f"CAST(x AS {returns})")[10:-1], re.sub(r"(?i)^\s*SELECT\s+", "", body))
        return self._message("status", "created")

    def explain(self, sql: str, mode: str = "formatted") -> str:
        return self.sql(sql)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def sqlstate(error: BaseException) -> str:
    """The five-character state of an error; HY000 if it has none."""
    if isinstance(error, PySparkException) and error.getSqlState():
        return error.getSqlState()
    return {AccessDenied: "42501", TimeoutError: "57014", ValueError: "22023"}.get(type(error), "HY000")


def error_position(error: BaseException) -> tuple[int, int] | None:
    """(line, column), both from 1, of the place in the statement that an error speaks of; None if it names none."""
    if m := re.search(r"\(line (\d+), pos (\d+)\)", str(error)) or re.search(r"line (\d+)(?: in \S+)?,? pos(?:ition)? (\d+)", str(error)):
        return int(m[1]), int(m[2]) + 1
    return None


def _is(jvm, name: str, value) -> bool:
    return bool(jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader()).isInstance(value))


#: Of statements that Spark's parser doesn't know: which groups are table names, and which are queries or table names.
_OWN: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "_prepare": ((), ("q",)),
    "_create_external": (("n",), ()),
    "_create_table_as": (("n",), ("q",)),
    "_copy": ((), ("q",)),
    "_incremental_view": (("n",), ("q",)),
    "_refresh_view": (("n",), ()),
    "_drop_view": (("n",), ()),
    "_live_table": (("n",), ("q",)),
    "_streaming_table": (("n",), ("q",)),
    "_refresh_streaming": (("n",), ()),
    "_drop_streaming": (("n",), ()),
    "_refresh_live": (("n",), ()),
    "_drop_live": (("n",), ()),
    "_connector": (("n",), ()),
    "_start_pipeline": (("n",), ()),
    "_match_recognize": (("t",), ()),
}


def _re(pattern: str) -> re.Pattern:
    return re.compile(r"(?is)^\s*" + pattern + r"\s*$")


_HANDLERS: list[tuple[re.Pattern, str]] = [
    (_re(r"PREPARE\s+(?P<n>\w+)\s+AS\s+(?P<q>.+)"), "_prepare"),
    (_re(r"EXECUTE\s+(?!IMMEDIATE\b)(?P<n>\w+)\s*(?:\((?P<a>.*)\))?"), "_execute"),
    (_re(r"DEALLOCATE\s+(?:PREPARE\s+)?(?P<n>\w+)"), "_deallocate"),
    (_re(r"CREATE\s+EXTERNAL\s+TABLE\s+(?P<n>\w+)\s*(?:\((?P<c>.*?)\))?\s*STORED\s+AS\s+(?P<f>\w+)(?:\s+WITH\s+HEADER\s+ROW)?\s+LOCATION\s+'(?P<p>[^']*)'(?:\s+OPTIONS\s*\((?P<o>.*)\))?"), "_create_external"),
    (_re(r"CREATE\s+(?P<r>OR\s+REPLACE\s+)?TABLE\s+(?P<n>\w+)\s*(?:PARTITIONED\s+BY\s*\((?P<p>.*?)\)\s*)?AS\s+(?P<q>(?:SELECT|WITH|VALUES).+)"), "_create_table_as"),
    (_re(r"INSERT\s+(?P<k>INTO|OVERWRITE(?:\s+TABLE)?)\s+(?P<n>\w+)\s*(?:\((?P<c>[\w\s,]+)\))?\s+(?P<q>(?:SELECT|VALUES|WITH).+)"), "_insert"),
    (_re(r"DELETE\s+FROM\s+(?P<n>\w+)(?:\s+WHERE\s+(?P<w>.+))?"), "_delete"),
    (_re(r"UPDATE\s+(?P<n>\w+)\s+SET\s+(?P<s>.+?)(?:\s+WHERE\s+(?P<w>.+))?"), "_update"),
    (_re(r"MERGE\s+INTO\s+(?P<t>\w+)(?:\s+(?:AS\s+)?(?P<ta>(?!USING\b)\w+))?\s+USING\s+(?P<s>\w+|\(.+?\))(?:\s+(?:AS\s+)?(?P<sa>(?!ON\b)\w+))?\s+ON\s+(?P<on>.+?)\s+(?P<rest>WHEN\s.+)"), "_merge"),
    (_re(r"ALTER\s+TABLE\s+(?P<n>\w+)\s+(?P<a>.+)"), "_alter"),
    (_re(r"TRUNCATE\s+TABLE\s+(?P<n>\w+)"), "_truncate"),
    (_re(r"COPY\s+(?P<q>\w+|\(.+\))\s+TO\s+'(?P<p>[^']*)'(?:\s*(?:STORED\s+AS\s+|\(\s*FORMAT\s+)(?P<f>\w+)\s*\)?)?"), "_copy"),
    (_re(r"ANALYZE\s+TABLE\s+(?P<n>\w+)(?:\s+COMPUTE\s+STATISTICS.*)?"), "_analyze"),
    (_re(r"CALL\s+system\.(?P<f>\w+)\s*\((?P<a>.*)\)"), "_call"),
    (_re(r"CREATE\s+(?P<r>OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?(?:INCREMENTAL\s+|MATERIALIZED\s+)VIEW\s+(?P<n>\w+)\s+AS\s+(?P<q>.+)"), "_incremental_view"),
    (_re(r"DECLARE\s+RECURSIVE\s+VIEW\s+(?P<n>\w+)\s+AS\s+(?P<q>.+)"), "_recursive_view"),
    (_re(r"REFRESH\s+(?:MATERIALIZED\s+|INCREMENTAL\s+)+VIEW\s+(?P<n>\w+)"), "_refresh_view"),
    (_re(r"DROP\s+(?:MATERIALIZED\s+|INCREMENTAL\s+)+VIEW\s+(?:IF\s+EXISTS\s+)?(?P<n>\w+)"), "_drop_view"),
    (_re(r"CREATE\s+(?P<r>OR\s+REPLACE\s+)?STREAMING\s+TABLE\s+(?P<n>\w+)\s+AS\s+(?P<q>.+)"), "_streaming_table"),
    (_re(r"REFRESH\s+STREAMING\s+TABLE\s+(?P<n>\w+)"), "_refresh_streaming"),
    (_re(r"DROP\s+STREAMING\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?P<n>\w+)"), "_drop_streaming"),
    (_re(r"CREATE\s+(?:OR\s+REPLACE\s+)?LIVE\s+TABLE\s+(?P<n>\w+)\s+AS\s+(?P<q>.+)"), "_live_table"),
    (_re(r"REFRESH\s+LIVE\s+TABLE\s+(?P<n>\w+)"), "_refresh_live"),
    (_re(r"DROP\s+LIVE\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?P<n>\w+)"), "_drop_live"),
    (_re(r"DROP\s+(?P<k>TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?(?P<n>\w+)"), "_drop"),
    (_re(r"CREATE\s+(?P<k>SOURCE|SINK)\s+(?P<n>\w+)\s+WITH\s*\((?P<o>.+)\)"), "_connector"),
    (_re(r"(?:START|REFRESH)\s+PIPELINE\s+(?P<n>\w+)(?:\s+FULL)?"), "_start_pipeline"),
    (_re(r"SELECT\s+\*\s+FROM\s+(?P<t>\w+)\s+MATCH_RECOGNIZE\s*\(\s*PARTITION\s+BY\s+(?P<k>\w+)\s+ORDER\s+BY\s+(?P<ts>\w+)\s+PATTERN\s*\((?P<pat>[^)]*)\)(?:\s+WITHIN\s+(?P<w>\d+)\s+(?P<u>\w+))?\s*\)"), "_match_recognize"),
    (_re(r".*\binformation_schema\.\w+.*"), "_information_schema"),
    (_re(r"CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(?P<n>\w+)\s*\((?P<a>.*?)\)\s*RETURNS\s+(?P<r>TABLE\s*\(.*?\)|[\w()\s,]+?)\s+LANGUAGE\s+SQL\s+AS\s+'(?P<b>.*)'"), "_create_function"),
]

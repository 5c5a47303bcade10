"""Versioned tables over plain Parquet: snapshots, DML, time travel, maintenance.

A table is a folder with numbered version files, each naming the Parquet folders
that make it up.  A commit creates the next number's file, which fails if
another writer has created it; readers of older versions are never disturbed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import delete_path, filesystem, path_exists, read_text, write_text

from .files import check_evolution


#: What compaction makes files of.
TARGET_BYTES = 256 << 20


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; read again and retry."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = ()):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)

    # log
    def _log(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[dict]:
        """All versions, oldest first: version, time, operation, schema, folders."""
        fs, p = filesystem(self.spark, f"{self.path}/_versions")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        return [json.loads(read_text(self.spark, n)) for n in names]

    def current_version(self) -> int:
        v = self.versions()
        return v[-1]["version"] if v else -1

    def _entry(self, version: int | None = None, timestamp: float | None = None, ref: str | None = None) -> dict:
        if ref is not None:
            version = self.refs()[ref]
        entries = self.versions()
        if timestamp is not None:
            entries = [e for e in entries if e["time"] <= timestamp]
        elif version is not None:
            entries = [e for e in entries if e["version"] == version]
        if not entries:
            raise ValueError("the table has no such version")
        return entries[-1]

    def _commit(self, folders: list[str], schema: T.StructType, operation: str, base: int | None = None, **details) -> int:
        last = self.current_version()
        if base is not None and base != last:
            raise ConcurrentCommit(f"version {last} came after {base}")
        kept = self._entry().get("partitions", []) if last >= 0 else []
        entry = {"version": last + 1, "time": time.time(), "operation": operation, "schema": schema.json(), "folders": folders, "partitions": kept} | details
        try:
            write_text(self.spark, self._log(last + 1), json.dumps(entry))
        except Exception as e:
            if path_exists(self.spark, self._log(last + 1)):
                raise ConcurrentCommit(f"version {last + 1} exists already") from e
            raise
        return last + 1

    def partitions(self) -> list[str]:
        """The columns by which the table's rows lie in folders; rewrites keep to them."""
        return self._entry().get("partitions", []) if self.exists() else []

    def _write(self, df: DataFrame, partition_by: Sequence[str] | None = None) -> str:
        name = f"data/{uuid.uuid4().hex}"
        partition_by = [c for c in (self.partitions() if partition_by is None else partition_by) if c in df.columns]
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{name}")
        return name

    # reading
    def read(self, version: int | None = None, timestamp: float | None = None, ref: str | None = None) -> DataFrame:
        """The latest snapshot, or the one of a version, of a time (seconds since 1970), or of a named reference."""
        e = self._entry(version, timestamp, ref)
        schema = T.StructType.fromJson(json.loads(e["schema"]))
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        if not e["folders"]:
            return self.spark.createDataFrame([], schema)
        # each folder is read on its own: partition columns differ between writes
        return self._folders(e["folders"], schema)

    def exists(self) -> bool:
        return self.current_version() >= 0

    # writing
    def append(self, df: DataFrame, evolution: str = "strict", partition_by: Sequence[str] | None = None, **details) -> int:
        """``details`` are kept with the version."""
        base = self.current_version()
        if base < 0:
            return self._commit([self._write(df, partition_by or [])], df.schema, "append", base, partitions=list(partition_by or []), **details)
        e = self._entry()
        old = T.StructType.fromJson(json.loads(e["schema"]))
        check_evolution(_loose(old), _loose(df.schema), evolution)
        names = {f.name for f in old}
        merged = T.StructType([*old.fields, *[f for f in df.schema if f.name not in names]])
        return self._commit([*e["folders"], self._write(df, partition_by)], merged, "append", base, **details)

    def overwrite(self, df: DataFrame, partition_by: Sequence[str] | None = None, where: str | None = None) -> int:
        """All rows, or with ``where`` only those that satisfy it."""
        base = self.current_version()
        if where is not None and base >= 0:
            df = self.read().where(f"NOT coalesce(({where}), false)").unionByName(df)
        kept = self.partitions() if partition_by is None else list(partition_by)
        return self._commit([self._write(df, kept)], df.schema, "overwrite", base, partitions=kept)

    def _hits(self, hit: Column) -> tuple[list[str], list[str], int]:
        """Folders with a row for which ``hit`` holds, the others, and how many such rows there are.

        Rewrites touch only the former.  The folders are counted in one pass.
        """
        folders, now = self._entry()["folders"], self.read()
        if len(folders) < 2:
            n = now.where(hit).count()
            return (folders if n else []), ([] if n else folders), n
        rows = None
        for i, f in enumerate(folders):
            part = self._folder(f, now.schema).where(hit).select(F.lit(i).alias("i"))
            rows = part if rows is None else rows.unionByName(part)
        found = {r["i"]: r["count"] for r in rows.groupBy("i").count().collect()}
        return [f for i, f in enumerate(folders) if i in found], [f for i, f in enumerate(folders) if i not in found], sum(found.values())

    def _folder(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").select(*[F.col(f"`{f.name}`") for f in schema])

    def _folders(self, folders: list[str], schema: T.StructType) -> DataFrame:
        out = None
        for f in folders:
            part = self._folder(f, schema)
            out = part if out is None else out.unionByName(part)
        return out

    def delete(self, where: str) -> int:
        """Rows for which the condition is true go; returns how many."""
        base, schema = self.current_version(), self.read().schema
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched, others, n = self._hits(hit)
        if n:
            self._commit([*others, self._write(self._folders(touched, schema).where(~hit))], schema, "delete", base, rows=n)
        return n

    def update(self, assignments: dict[str, str | Column], where: str | None = None) -> int:
        """Returns the number of rows changed."""
        base, schema = self.current_version(), self.read().schema
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        touched, others, n = self._hits(hit)
        if n:
            now = self._folders(touched, schema)
            new = now.select(*[F.when(hit, (F.expr(a) if isinstance(a := assignments[c], str) else a).cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if c in assignments else F.col(f"`{c}`") for c, t in now.dtypes])
            self._commit([*others, self._write(new)], schema, "update", base, rows=n)
        return n

    def merge(self, source: DataFrame, on: Sequence[str], matched: dict[str, str] | str | None = "all", not_matched: dict[str, str] | str | None = "all", delete_when: str | None = None, insert_when: str | None = None) -> dict[str, int]:
        """Rows with the source's key are updated (or deleted where ``delete_when`` holds), others inserted (where ``insert_when`` holds).

        Expressions name columns as ``t.x`` and ``s.x``.  A full outer join decides
        every row in one pass; two source rows for one target row are an error.
        """
        base, now = self.current_version(), self.read()
        twice = source.groupBy(*on).count().where("count > 1")
        if not twice.isEmpty() and not twice.join(now.select(*on), list(on), "left_semi").isEmpty():
            raise ValueError("several source rows match one target row")
        t, s = now.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
        cond = None
        for k in on:
            one = F.col(f"t.{k}") == F.col(f"s.{k}")
            cond = one if cond is None else cond & one
        both = F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull()
        only_s = F.col("t.__t").isNull()
        gone = (both & F.coalesce(F.expr(delete_when), F.lit(False))) if delete_when else F.lit(False)
        skip = only_s if not_matched is None else (only_s & ~F.coalesce(F.expr(insert_when), F.lit(False))) if insert_when else F.lit(False)
        have = set(source.columns)

        def value(c: str, spec, own: Column) -> Column:
            if spec is None:
                return own
            if spec == "all":
                return F.col(f"s.{c}") if c in have else own
            return F.expr(spec[c]) if c in spec else own

        joined = t.join(s, cond, "full").where(~gone & ~skip)
        cols = [
            F.when(both, value(c, matched, F.col(f"t.{c}"))).when(only_s, value(c, not_matched, F.lit(None))).otherwise(F.col(f"t.{c}")).cast(kind).alias(c)
            for c, kind in now.dtypes
        ]
        m = t.join(s, cond, "full").agg(F.sum((both & ~gone).cast("long")), F.sum(gone.cast("long")), F.sum((only_s & ~skip).cast("long"))).first()
        counts = {"updated": (m[0] or 0) if matched is not None else 0, "deleted": m[1] or 0, "inserted": m[2] or 0}
        self._commit([self._write(joined.select(*cols))], now.schema, "merge", base, **counts)
        return counts

    def upsert(self, changes: DataFrame, order: str, deleted: str | None = None) -> dict[str, int]:
        """The last change of each key wins; rows whose ``deleted`` column is true go."""
        if not self.key:
            raise ValueError("upserts need a table with a key")
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns]), F.col(order)).alias("__row")).select("__row.*")
        if deleted:
            gone = last.where(F.coalesce(F.col(deleted), F.lit(False)))
            base = self.current_version()
            kept = last.where(~F.coalesce(F.col(deleted), F.lit(False)))
            now = self.read()
            names = now.columns
            new = now.join(last.select(*self.key), self.key, "left_anti").unionByName(kept.select(*names))
            counts = {"deleted": gone.join(now.select(*self.key), self.key, "left_semi").count(), "upserted": kept.count()}
            self._commit([self._write(new)], now.schema, "upsert", base, **counts)
            return counts
        return self.merge(last, self.key)

    # schema
    def add_column(self, name: str, kind: str) -> int:
        now = self.read()
        if name in now.columns:
            raise ValueError(f"column {name} exists")
        return self._commit(self._entry()["folders"], T.StructType([*now.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]), "add column")

    def drop_column(self, name: str) -> int:
        now = self.read().drop(name)
        return self._commit([self._write(now)], now.schema, "drop column")

    def rename_column(self, old: str, new: str) -> int:
        now = self.read()
        if old not in now.columns:
            raise ValueError(f"no column {old}")
        now = now.withColumnRenamed(old, new)
        return self._commit([self._write(now)], now.schema, "rename column")

    def truncate(self) -> int:
        return self._commit([], self.read().schema, "truncate")

    def restore(self, version: int) -> int:
        e = self._entry(version)
        return self._commit(e["folders"], T.StructType.fromJson(json.loads(e["schema"])), "restore")

    # references
    def refs(self) -> dict[str, int]:
        p = f"{self.path}/_refs.json"
        return json.loads(read_text(self.spark, p)) if path_exists(self.spark, p) else {}

    def tag(self, name: str, version: int | None = None) -> None:
        refs = self.refs() | {name: self.current_version() if version is None else version}
        write_text(self.spark, f"{self.path}/_refs.json", json.dumps(refs), overwrite=True)

    # maintenance
    def compact(self, files: int | None = None, target_bytes: int = TARGET_BYTES) -> int:
        """Rewrite into files of about ``target_bytes``, or into ``files`` of them; each partition has files of its own."""
        now, parts = self.read(), self.partitions()
        if files is None:
            files = max(1, -(-self.size() // target_bytes))
        # partitions share the tasks by a hash of their columns and of the row, so that a large one is dealt to several
        rows = now.repartition(files, *[F.col(f"`{c}`") for c in parts], F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in now.columns if c not in parts]), F.lit(files))) if parts else now.repartition(files) if files > now.rdd.getNumPartitions() else now.coalesce(files)
        return self._commit([self._write(rows)], now.schema, "compact")

    def size(self) -> int:
        """Bytes of the current version's files."""
        total = 0
        for f in self._entry()["folders"]:
            fs, p = filesystem(self.spark, f"{self.path}/{f}")
            total += fs.getContentSummary(p).getLength()
        return total

    def expire(self, keep: int = 1) -> list[int]:
        """Forget all but the last ``keep`` versions and those with a name; their folders stay until orphans are removed."""
        named = set(self.refs().values())
        gone = [e["version"] for e in self.versions()[:-keep] if e["version"] not in named]
        for v in gone:
            delete_path(self.spark, self._log(v))
        return gone

    def remove_orphans(self) -> list[str]:
        used = {f for e in self.versions() for f in e["folders"]}
        fs, p = filesystem(self.spark, f"{self.path}/data")
        if not fs.exists(p):
            return []
        gone = [n for s in fs.listStatus(p) if (n := f"data/{s.getPath().getName()}") not in used]
        for n in gone:
            delete_path(self.spark, f"{self.path}/{n}")
        return gone

    def changes(self, before: int, after: int | None = None) -> DataFrame:
        """Weighted difference between two versions."""
        from tessera.ivm.zset import ZSet

        new = self.read(after)
        return ZSet.differentiate(self.read(before).select(*new.columns), new).df


def _loose(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

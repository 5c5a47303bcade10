"""Change data capture: Debezium envelopes to changes, and changes to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.ivm.zset import WEIGHT, ZSet
from tessera.storage import delete_path, state_path

from .versioned import VersionedTable


def parse_envelopes(df: DataFrame, column: str, row: T.StructType | str) -> DataFrame:
    """(op, before, after, ts_ms, lsn, table, event_key) of JSON envelopes, with or without a ``payload`` wrapper.

    ``op`` is c, u, d or r; a text that is no envelope gives NULLs.  ``event_key``
    is the same for a repeated delivery.
    """
    kind = row if isinstance(row, str) else row.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    body = f"op STRING, before STRUCT<{kind}>, after STRUCT<{kind}>, source STRUCT<ts_ms: BIGINT, lsn: BIGINT, table: STRING>"
    # only texts that may name a payload (or spell it with escapes) are searched for one
    text = F.coalesce(F.when(F.col(column).contains("payload") | F.col(column).contains("\\u"), F.get_json_object(column, "$.payload")), F.col(column))
    # exploded, as each field and filter would else parse the text anew
    out = df.withColumn("__e", F.explode(F.array(F.from_json(text, body)))).select("__e.op", "__e.before", "__e.after", F.col("__e.source.ts_ms").alias("ts_ms"), F.col("__e.source.lsn").alias("lsn"), F.col("__e.source.table").alias("table"))
    return out.withColumn("event_key", F.sha2(F.concat_ws("|", "table", F.col("lsn").cast("string"), "op"), 256))


def to_zset(envelopes: DataFrame) -> ZSet:
    """Creates and reads add the row after, deletes remove the row before, updates do both."""
    pieces = F.array_compact(F.array(
        F.when(F.col("op").isin("u", "d"), F.struct(F.lit(-1).alias("w"), F.col("before").alias("r"))),
        F.when(F.col("op").isin("c", "r", "u"), F.struct(F.lit(1).alias("w"), F.col("after").alias("r"))),
    ))
    rows = envelopes.select(F.explode(pieces).alias("x")).where("x.r IS NOT NULL")
    return ZSet(rows.select("x.r.*", F.col("x.w").cast("long").alias(WEIGHT)))


def apply_changes(table: VersionedTable, envelopes: DataFrame, key: Sequence[str]) -> dict[str, int]:
    """Bring a table up to date: of each key the change with the highest (ts_ms, lsn) counts."""
    row = F.coalesce(F.col("after"), F.col("before"))
    changes = envelopes.where("op IS NOT NULL").select(row.alias("r"), (F.col("op") == "d").alias("__gone"), F.struct("ts_ms", "lsn").alias("__order"))
    flat = changes.select("r.*", "__gone", "__order")
    last = flat.groupBy(*key).agg(F.max_by(F.struct(*[c for c in flat.columns if c != "__order"]), "__order").alias("x")).select("x.*")
    if not table.exists():
        table.append(last.where("NOT __gone").drop("__gone"))
        return {"updated": 0, "deleted": 0, "inserted": table.read().count()}
    have = table.read().columns
    # a merge reads its source several times, the log is read once
    path = state_path(table.spark, "changes")
    try:
        last.write.parquet(path)
        last = table.spark.read.schema(last.schema).parquet(path)
        return table.merge(last, key, matched={c: f"s.{c}" for c in have}, not_matched={c: f"s.{c}" for c in have}, delete_when="s.__gone", insert_when="NOT s.__gone")
    finally:
        delete_path(table.spark, path)


def route(envelopes: DataFrame, tables: Sequence[str]) -> dict[str, DataFrame]:
    """One DataFrame of changes for each listed table."""
    return {t: envelopes.where(F.col("table") == t) for t in tables}

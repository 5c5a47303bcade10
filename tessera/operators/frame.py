"""Relational operators that plain DataFrame methods don't cover, or cover with another meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as TF

JOIN_TYPES = {
    "inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "cross": "cross",
    "leftsemi": "left_semi", "leftanti": "left_anti", "left_semi": "left_semi", "left_anti": "left_anti",
}


def order_by(df: DataFrame, columns: Sequence[str], descending: Sequence[bool] | None = None) -> DataFrame:
    """Sort with NULLs last when ascending and first when descending."""
    flags = descending or [False] * len(columns)
    return df.orderBy(*[TF.desc(c) if d else TF.asc(c) for c, d in zip(columns, flags, strict=True)])


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; a column that doesn't exist is an error."""
    if old not in df.columns:
        raise ValueError(f"no column {old!r}")
    return df.withColumnRenamed(old, new)


def rename_all(df: DataFrame, names: dict[str, str]) -> DataFrame:
    for old in names:
        if old not in df.columns:
            raise ValueError(f"no column {old!r}")
    return df.withColumnsRenamed(names)


def join(left: DataFrame, right: DataFrame, how: str, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> DataFrame:
    """Equi-join on pairs of columns; right semi and anti joins are their mirror images."""
    right_on = right_on or left_on
    how = how.lower().replace(" ", "")
    if how in ("rightsemi", "rightanti", "right_semi", "right_anti"):
        return join(right, left, "left" + how.removeprefix("right").replace("_", ""), right_on, left_on)
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    if how == "cross" or not left_on:
        return left.crossJoin(right)
    if list(left_on) == list(right_on):
        return left.join(right, list(left_on), JOIN_TYPES[how])
    cond = None
    for a, b in zip(left_on, right_on, strict=True):
        one = left[a] == right[b]
        cond = one if cond is None else cond & one
    return left.join(right, cond, JOIN_TYPES[how])


def pivot(df: DataFrame, groups: Sequence[str], column: str, aggregate: Column, values: Sequence) -> DataFrame:
    """One column for each listed value, one row for each group (one row for no groups)."""
    return df.groupBy(*groups).pivot(column, list(values)).agg(aggregate)


def unpivot(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A row for each listed column; other columns and NULL values stay."""
    rest = [c for c in df.columns if c not in set(columns)]
    return df.unpivot(rest, list(columns), name, value)


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def fill_null(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    return df.sample(fraction, seed)


def heavy_hitters(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys: counts are combined before the shuffle, and only k rows are sorted globally."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), TF.asc(key)).limit(k)


def late_materialized_top(df: DataFrame, key: Sequence[str], measure: Column, n: int, wide: DataFrame) -> DataFrame:
    """Top n groups by a measure, grouped on the key alone; wide columns are fetched for the n winners only."""
    top = df.groupBy(*key).agg(measure.alias("measure")).orderBy(TF.desc("measure"), *[TF.asc(k) for k in key]).limit(n)
    return wide.join(F.broadcast(top), list(key))


def salted_aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 16) -> DataFrame:
    """Two-step aggregation for aggregates without map-side combining, whose hot keys would land in one task."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def analyze(df: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values, least and greatest of each column, in one pass over the data."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count(F.when(x.isNull(), 1)).alias(f"nulls{i}"), F.approx_count_distinct(x).alias(f"distinct{i}"), F.min(x).cast("string").alias(f"min{i}"), F.max(x).cast("string").alias(f"max{i}")]
    one = df.agg(*aggs)
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"distinct{i}").alias("distinct"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(lines))


def align(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` by name and type; missing ones are NULL, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

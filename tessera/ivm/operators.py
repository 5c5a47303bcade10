"""Operators whose output delta depends on a delta and on state, not on all rows.

Each takes the state before a tick and the tick's delta and returns the output
delta and the state after it.  States are ZSets; whoever runs the ticks writes
them to shared storage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zset import WEIGHT, ZSet


def distinct(before: ZSet | None, delta: ZSet) -> tuple[ZSet, ZSet]:
    """+1 where a row's weight becomes positive, -1 where it stops to be.  State: all weights."""
    d = delta.consolidate()
    if before is None:
        return ZSet(d.df.where(F.col(WEIGHT) > 0).withColumn(WEIGHT, F.lit(1))), d
    cond = None
    for i, c in enumerate(d.columns):
        one = F.col(f"`{c}`").eqNullSafe(F.col(f"__o{i}"))
        cond = one if cond is None else cond & one
    # only the delta's rows are looked up, so the state may be a log whose weights add up
    old = before.df.select(*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(before.columns)], F.col(WEIGHT).alias("__old"))
    old = old.join(d.df.select(*d.columns), cond, "left_semi").groupBy(*[f"__o{i}" for i in range(len(before.columns))]).agg(F.sum("__old").alias("__old"))
    was = F.coalesce(F.col("__old"), F.lit(0))
    both = d.df.join(old, cond, "left").withColumn("__was", was).withColumn("__is", was + F.col(WEIGHT))
    out = both.withColumn(WEIGHT, F.when((F.col("__was") <= 0) & (F.col("__is") > 0), 1).when((F.col("__was") > 0) & (F.col("__is") <= 0), -1).otherwise(0))
    return ZSet(out.select(*d.columns, WEIGHT)).drop_zeros(), d.integrate(before)


def join(left: ZSet | None, right: ZSet | None, d_left: ZSet | None, d_right: ZSet | None, on: Sequence[str]) -> tuple[ZSet | None, ZSet | None, ZSet | None]:
    """Inner join: dL with R, L with dR, dL with dR.  Returns delta and both states."""
    parts = []
    if d_left is not None and right is not None:
        parts.append(d_left.join(right, on))
    if left is not None and d_right is not None:
        parts.append(left.join(d_right, on))
    if d_left is not None and d_right is not None:
        parts.append(d_left.join(d_right, on))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.concat(p)
    return (
        out.consolidate() if out is not None else None,
        d_left.integrate(left) if d_left is not None else left,
        d_right.integrate(right) if d_right is not None else right,
    )


def left_join(left: ZSet | None, right: ZSet | None, d_left: ZSet, d_right: ZSet, on: Sequence[str]) -> tuple[ZSet, ZSet, ZSet]:
    """Left outer join: inner part plus left rows, right columns NULL, of keys whose right weight is 0.

    Only keys that the tick touches are looked at: their left rows before and
    after are joined with their right rows before and after, and differenced.
    """
    keys = d_left.df.select(*on).unionByName(d_right.df.select(*on)).distinct().toDF(*[f"__k{i}" for i in range(len(on))])
    # a NULL key joins nothing, but the rows that hold it are touched like any others
    touched = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)])

    def side(state: ZSet | None, like: ZSet) -> ZSet:
        return ZSet(state.df.join(keys, touched, "left_semi")).consolidate() if state is not None else ZSet(like.df.where(F.lit(False)))

    now_left, now_right = (d.concat(s) if s is not None else d for d, s in ((d_left, left), (d_right, right)))

    def outer(a: ZSet, b: ZSet) -> ZSet:
        r = b.df.withColumnRenamed(WEIGHT, "__w2")
        j = a.df.join(r, list(on), "left").withColumn("__w", F.col(WEIGHT) * F.coalesce(F.col("__w2"), F.lit(1)))
        return ZSet(j.drop(WEIGHT, "__w2").withColumnRenamed("__w", WEIGHT))

    old = outer(side(left, d_left), side(right, d_right))
    new = outer(side(now_left, d_left), side(now_right, d_right))
    return new.concat(old.negate()).consolidate(), d_left.integrate(left), d_right.integrate(right)


@dataclass(frozen=True)
class Agg:
    """One aggregate: kind is count, count_col, sum, avg, min or max."""

    kind: str
    column: str | None
    alias: str


def aggregate(before: ZSet | None, delta: ZSet, keys: Sequence[str], aggs: Sequence[Agg]) -> tuple[ZSet, ZSet]:
    """Aggregates by key with retraction: -1 for a touched key's old row, +1 for its new one.

    The state is the weighted multiset of (keys, aggregated columns): sums could
    do with less, but least and greatest values can only be taken back if the
    other values are known.  Only touched keys are aggregated again; NULL keys
    form a group.
    """
    d = aggregate_input(delta, keys, aggs)
    now = d.concat(before) if before is not None else d
    touched = d.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()

    def result(state: ZSet | None) -> ZSet | None:
        if state is None:
            return None
        rows = ZSet(_of_keys(state.df, touched, keys)).consolidate().df
        grouped = rows.groupBy(*keys).agg(F.sum(WEIGHT).alias("__rows"), *[_expression(a).alias(a.alias) for a in aggs])
        grouped = grouped.where(F.col("__rows") > 0)
        return ZSet(grouped.drop("__rows").withColumn(WEIGHT, F.lit(1)))

    new, old = result(now), result(before)
    return (new.concat(old.negate()) if old is not None else new).consolidate(), d.integrate(before)


def aggregate_input(delta: ZSet, keys: Sequence[str], aggs: Sequence[Agg]) -> ZSet:
    """What of a delta the aggregate needs."""
    needed = list(dict.fromkeys([*keys, *[a.column for a in aggs if a.column]]))
    return ZSet(delta.df.select(*needed, WEIGHT)).consolidate()


def _of_keys(df: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return df
    return df.join(touched, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]), "left_semi")


def additive(types: dict[str, str], aggs: Sequence[Agg]) -> bool:
    """Whether sums and counts are all that is needed and come out exact: no least or greatest values, no floating point."""
    return all(a.kind in ("count", "count_col") or (a.kind in ("sum", "avg") and types[a.column].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal")) for a in aggs)


def sums(delta: ZSet, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """A row for each key with what the delta adds to its number of rows, and to each column's sum and number of values."""
    w, out = F.col(WEIGHT), [F.sum(WEIGHT).alias("__rows")]
    for c in dict.fromkeys(a.column for a in aggs if a.column):
        out += [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0)).alias(f"__n_{c}")]
        if any(a.column == c and a.kind in ("sum", "avg") for a in aggs):
            out += [F.coalesce(F.sum(F.col(c) * w), F.lit(0)).alias(f"__s_{c}")]
    return delta.df.groupBy(*keys).agg(*out)


def added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``sums`` of several deltas put together."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def aggregate_sums(before: DataFrame | None, change: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> ZSet:
    """The delta of an aggregate whose state is ``sums``: as large as the number of keys, not of rows."""
    touched = change.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])

    def result(state: DataFrame) -> ZSet:
        total = added(_of_keys(state, touched, keys), keys).where("__rows > 0")
        made = {
            "count": lambda a: F.col("__rows"), "count_col": lambda a: F.col(f"__n_{a.column}"),
            "sum": lambda a: F.when(F.col(f"__n_{a.column}") > 0, F.col(f"__s_{a.column}")), "avg": lambda a: F.when(F.col(f"__n_{a.column}") > 0, F.col(f"__s_{a.column}") / F.col(f"__n_{a.column}")),
        }
        return ZSet(total.select(*keys, *[made[a.kind](a).alias(a.alias) for a in aggs], F.lit(1).alias(WEIGHT)))

    if before is None:
        return result(change).consolidate()
    return result(before.unionByName(change)).concat(result(before).negate()).consolidate()


def _expression(a: Agg) -> Column:
    w = F.col(WEIGHT)
    if a.kind == "count":
        return F.sum(w)
    x = F.col(a.column)
    there = F.when(x.isNotNull(), w)
    if a.kind == "count_col":
        return F.coalesce(F.sum(there), F.lit(0))
    if a.kind == "sum":
        return F.sum(x * w)
    if a.kind == "avg":
        return F.sum(x * w) / F.nullif(F.sum(there), F.lit(0))
    if a.kind in ("min", "max"):
        return getattr(F, a.kind)(F.when(w > 0, x))
    raise ValueError(f"unknown aggregate {a.kind!r}")

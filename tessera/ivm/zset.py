"""Weighted rows: a DataFrame whose last column says how often each row is added or removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"
CHANGE = "_change_type"


class ZSet:
    """Rows with weights; +n inserts, -n retracts.  All operations are lazy DataFrame operations."""

    def __init__(self, df: DataFrame):
        if WEIGHT not in df.columns:
            raise ValueError(f"a weighted table needs a column {WEIGHT}")
        self.columns = [c for c in df.columns if c != WEIGHT]
        self.df = df.select(*[F.col(f"`{c}`") for c in self.columns], F.col(WEIGHT).cast("long").alias(WEIGHT))

    # making them
    @classmethod
    def inserts(cls, df: DataFrame) -> ZSet:
        return cls(df.withColumn(WEIGHT, F.lit(1)))

    @classmethod
    def deletes(cls, df: DataFrame) -> ZSet:
        return cls(df.withColumn(WEIGHT, F.lit(-1)))

    @classmethod
    def update(cls, before: DataFrame, after: DataFrame) -> ZSet:
        return cls.deletes(before).concat(cls.inserts(after))

    @classmethod
    def changes(cls, df: DataFrame) -> ZSet:
        """From a changelog: insert and update_after add, delete and update_before remove."""
        kind = F.lower(F.col(CHANGE))
        w = F.when(kind.isin("insert", "update_after", "update_postimage"), 1).when(kind.isin("delete", "update_before", "update_preimage"), -1)
        return cls(df.withColumn(WEIGHT, w).drop(CHANGE))

    @classmethod
    def differentiate(cls, before: DataFrame, after: DataFrame) -> ZSet:
        """What turns one bag of rows into the other."""
        return cls.inserts(after).concat(cls.deletes(before)).consolidate()

    # algebra
    def negate(self) -> ZSet:
        return ZSet(self.df.withColumn(WEIGHT, -F.col(WEIGHT)))

    def concat(self, other: ZSet) -> ZSet:
        return ZSet(self.df.unionByName(other.df))

    def consolidate(self, keys: Sequence[str] | None = None) -> ZSet:
        """One row for each distinct row (or key) with its summed weight; zeros go."""
        cols = list(keys or self.columns)
        return ZSet(self.df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0))

    normalize = consolidate

    def drop_zeros(self) -> ZSet:
        return ZSet(self.df.where(F.col(WEIGHT) != 0))

    def positive(self) -> ZSet:
        return ZSet(self.df.where(F.col(WEIGHT) > 0))

    def negative(self) -> ZSet:
        return ZSet(self.df.where(F.col(WEIGHT) < 0))

    def expanded(self) -> DataFrame:
        """Plain rows: each as often as its positive weight says."""
        return self.df.where(F.col(WEIGHT) > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col(WEIGHT)))).select(*[F.col(f"`{c}`") for c in self.columns])

    def integrate(self, state: ZSet | None) -> ZSet:
        """State plus this delta."""
        return (state.concat(self) if state is not None else self).consolidate()

    def changelog(self) -> DataFrame:
        """Insert and delete rows, each as often as its weight says."""
        kind = F.when(F.col(WEIGHT) > 0, F.lit("insert")).otherwise(F.lit("delete"))
        rows = self.df.where(F.col(WEIGHT) != 0).withColumn(CHANGE, kind).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(WEIGHT))))
        return rows.drop("__n", WEIGHT)

    # linear operators
    def filter(self, condition: str | Column) -> ZSet:
        return ZSet(self.df.where(condition))

    def project(self, *columns: str | Column) -> ZSet:
        return ZSet(self.df.select(*columns, WEIGHT))

    def map(self, **columns: Column) -> ZSet:
        return ZSet(self.df.select(*[c.alias(n) for n, c in columns.items()], WEIGHT))

    def join(self, other: ZSet, on: Sequence[str]) -> ZSet:
        """Inner join; weights multiply."""
        right = other.df.withColumnRenamed(WEIGHT, "__w2")
        joined = self.df.join(right, list(on)).withColumn("__w", F.col(WEIGHT) * F.col("__w2"))
        return ZSet(joined.drop(WEIGHT, "__w2").withColumnRenamed("__w", WEIGHT))

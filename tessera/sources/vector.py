"""Vector collections: upserts, deletes and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclidean": (euclidean, False)}


def nearest(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id_column: str = "vec_id", metric: str = "cosine", where: str | Column | None = None) -> DataFrame:
    """The k best rows for one query, by an exact scan: every task keeps its own k best, which are merged.

    ``where`` filters on payload columns before anything is computed.
    """
    f, larger = METRICS[metric]
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(where) if where is not None else vectors
    scored = rows.withColumn("score", f(F.col(vector), q))
    return scored.orderBy(F.desc_nulls_last("score") if larger else F.asc_nulls_last("score"), id_column).limit(k)


class VectorCollection:
    """A collection on a versioned table."""

    def __init__(self, table, id_column: str = "vec_id", vector: str = "embedding"):
        self.table, self.id_column, self.vector = table, id_column, vector

    def upsert_batch(self, rows: DataFrame) -> None:
        if self.table.exists():
            self.table.merge(rows, [self.id_column])
        else:
            self.table.append(rows)

    def delete_by_ids(self, ids: DataFrame) -> None:
        now = self.table.read()
        self.table.overwrite(now.join(ids.select(self.id_column), self.id_column, "left_anti"))

    def query_nearest(self, query: Sequence[float], k: int, metric: str = "cosine", where: str | None = None) -> DataFrame:
        return nearest(self.table.read(), query, k, self.vector, self.id_column, metric, where)

    def follow(self, flow, view: str) -> None:
        """Keep the collection equal to an incremental view: each tick's new rows are put in, those taken back go.

        The view has the id and the vector among its columns, and one row for each id.
        """

        def apply(delta: DataFrame) -> None:
            new = delta.where("_weight > 0").drop("_weight")
            gone = delta.where("_weight < 0").select(self.id_column).join(new.select(self.id_column), self.id_column, "left_anti")
            if self.table.exists() and not gone.isEmpty():
                self.delete_by_ids(gone)
            if not new.isEmpty():
                self.upsert_batch(new)

        flow.watch(view, apply)

"""Incremental views: ticks give what running the query again would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ivm import IncrementalFlow, RecursiveView, ZSet
from tessera.storage import materialize

from .registry import register, table

DF, S = DataFrame, SparkSession


def _orders(spark: S, d: str) -> DF:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").cast("long").alias("price"))


def _customers(spark: S, d: str) -> DF:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")


def _ticks(flow: IncrementalFlow, orders: DF, customers: DF | None = None) -> None:
    """Three ticks: two thirds of the orders, the rest, and the retraction of every fifth; customers come in between."""
    flow.feed("orders_src", orders.where("o_orderkey % 3 <> 0"))
    if customers is not None:
        flow.feed("customers_src", customers.where("o_custkey % 2 = 0"))
    flow.step()
    flow.feed("orders_src", orders.where("o_orderkey % 3 = 0"))
    flow.step()
    flow.feed("orders_src", ZSet.deletes(orders.where("o_orderkey % 5 = 0")))
    if customers is not None:
        flow.feed("customers_src", customers.where("o_custkey % 2 = 1"))
    flow.step()


def _flow(spark: S, d: str, *views: tuple[str, str], joined: bool = False) -> IncrementalFlow:
    flow = IncrementalFlow(spark)
    orders, customers = _orders(spark, d), _customers(spark, d)
    flow.register_source("orders_src", orders)
    if joined:
        flow.register_source("customers_src", customers)
    for name, sql in views:
        flow.register_view(name, sql)
    _ticks(flow, orders, customers if joined else None)
    return flow


_SRC = "(SELECT o_orderkey, o_custkey, o_orderstatus, floor(o_totalprice)::BIGINT AS price FROM orders WHERE o_orderkey % 5 <> 0)"


@register("ivm_aggregate", f"SELECT o_orderstatus, count(*) AS n, sum(price)::BIGINT AS total, min(price) AS lo, max(price) AS hi, avg(price) AS mean FROM {_SRC} GROUP BY 1")
def ivm_aggregate(spark: S, d: str) -> DF:
    sql = "SELECT o_orderstatus, count(*) AS n, sum(price) AS total, min(price) AS lo, max(price) AS hi, avg(price) AS mean FROM orders_src GROUP BY o_orderstatus"
    return _flow(spark, d, ("v", sql)).snapshot("v")


@register("ivm_filter", f"SELECT o_orderkey, price FROM {_SRC} WHERE price > 200000")
def ivm_filter(spark: S, d: str) -> DF:
    return _flow(spark, d, ("v", "SELECT o_orderkey, price FROM orders_src WHERE price > 200000")).snapshot("v")


@register("ivm_distinct", f"SELECT DISTINCT o_custkey, o_orderstatus FROM {_SRC}")
def ivm_distinct(spark: S, d: str) -> DF:
    return _flow(spark, d, ("v", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders_src")).snapshot("v")


@register("ivm_join_inner", f"SELECT o_orderkey, c_mktsegment FROM {_SRC} JOIN customer ON c_custkey = o_custkey")
def ivm_join_inner(spark: S, d: str) -> DF:
    return _flow(spark, d, ("v", "SELECT o_orderkey, c_mktsegment FROM orders_src JOIN customers_src USING (o_custkey)"), joined=True).snapshot("v")


@register("ivm_join_left", f"SELECT c_custkey AS o_custkey, o_orderkey FROM customer LEFT JOIN {_SRC} ON c_custkey = o_custkey")
def ivm_join_left(spark: S, d: str) -> DF:
    return _flow(spark, d, ("v", "SELECT o_custkey, o_orderkey FROM customers_src LEFT JOIN orders_src USING (o_custkey)"), joined=True).snapshot("v")


@register("ivm_view_on_view", f"SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM {_SRC} GROUP BY 1) GROUP BY 1")
def ivm_view_on_view(spark: S, d: str) -> DF:
    return _flow(spark, d, ("per_customer", "SELECT o_custkey, count(*) AS n FROM orders_src GROUP BY o_custkey"), ("v", "SELECT n, count(*) AS customers FROM per_customer GROUP BY n")).snapshot("v")


@register("ivm_recomputed", f"SELECT o_custkey, price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC, o_orderkey) AS r FROM {_SRC}) WHERE r = 1")
def ivm_recomputed(spark: S, d: str) -> DF:
    sql = "SELECT o_custkey, price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC, o_orderkey) AS r FROM orders_src) WHERE r = 1"
    return _flow(spark, d, ("v", sql)).snapshot("v")


@register("zset_consolidate", "SELECT c_nationkey, (count(*) - 2 * count(*) FILTER (WHERE c_custkey % 3 = 0))::BIGINT AS _weight FROM customer GROUP BY 1 HAVING count(*) <> 2 * count(*) FILTER (WHERE c_custkey % 3 = 0)")
def zset_consolidate(spark: S, d: str) -> DF:
    c = table(spark, d, "customer")
    return ZSet.inserts(c.where("c_custkey % 3 <> 0").select("c_nationkey")).concat(ZSet.deletes(c.where("c_custkey % 3 = 0").select("c_nationkey"))).consolidate().df


@register("zset_differentiate", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END::BIGINT AS _weight FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)")
def zset_differentiate(spark: S, d: str) -> DF:
    o = table(spark, d, "orders").select("o_orderkey")
    return ZSet.differentiate(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")).df


@register("zset_integrate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def zset_integrate(spark: S, d: str) -> DF:
    o = table(spark, d, "orders").select("o_orderkey")
    return ZSet.deletes(o.where("o_orderkey % 7 = 0")).integrate(ZSet.inserts(o)).expanded()


@register("ivm_changelog", "SELECT o_orderstatus, 'insert' AS _change_type FROM orders GROUP BY 1")
def ivm_changelog(spark: S, d: str) -> DF:
    flow = IncrementalFlow(spark)
    orders = _orders(spark, d)
    flow.register_source("orders_src", orders)
    flow.register_view("v", "SELECT DISTINCT o_orderstatus FROM orders_src")
    flow.feed("orders_src", orders)
    flow.step()
    return flow.changes("v")


@register("recursive_view", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_nationkey + 5 FROM nation WHERE n_nationkey < 5 UNION SELECT r.a, n_nationkey + 5 FROM r JOIN nation ON n_nationkey = r.b WHERE n_nationkey + 5 < 25) SELECT a, b FROM r")
def recursive_view(spark: S, d: str) -> DF:
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), (F.col("n_nationkey") + 5).alias("y"))
    edges = materialize(edges, "edges")
    step = lambda fresh: fresh.join(edges.where("y < 25"), fresh.b == edges.x).select("a", F.col("y").alias("b"))
    return RecursiveView(step).run(edges.where("x < 5").select(F.col("x").alias("a"), F.col("y").alias("b")))


_NULLED = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END"


@register(
    "ivm_join_left_nulls",
    f"""
    SELECT o_orderkey, {_NULLED} AS o_custkey, c_mktsegment FROM orders
    LEFT JOIN (SELECT c_custkey AS k, c_mktsegment FROM customer) c ON k = {_NULLED}
    WHERE o_totalprice >= 100000
    """,
)
def ivm_join_left_nulls(spark: S, d: str) -> DF:
    """Rows with a NULL key, inserted in two ticks and in part taken back, against customers with a NULL key of their own."""
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    customers = _customers(spark, d)
    customers = customers.unionByName(customers.limit(1).withColumn("o_custkey", F.lit(None).cast("long")))
    flow = IncrementalFlow(spark)
    flow.register_source("orders_src", orders)
    flow.register_source("customers_src", customers)
    flow.register_view("v", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders_src LEFT JOIN customers_src USING (o_custkey)")
    flow.feed("orders_src", orders.where("o_totalprice < 200000"))
    flow.step()
    flow.feed("customers_src", customers)
    flow.feed("orders_src", orders.where("o_totalprice >= 200000"))
    flow.step()
    flow.feed("orders_src", ZSet.deletes(orders.where("o_totalprice < 100000")))
    flow.step()
    return flow.snapshot("v")


@register("ivm_partitioned", f"SELECT o_custkey, count(*) AS n, sum(price)::BIGINT AS total FROM {_SRC} GROUP BY 1")
def ivm_partitioned(spark: S, d: str) -> DF:
    from tessera.ivm import PartitionedFlow

    flow, orders = PartitionedFlow(spark, 3, {"orders_src": "o_custkey"}), _orders(spark, d)
    flow.register_source("orders_src", orders)
    flow.register_view("v", "SELECT o_custkey, count(*) AS n, sum(price) AS total FROM orders_src GROUP BY o_custkey")
    _ticks(flow, orders)
    return flow.snapshot("v")


@register("ivm_vector_view", "SELECT vec_id, label FROM embeddings WHERE label <> 0 AND vec_id >= 10")
def ivm_vector_view(spark: S, d: str) -> DF:
    """A collection that follows a view: inserted in two ticks, some taken back."""
    from tessera.sources.vector import VectorCollection
    from tessera.sources.versioned import VersionedTable
    from tessera.storage import state_path

    rows = table(spark, d, "embeddings")
    flow, kept = IncrementalFlow(spark), VectorCollection(VersionedTable(spark, state_path(spark, "vectors")))
    flow.register_source("vec_src", rows)
    flow.register_view("vec_view", "SELECT vec_id, embedding, label FROM vec_src WHERE label <> 0")
    kept.follow(flow, "vec_view")
    for z in (ZSet.inserts(rows.where("vec_id < 200")), ZSet.inserts(rows.where("vec_id >= 200")), ZSet.deletes(rows.where("vec_id < 10"))):
        flow.feed("vec_src", z)
        flow.step()
    return kept.table.read().select("vec_id", "label")

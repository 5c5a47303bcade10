"""Versioned tables, change data, quality, pipelines, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quality import Rule, check
from tessera.session import Engine
from tessera.sources import cdc, vector
from tessera.sources.versioned import VersionedTable
from tessera.storage import state_path

from .pipeline import MaterializedTable, Pipeline
from .registry import register, table

DF, S = DataFrame, SparkSession


def _orders(spark: S, d: str) -> VersionedTable:
    t = VersionedTable(spark, state_path(spark, "orders"), ["o_orderkey"])
    t.append(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return t


@register("lake_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 100000)")
def lake_delete(spark: S, d: str) -> DF:
    t = _orders(spark, d)
    t.delete("o_totalprice < 100000")
    return t.read().select("o_orderkey")


@register("lake_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def lake_update(spark: S, d: str) -> DF:
    t = _orders(spark, d)
    t.update({"o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'F'")
    return t.read().select("o_orderkey", "o_totalprice")


@register("lake_merge_sql", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def lake_merge(spark: S, d: str) -> DF:
    e = Engine(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    e.lake["target"] = _orders(spark, d)
    e.register("changes", o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("M")).unionByName(o.where("o_orderkey % 100 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("o_orderstatus", F.lit("N"))))
    e.sql("MERGE INTO target t USING changes s ON t.o_orderkey = s.o_orderkey WHEN MATCHED THEN UPDATE SET o_orderstatus = s.o_orderstatus WHEN NOT MATCHED THEN INSERT *")
    return e.sql("SELECT o_orderkey, o_orderstatus FROM target")


@register("lake_time_travel", "SELECT 'now' AS at, count(*) AS n FROM orders WHERE o_custkey > 100 UNION ALL SELECT 'before', count(*) FROM orders")
def lake_time_travel(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.lake["target"] = _orders(spark, d)
    e.sql("DELETE FROM target WHERE o_custkey <= 100")
    return e.sql("SELECT 'now' AS at, count(*) AS n FROM target").unionByName(e.sql("SELECT 'before' AS at, count(*) AS n FROM target VERSION AS OF 0"))


@register("lake_insert_overwrite", "SELECT o_orderkey FROM orders")
def lake_insert_overwrite(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.lake["target"] = _orders(spark, d)
    table(spark, d, "orders").createOrReplaceTempView("orders")
    e.sql("INSERT OVERWRITE target SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice < 200000")
    e.sql("INSERT INTO target SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 200000")
    return e.sql("SELECT o_orderkey FROM target")


@register("lake_partition_overwrite", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def lake_partition_overwrite(spark: S, d: str) -> DF:
    from tessera.sources.files import write

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = state_path(spark, "parts")
    write(o, path, partition_by=["o_orderstatus"])
    write(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), path, mode="dynamic", partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@register("lake_schema_evolution", "SELECT o_orderkey, NULL::VARCHAR AS note FROM orders")
def lake_schema_evolution(spark: S, d: str) -> DF:
    t = _orders(spark, d)
    t.add_column("note", "string")
    return t.read().select("o_orderkey", "note")


@register("lake_changes", "SELECT o_orderkey, -1::BIGINT AS _weight FROM orders WHERE o_totalprice < 50000")
def lake_changes(spark: S, d: str) -> DF:
    t = _orders(spark, d)
    t.delete("o_totalprice < 50000")
    return t.changes(0).select("o_orderkey", "_weight")


@register("lake_maintenance", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def lake_maintenance(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.lake["target"] = _orders(spark, d)
    e.sql("DELETE FROM target WHERE o_orderkey % 2 = 1; CALL system.maintain('target')")
    return e.sql("SELECT count(*) AS n FROM target")


@register("cdc_apply", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 6 <> 1")
def cdc_apply(spark: S, d: str) -> DF:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = VersionedTable(spark, state_path(spark, "cdc"), ["o_orderkey"])
    row = F.to_json(F.struct("o_orderkey", "o_custkey"))
    new = F.to_json(F.struct("o_orderkey", F.lit(1).cast("long").alias("o_custkey")))
    event = lambda op, before, after, ts: F.concat(F.lit(f'{{"op":"{op}","before":'), before, F.lit(',"after":'), after, F.lit(f',"source":{{"ts_ms":{ts},"lsn":{ts},"table":"orders"}}}}')).alias("value")
    null = F.lit("null")
    log = o.select(event("c", null, row, 1)).unionByName(o.where("o_orderkey % 4 = 0").select(event("u", row, new, 2))).unionByName(o.where("o_orderkey % 6 = 1").select(event("d", row, null, 3)))
    parsed = cdc.parse_envelopes(log, "value", "o_orderkey BIGINT, o_custkey BIGINT")
    cdc.apply_changes(t, parsed.where("op = 'c'"), ["o_orderkey"])
    cdc.apply_changes(t, parsed.where("op <> 'c'"), ["o_orderkey"])
    return t.read()


@register("cdc_to_weights", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS _weight FROM nation")
def cdc_to_weights(spark: S, d: str) -> DF:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    body = F.to_json(F.struct("n_nationkey"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"op":"c","after":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"op":"d","before":'), body, F.lit("}")))
    return cdc.to_zset(cdc.parse_envelopes(n.select(text.alias("value")), "value", "n_nationkey BIGINT")).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "_weight")


@register("upsert_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark: S, d: str) -> DF:
    e = table(spark, d, "events").select("user_id", "event_id")
    t = VersionedTable(spark, state_path(spark, "upsert"), ["user_id"])
    t.append(e.where("event_id < 100").groupBy("user_id").agg(F.max("event_id").alias("event_id")))
    t.upsert(e, "event_id")
    return t.read()


_RULES = [Rule("value_range", "value", "range", "reject", 1.0, 100.0), Rule("known_type", "event_type", "regex", "reject", pattern="^(click|view|purchase)$"), Rule("has_user", "user_id", "not_null", "warn")]


@register("quality_accepted", "SELECT event_id FROM events WHERE value BETWEEN 1 AND 100 AND event_type IN ('click', 'view', 'purchase')")
def quality_accepted(spark: S, d: str) -> DF:
    return check(table(spark, d, "events"), _RULES)[0].select("event_id")


@register("quality_dead_letters", "SELECT event_id, (CASE WHEN value < 1 OR value > 100 THEN 1 ELSE 0 END + CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 0 ELSE 1 END)::INT AS broken FROM events WHERE NOT (value BETWEEN 1 AND 100 AND event_type IN ('click', 'view', 'purchase'))")
def quality_dead_letters(spark: S, d: str) -> DF:
    return check(table(spark, d, "events"), _RULES)[1].select("event_id", F.size("violations").alias("broken"))


@register("pipeline_expectations", "SELECT user_id, count(*) AS n FROM events WHERE value > 5 GROUP BY user_id HAVING count(*) > 3")
def pipeline_expectations(spark: S, d: str) -> DF:
    p = Pipeline(spark, "p").source("raw_events", lambda: table(spark, d, "events")).view("good", "SELECT * FROM raw_events", temporary=True)
    p.view("per_user", "SELECT user_id, count(*) AS n FROM good GROUP BY user_id").expect("good", "large", "value > 5").expect("per_user", "busy", "n > 3")
    return p.run()["per_user"]


@register("materialized_full", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def materialized_full(spark: S, d: str) -> DF:
    m = MaterializedTable(spark, "m", lambda: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), VersionedTable(spark, state_path(spark, "mat")))
    m.refresh()
    m.refresh()
    return m.read()


@register("materialized_incremental", "SELECT event_id FROM events")
def materialized_incremental(spark: S, d: str) -> DF:
    e = table(spark, d, "events").select("event_id")
    parts = iter([e.where("event_id < 500"), e])
    m = MaterializedTable(spark, "m", lambda: next(parts), VersionedTable(spark, state_path(spark, "mat")), "incremental", "event_id")
    m.refresh()
    m.refresh()
    return m.read()


_Q = [round(0.1 * ((i * 7) % 11 - 5), 1) for i in range(64)]
_QS = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"


@register("vector_nearest_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QS}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QS}) DESC, vec_id LIMIT 10")
def vector_nearest(spark: S, d: str) -> DF:
    return vector.nearest(table(spark, d, "embeddings"), _Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@register("vector_nearest_filtered", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_QS}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY list_distance(embedding::DOUBLE[], {_QS}), vec_id LIMIT 5")
def vector_nearest_filtered(spark: S, d: str) -> DF:
    return vector.nearest(table(spark, d, "embeddings"), _Q, 5, metric="euclidean", where="label = 1").select("vec_id", F.round("score", 6).alias("score"))


@register("prepared_statement", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000")
def prepared_statement(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.register_parquet("customer", f"{d}/customer.parquet", ["c_custkey"])
    e.sql("PREPARE q AS SELECT c_custkey FROM customer WHERE c_nationkey = $1 AND c_acctbal > $2")
    return e.sql("EXECUTE q(3, 1000)")


@register("ctas_partitioned", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1")
def ctas_partitioned(spark: S, d: str) -> DF:
    e = Engine(spark, lake=state_path(spark, "lake"))
    e.register_parquet("orders", f"{d}/orders.parquet")
    e.sql("CREATE TABLE by_year PARTITIONED BY (year(o_orderdate)) AS SELECT o_orderkey, o_orderdate FROM orders")
    return e.sql("SELECT o_orderdate_year AS y, count(*) AS n FROM by_year GROUP BY o_orderdate_year")


@register("incremental_view_sql", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def incremental_view_sql(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.register_parquet("customer", f"{d}/customer.parquet")
    e.sql("CREATE MATERIALIZED VIEW per_nation AS SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey; REFRESH MATERIALIZED VIEW per_nation")
    return e.sql("SELECT * FROM per_nation")


@register("information_schema", "SELECT 'nation' AS table_name, count(*) AS columns FROM (VALUES (1), (2), (3)) t")
def information_schema(spark: S, d: str) -> DF:
    e = Engine(spark)
    e.register_parquet("nation", f"{d}/nation.parquet")
    return e.sql("SELECT table_name, count(*) AS columns FROM information_schema.columns WHERE table_name = 'nation' GROUP BY table_name")

"""Reading and writing files, statements of the front door, and stateful streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as TF
from tessera.operators import frame
from tessera.session import Engine
from tessera.sources import cdc, files
from tessera.sources.versioned import VersionedTable
from tessera.storage import state_path

from .pipeline import Memo
from .registry import register, table

DF, S = DataFrame, SparkSession
_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _customers(spark: S, d: str) -> DF:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


def _engine(spark: S, d: str, *names: str) -> Engine:
    e = Engine(spark, lake=state_path(spark, "lake"))
    for n in names:
        e.register_parquet(n, f"{d}/{n}.parquet")
    return e


# files


@register("csv_round_trip", _CUSTOMERS)
def csv_round_trip(spark: S, d: str) -> DF:
    path = state_path(spark, "csv")
    files.write(_customers(spark, d), path, "csv", header="true")
    return files.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@register("csv_inferred", "SELECT c_custkey::INT AS c_custkey, c_name, c_acctbal FROM customer")
def csv_inferred(spark: S, d: str) -> DF:
    path = state_path(spark, "csv")
    files.write(_customers(spark, d), path, "csv", header="true")
    return files.read_csv(spark, path)


@register("json_round_trip", _CUSTOMERS)
def json_round_trip(spark: S, d: str) -> DF:
    path = state_path(spark, "json")
    files.write(_customers(spark, d), path, "json")
    return files.read_json(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@register("orc_round_trip", _CUSTOMERS)
def orc_round_trip(spark: S, d: str) -> DF:
    path = state_path(spark, "orc")
    files.write(_customers(spark, d), path, "orc")
    return files.read_orc(spark, path)


@register("parquet_save_modes", f"{_CUSTOMERS} UNION ALL {_CUSTOMERS} WHERE c_acctbal < 0")
def parquet_save_modes(spark: S, d: str) -> DF:
    """Overwritten, appended to, and left alone by a write that ignores what is there."""
    path, rows = state_path(spark, "parquet"), _customers(spark, d)
    files.write(rows.limit(3), path)
    files.write(rows, path, mode="overwrite")
    files.write(rows.where("c_acctbal < 0"), path, mode="append", evolution="strict")
    files.write(rows, path, mode="ignore")
    return files.read_parquet(spark, path)


@register("parquet_directory", f"{_CUSTOMERS} UNION ALL {_CUSTOMERS}")
def parquet_directory(spark: S, d: str) -> DF:
    path, rows = state_path(spark, "tree"), _customers(spark, d)
    files.write(rows, f"{path}/a")
    files.write(rows, f"{path}/b/c")
    return files.read_parquet(spark, path, recursive=True)


@register("parquet_merged_schema", "SELECT c_custkey, NULL::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def parquet_merged_schema(spark: S, d: str) -> DF:
    path, rows = state_path(spark, "parquet"), _customers(spark, d)
    files.write(rows.select("c_custkey"), path)
    files.write(rows.select("c_custkey", "c_acctbal"), path, mode="append", evolution="additive")
    return files.read_parquet(spark, path, merge_schema=True).select("c_custkey", "c_acctbal")


@register("in_memory_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")
def in_memory_rows(spark: S, d: str) -> DF:
    return Engine(spark).register("mem", spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))


@register("range_rows", "SELECT range AS id FROM range(5, 50, 5)")
def range_rows(spark: S, d: str) -> DF:
    return spark.range(5, 50, 5)


# DataFrame verbs


@register("with_columns_renamed", "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice, c_acctbal > 0 AS positive FROM customer")
def with_columns_renamed(spark: S, d: str) -> DF:
    df = _customers(spark, d).withColumns({"twice": F.col("c_acctbal") * 2, "positive": F.col("c_acctbal") > 0}).drop("c_acctbal")
    return df.toDF("c_custkey", "c_name", "twice", "positive").withColumnsRenamed({"c_custkey": "id", "c_name": "name"})


@register("fill_by_column", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 0) AS r, coalesce(nullif(n_name, 'NATION_3'), '?') AS n FROM nation")
def fill_by_column(spark: S, d: str) -> DF:
    df = table(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("r"), F.nullif("n_name", F.lit("NATION_3")).alias("n"))
    return df.na.fill({"r": 0, "n": "?"})


@register("cached_twice", "SELECT count(*) AS n FROM customer c JOIN customer e ON c.c_custkey = e.c_custkey")
def cached_twice(spark: S, d: str) -> DF:
    df = _customers(spark, d).persist()
    try:
        n = df.join(df.select("c_custkey"), "c_custkey").count()
    finally:
        df.unpersist()
    return spark.range(1).select(F.lit(n).alias("n"))


@register("align_schema", "SELECT c_custkey::INT AS c_custkey, NULL::VARCHAR AS note, c_acctbal FROM customer")
def align_schema(spark: S, d: str) -> DF:
    from pyspark.sql import types as T

    return frame.align(_customers(spark, d), T._parse_datatype_string("c_custkey INT, note STRING, c_acctbal DOUBLE"))


@register("memoized", "SELECT count(*) AS n, 1 AS computed FROM customer")
def memoized(spark: S, d: str) -> DF:
    """The second reading takes the first one's result."""
    memo, runs = Memo(spark, state_path(spark, "memo")), []

    def compute() -> DF:
        runs.append(1)
        return _customers(spark, d).agg(F.count(F.lit(1)).alias("n"))

    memo.get("customers", compute)
    out = memo.get("customers", compute)
    return out.withColumn("computed", F.lit(len(runs)))


@register("session_bounds", "SELECT event_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + 60000 AS b FROM events")
def session_bounds(spark: S, d: str) -> DF:
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", TF.session_start("ms", 60_000).alias("a"), TF.session_end("ms", 60_000).alias("b"))


# statements


@register("sql_external_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def sql_external_table(spark: S, d: str) -> DF:
    path = state_path(spark, "csv")
    files.write(_customers(spark, d), path, "csv", header="true")
    e = Engine(spark)
    e.sql(f"CREATE EXTERNAL TABLE outside (c_custkey BIGINT, c_name VARCHAR, c_acctbal DOUBLE) STORED AS CSV WITH HEADER ROW LOCATION '{path}'")
    return e.sql("SELECT c_custkey, c_acctbal FROM outside WHERE c_acctbal > 0")


@register("sql_copy_to", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 5000")
def sql_copy_to(spark: S, d: str) -> DF:
    path, e = state_path(spark, "copied"), _engine(spark, d, "customer")
    e.sql(f"COPY (SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 5000) TO '{path}' STORED AS PARQUET")
    return spark.read.parquet(path)


@register("sql_insert_into", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT 100, 'new' UNION ALL SELECT 101, NULL")
def sql_insert_into(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    e.sql("CREATE TABLE kept AS SELECT n_nationkey AS k, n_name AS v FROM nation; INSERT INTO kept VALUES (100, 'new'); INSERT INTO kept (k) VALUES (101)")
    return e.sql("SELECT k, v FROM kept")


@register("sql_truncate_rename_drop", "SELECT 0::BIGINT AS left_over, 25::BIGINT AS before, false AS there")
def sql_truncate(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    e.sql("CREATE TABLE one AS SELECT * FROM nation; ALTER TABLE one RENAME TO two; TRUNCATE TABLE two")
    left, before = e.sql("SELECT count(*) AS n FROM two").first()[0], e.sql("SELECT count(*) AS n FROM two VERSION AS OF 0").first()[0]
    e.sql("DROP TABLE two")
    return spark.createDataFrame([(left, before, "two" in e.lake)], "left_over long, before long, there boolean")


@register("sql_alter_columns", "SELECT n_nationkey AS k, n_name AS label, NULL::BIGINT AS extra FROM nation")
def sql_alter_columns(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    e.sql("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation; ALTER TABLE t DROP COLUMN r; ALTER TABLE t RENAME COLUMN v TO label; ALTER TABLE t ADD COLUMN extra BIGINT")
    return e.sql("SELECT * FROM t")


@register("sql_live_table", "SELECT n_regionkey, count(*) + 1 AS n FROM nation GROUP BY 1")
def sql_live_table(spark: S, d: str) -> DF:
    """Refreshed after its source has gained a row for each region."""
    e = _engine(spark, d, "nation")
    e.sql("CREATE TABLE base AS SELECT n_regionkey FROM nation; CREATE LIVE TABLE per_region AS SELECT n_regionkey, count(*) AS n FROM base GROUP BY n_regionkey")
    e.sql("INSERT INTO base SELECT DISTINCT n_regionkey FROM nation; REFRESH LIVE TABLE per_region")
    return e.sql("SELECT n_regionkey, n FROM per_region")


@register("sql_drop_view", "SELECT true AS made, false AS there")
def sql_drop_view(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    e.sql("CREATE OR REPLACE TEMPORARY VIEW dropped_view AS SELECT * FROM nation")
    made = spark.catalog.tableExists("dropped_view")
    e.sql("DROP VIEW dropped_view")
    return spark.createDataFrame([(made, spark.catalog.tableExists("dropped_view"))], "made boolean, there boolean")


@register("sql_system_time", "SELECT 'then' AS at, count(*) AS n FROM customer UNION ALL SELECT 'now', count(*) FROM customer WHERE c_acctbal >= 0")
def sql_system_time(spark: S, d: str) -> DF:
    import datetime

    e = _engine(spark, d, "customer")
    e.sql("CREATE TABLE timed AS SELECT c_custkey, c_acctbal FROM customer")
    then = datetime.datetime.fromtimestamp(e.lake["timed"].versions()[0]["time"] + 0.001, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
    e.sql("DELETE FROM timed WHERE c_acctbal < 0")
    return e.sql(f"SELECT 'then' AS at, count(*) AS n FROM timed FOR SYSTEM_TIME AS OF '{then}' UNION ALL SELECT 'now', count(*) FROM timed")


@register("sql_set_and_reset", "SELECT '7' AS during, true AS back")
def sql_set_and_reset(spark: S, d: str) -> DF:
    e, key = Engine(spark), "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key)
    e.sql(f"SET {key} = 7")
    during = spark.conf.get(key)
    e.sql(f"RESET {key}")
    return spark.createDataFrame([(during, spark.conf.get(key) == before)], "during string, back boolean")


@register("sql_schemas", "SELECT true AS made, 'extra_schema' AS used, false AS there")
def sql_schemas(spark: S, d: str) -> DF:
    e, base = Engine(spark), spark.catalog.currentDatabase()
    e.sql("CREATE SCHEMA IF NOT EXISTS extra_schema")
    made = "extra_schema" in {r[0] for r in e.sql("SHOW SCHEMAS").collect()}
    e.sql("USE extra_schema")
    used = spark.catalog.currentDatabase()
    e.sql(f"USE {base}; DROP SCHEMA extra_schema")
    return spark.createDataFrame([(made, used, "extra_schema" in {r[0] for r in e.sql("SHOW SCHEMAS").collect()})], "made boolean, used string, there boolean")


@register("sql_describe", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, kind)")
def sql_describe(spark: S, d: str) -> DF:
    return _engine(spark, d, "nation").sql("DESCRIBE nation").select(F.col("col_name").alias("name"), F.col("data_type").alias("kind"))


@register("sql_show", "SELECT true AS tables, true AS functions, true AS columns")
def sql_show(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    tables = "nation" in {r.tableName for r in e.sql("SHOW TABLES").collect()}
    functions = {r[0] for r in e.sql("SHOW FUNCTIONS").collect()} >= {"sum", "upper"}
    columns = {r[0] for r in e.sql("SHOW COLUMNS IN nation").collect()} == {"n_nationkey", "n_name", "n_regionkey"} if spark.catalog.tableExists("nation") else False
    return spark.createDataFrame([(tables, functions, columns)], "tables boolean, functions boolean, columns boolean")


@register("sql_explain", "SELECT true AS scan, true AS pushed, true AS pruned")
def sql_explain(spark: S, d: str) -> DF:
    """The filter reaches the scan, and only the columns asked for are read."""
    text = _engine(spark, d, "customer").explain("SELECT c_name FROM customer WHERE c_acctbal > 100")
    return spark.createDataFrame([("Scan parquet" in text, "GreaterThan(c_acctbal,100.0)" in text, "ReadSchema: struct<c_name:string,c_acctbal:double>" in text)], "scan boolean, pushed boolean, pruned boolean")


@register("sql_operations", "SELECT 'finished' AS status, count(*) AS n, true AS named FROM customer")
def sql_operations(spark: S, d: str) -> DF:
    """A statement run in the background, by its id."""
    e = _engine(spark, d, "customer")
    op = e.submit("SELECT count(*) AS n FROM customer")
    n = op.result(120)["n"][0].as_py()
    return spark.createDataFrame([(op.status(), n, op.id.startswith("op-") and op.progress()["seconds"] >= 0)], "status string, n long, named boolean")


@register("sql_prepared_closed", "SELECT true AS refused, '22023' AS state")
def sql_prepared_closed(spark: S, d: str) -> DF:
    from tessera.session import sqlstate

    p = _engine(spark, d, "nation").prepare("SELECT * FROM nation WHERE n_nationkey = $1")
    p.bind(3)
    p.close()
    try:
        p.bind(4)
    except ValueError as error:
        return spark.createDataFrame([(True, sqlstate(error))], "refused boolean, state string")
    return spark.createDataFrame([(False, "")], "refused boolean, state string")


@register("sql_json_functions", "SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region, n_nationkey * 2 AS twice FROM nation")
def sql_json_functions(spark: S, d: str) -> DF:
    return _engine(spark, d, "nation").sql(
        """
        SELECT n_nationkey, j.c0 AS name, j.c1 AS region, from_json(body, 'k INT').k * 2 AS twice
        FROM (SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name, 'region', n_regionkey)) AS body FROM nation) t
        LATERAL VIEW json_tuple(body, 'name', 'region') j AS c0, c1
        """
    )


@register("sql_scalar_udf", "SELECT n_nationkey, n_nationkey * 3 + 1 AS v FROM nation")
def sql_scalar_udf(spark: S, d: str) -> DF:
    e = _engine(spark, d, "nation")
    e.register_scalar("triple_and_one", lambda x: x * 3 + 1, "long")
    return e.sql("SELECT n_nationkey, triple_and_one(n_nationkey) AS v FROM nation")


# change data


@register("cdc_routed", "SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def cdc_routed(spark: S, d: str) -> DF:
    """One log of two tables' changes, dealt to each."""
    event = lambda df, name, key: df.select(F.concat(F.lit('{"op":"c","before":null,"after":{"k":'), F.col(key).cast("string"), F.lit(f'}},"source":{{"ts_ms":1,"lsn":1,"table":"{name}"}}}}')).alias("value"))
    log = event(table(spark, d, "nation"), "nation", "n_nationkey").unionByName(event(table(spark, d, "region"), "region", "r_regionkey"))
    parts = cdc.route(cdc.parse_envelopes(log, "value", "k BIGINT"), ["nation", "region"])
    out = [cdc.to_zset(p).df.select(F.lit(t).alias("t"), "k") for t, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), out).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


# keyed state on streams


def _finish(df: DF) -> DF:
    out = state_path(df.sparkSession, "state-out")
    schema = df.schema
    df.writeStream.outputMode("append").option("checkpointLocation", state_path(df.sparkSession, "state-at")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(out)


def _ordered_stream(spark: S, d: str) -> DF:
    from tessera.streaming.frame import file_stream

    path = state_path(spark, "ordered")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    e.where("ms < 1705276800000").write.mode("append").parquet(path)
    e.where("ms >= 1705276800000").write.mode("append").parquet(path)
    return file_stream(spark, path, e.schema)


@register("stream_count_windows", "SELECT user_id AS key, 3 * (count(*) // 3) AS n FROM events GROUP BY user_id HAVING count(*) >= 3")
def stream_count_windows(spark: S, d: str) -> DF:
    """Windows of three events of a user, whose state is carried over batches: their number and size, whatever the order of arrival."""
    from tessera.streaming.stateful import count_window_processor

    out = _finish(count_window_processor(_ordered_stream(spark, d), "user_id", "value", 3))
    return out.groupBy("key").agg(F.sum("n").alias("n"))


@register("lake_partitions_kept", "SELECT o_orderstatus, count(*) AS n, true AS kept FROM orders WHERE o_totalprice >= 100000 GROUP BY 1")
def lake_partitions_kept(spark: S, d: str) -> DF:
    t = VersionedTable(spark, state_path(spark, "parts"))
    t.append(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by=["o_orderstatus"])
    t.delete("o_totalprice < 100000")
    t.update({"o_totalprice": "o_totalprice + 1"}, "o_orderstatus = 'F'")
    t.compact()
    return t.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(t.partitions() == ["o_orderstatus"]))

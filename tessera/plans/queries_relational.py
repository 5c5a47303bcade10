"""Relational operators as DataFrame queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import functions as TF
from tessera.operators import frame

from .registry import register, table

DF, S = DataFrame, SparkSession


@register("select_project", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P'")
def select_project(spark: S, d: str) -> DF:
    return table(spark, d, "orders").filter("o_totalprice > 200000 AND o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))


@register("select_exprs", "SELECT n_nationkey % 3 AS m, upper(n_name) AS n, n_nationkey BETWEEN 3 AND 9 AS b, n_name LIKE '%_1%' AS l, n_nationkey IN (1, 2) AS i FROM nation")
def select_exprs(spark: S, d: str) -> DF:
    return table(spark, d, "nation").selectExpr("n_nationkey % 3 AS m", "upper(n_name) AS n", "n_nationkey BETWEEN 3 AND 9 AS b", "n_name LIKE '%_1%' AS l", "n_nationkey IN (1, 2) AS i")


@register("with_column_rename_drop", "SELECT c_custkey AS id, c_name, c_acctbal, c_acctbal > 0 AS positive FROM customer")
def with_column(spark: S, d: str) -> DF:
    df = table(spark, d, "customer").withColumn("positive", F.col("c_acctbal") > 0)
    return frame.rename(df, "c_custkey", "id").drop("c_nationkey", "c_mktsegment")


@register("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark: S, d: str) -> DF:
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@register("drop_duplicates_keys", "SELECT DISTINCT o_custkey FROM orders")
def drop_duplicates_keys(spark: S, d: str) -> DF:
    return table(spark, d, "orders").dropDuplicates(["o_custkey"]).select("o_custkey")


@register("drop_and_fill_nulls", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS r FROM nation WHERE nullif(n_nationkey, 3) IS NOT NULL")
def drop_and_fill(spark: S, d: str) -> DF:
    df = table(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("n_nationkey"), F.nullif("n_regionkey", F.lit(1)).alias("r"))
    return frame.fill_null(frame.drop_nulls(df, ["n_nationkey"]), "r", -1)


@register("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def case_when(spark: S, d: str) -> DF:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 300000, "high").when(p > 100000, "middle").otherwise("low").alias("band"))


@register("try_cast", "SELECT event_id, TRY_CAST(event_type AS INT) AS n, CAST(user_id AS VARCHAR) AS u FROM events")
def try_cast(spark: S, d: str) -> DF:
    return table(spark, d, "events").select("event_id", TF.try_cast("event_type", "int").alias("n"), TF.cast("user_id", "string").alias("u"))


@register("explode_posexplode", "SELECT n_nationkey, i - 1 AS pos, [n_nationkey, n_regionkey][i] AS v FROM nation, (VALUES (1), (2)) t(i)")
def explode(spark: S, d: str) -> DF:
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array("n_nationkey", "n_regionkey")).alias("pos", "v"))


@register(
    "describe",
    """
    SELECT 'count' AS summary, count(o_totalprice)::DOUBLE AS price, count(o_custkey)::DOUBLE AS customer FROM orders
    UNION ALL SELECT 'mean', round(avg(o_totalprice), 4), round(avg(o_custkey), 4) FROM orders
    UNION ALL SELECT 'stddev', round(stddev_samp(o_totalprice), 4), round(stddev_samp(o_custkey), 4) FROM orders
    UNION ALL SELECT 'min', min(o_totalprice), min(o_custkey) FROM orders UNION ALL SELECT 'max', max(o_totalprice), max(o_custkey) FROM orders
    """,
)
def describe(spark: S, d: str) -> DF:
    made = table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer")).describe()
    return made.select("summary", F.round(F.col("price").cast("double"), 4).alias("price"), F.round(F.col("customer").cast("double"), 4).alias("customer"))


@register("sample_rows")
def sample_rows(spark: S, d: str) -> DF:
    return frame.sample(table(spark, d, "events"), 0.1, 42)


@register("approximate_distinct")
def approximate_distinct(spark: S, d: str) -> DF:
    return table(spark, d, "events").agg(TF.approx_count_distinct("user_id").alias("users"))


@register("stat_corr_cov", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov FROM lineitem")
def stat_corr_cov(spark: S, d: str) -> DF:
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("corr"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cov"))


@register("analyze_table", "SELECT 'n_nationkey' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max FROM nation UNION ALL SELECT 'n_regionkey', count(*), 0, min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR FROM nation")
def analyze_table(spark: S, d: str) -> DF:
    return frame.analyze(table(spark, d, "nation").select("n_nationkey", "n_regionkey")).drop("distinct")


# joins

_JOIN = "SELECT {c} FROM (SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 0) a {how} JOIN (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus <> 'F') b USING (k)"


def _sides(spark: S, d: str) -> tuple[DF, DF]:
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_name")
    return a, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey")


for _name, _how, _sql in (("join_inner", "inner", ""), ("join_left", "left", "LEFT"), ("join_right", "right", "RIGHT"), ("join_full", "full", "FULL")):

    @register(_name, _JOIN.format(c="k, c_name, o_orderkey", how=_sql))
    def _join(spark: S, d: str, how=_how) -> DF:
        a, b = _sides(spark, d)
        return frame.join(a, b, how, ["k"]).select("k", "c_name", "o_orderkey")


@register("join_left_semi", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def join_left_semi(spark: S, d: str) -> DF:
    a, b = _sides(spark, d)
    return frame.join(a, b, "leftsemi", ["k"]).select("k")


@register("join_left_anti", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def join_left_anti(spark: S, d: str) -> DF:
    a, b = _sides(spark, d)
    return frame.join(a, b, "leftanti", ["k"]).select("k")


@register("join_right_semi", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join_right_semi(spark: S, d: str) -> DF:
    a, b = _sides(spark, d)
    return frame.join(a, b, "rightsemi", ["k"]).select("o_orderkey")


@register("join_right_anti", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join_right_anti(spark: S, d: str) -> DF:
    a, b = _sides(spark, d)
    return frame.join(a, b, "rightanti", ["k"]).select("o_orderkey")


@register("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: S, d: str) -> DF:
    return frame.join(table(spark, d, "region"), table(spark, d, "nation"), "cross", []).select("r_name", "n_name")


@register("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_regionkey")
def join_theta(spark: S, d: str) -> DF:
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@register("join_broadcast", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(spark: S, d: str) -> DF:
    # the nations of the world: a table of fixed size
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@register("skewed_aggregate", "SELECT user_id, round(avg(value), 6) AS mean, median(value) AS middle FROM events GROUP BY user_id")
def skewed_aggregate(spark: S, d: str) -> DF:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("middle"))


@register("salted_sum", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def salted_sum(spark: S, d: str) -> DF:
    out = frame.salted_aggregate(table(spark, d, "events"), ["event_type"], {"n": F.count(F.lit(1)), "t": F.sum("value")}, {"n": F.sum("n"), "t": F.sum("t")})
    return out.select("event_type", "n", F.round("t", 2).alias("total"))


@register("cogroup_udf", "SELECT c_nationkey AS k, count(*) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS suppliers FROM customer GROUP BY c_nationkey")
def cogroup_udf(spark: S, d: str) -> DF:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"k": [], "customers": [], "suppliers": []})
        return pd.DataFrame({"k": [x["k"].iloc[0]], "customers": [len(x)], "suppliers": [len(y)]})

    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "k int, customers long, suppliers long")


# aggregates


@register("aggregate_basic", "SELECT o_orderstatus, count(*) AS n, count(nullif(o_orderpriority, '1-URGENT')) AS not_urgent, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
def aggregate_basic(spark: S, d: str) -> DF:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        TF.count_all().alias("n"), TF.count(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("not_urgent"),
        F.round(F.sum(p), 2).alias("s"), F.round(F.avg(p), 4).alias("a"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@register("aggregate_global", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem")
def aggregate_global(spark: S, d: str) -> DF:
    return table(spark, d, "lineitem").agg(TF.count_all().alias("n"), TF.count_distinct("l_suppkey").alias("suppliers"), TF.sum_distinct("l_linenumber").alias("lines"))


@register("aggregate_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
def aggregate_statistics(spark: S, d: str) -> DF:
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(TF.stddev_samp(q), 6).alias("ss"), F.round(TF.stddev_pop(q), 6).alias("sp"), F.round(TF.var_samp(q), 6).alias("vs"), F.round(TF.var_pop(q), 6).alias("vp"), TF.median(q).alias("m"))


@register("aggregate_bits", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x, bool_and(n_nationkey > 1) AS ba, bool_or(n_nationkey > 20) AS bo FROM nation GROUP BY n_regionkey")
def aggregate_bits(spark: S, d: str) -> DF:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").groupBy("n_regionkey").agg(TF.bit_and(k).alias("a"), TF.bit_or(k).alias("o"), TF.bit_xor(k).alias("x"), TF.bool_and(k > 1).alias("ba"), TF.bool_or(k > 20).alias("bo"))


@register("aggregate_lists", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def aggregate_lists(spark: S, d: str) -> DF:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(TF.collect_list("n_name")), ",").alias("names"))


@register("aggregate_rollup_api", "SELECT c_nationkey, c_mktsegment, count(*) AS n, grouping(c_mktsegment) AS g FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def aggregate_rollup(spark: S, d: str) -> DF:
    return table(spark, d, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping("c_mktsegment").cast("long").alias("g"))


@register("pivot_api", "SELECT l_linestatus, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY l_linestatus")
def pivot_api(spark: S, d: str) -> DF:
    return frame.pivot(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", F.round(F.sum("l_quantity"), 2), ["A", "N", "R"])


@register("unpivot_api", "SELECT n_nationkey, 'n_regionkey' AS name, nullif(n_regionkey, 0) AS value FROM nation UNION ALL SELECT n_nationkey, 'twice', n_nationkey * 2 FROM nation")
def unpivot_api(spark: S, d: str) -> DF:
    df = table(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(0)).alias("n_regionkey"), (F.col("n_nationkey") * 2).alias("twice"))
    return frame.unpivot(df, ["n_regionkey", "twice"], "name", "value")


@register("heavy_hitters", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def heavy_hitters(spark: S, d: str) -> DF:
    return frame.heavy_hitters(table(spark, d, "events"), "user_id", 10)


# analytic windows


def _w():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@register("window_ranking", "SELECT o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INT AS r, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INT AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, (ntile(4) OVER w)::INT AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_ranking(spark: S, d: str) -> DF:
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", TF.row_number().over(_w()).alias("rn"), TF.rank().over(p).alias("r"), TF.dense_rank().over(p).alias("dr"), F.round(TF.percent_rank().over(_w()), 8).alias("pr"), F.round(TF.cume_dist().over(_w()), 8).alias("cd"), TF.ntile(4).over(_w()).alias("nt"))


@register("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS before, lead(o_totalprice, 2, 0.0) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_lag_lead(spark: S, d: str) -> DF:
    return table(spark, d, "orders").select("o_orderkey", TF.lag("o_totalprice").over(_w()).alias("before"), TF.lead("o_totalprice", 2, 0.0).over(_w()).alias("after"))


@register("window_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_first_last(spark: S, d: str) -> DF:
    k = "o_orderkey"
    return table(spark, d, "orders").select(k, TF.first_value(k).over(_w()).alias("f"), TF.last_value(k).over(_w()).alias("l"), TF.nth_value(k, 2).over(_w()).alias("s"))


@register("window_frame_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
def window_frame_rows(spark: S, d: str) -> DF:
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_w().rowsBetween(-2, 1)), 2).alias("s"))


@register("window_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS n FROM orders")
def window_frame_range(spark: S, d: str) -> DF:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-5000, 0)
    return table(spark, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"))


@register("window_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def window_running(spark: S, d: str) -> DF:
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_w()), 2).alias("running"))


# order and sets


@register("sort_null_order", "SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v ASC NULLS LAST, n_nationkey DESC NULLS FIRST LIMIT 18")
def sort_null_order(spark: S, d: str) -> DF:
    df = table(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(2)).alias("v"))
    return frame.order_by(df, ["v", "n_nationkey"], [False, True]).limit(18)


@register("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def top_k(spark: S, d: str) -> DF:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@register("late_materialized_top", "SELECT c_custkey, c_name, c_mktsegment, round(measure, 2) AS measure FROM (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS measure FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN customer USING (c_custkey)")
def late_materialized_top(spark: S, d: str) -> DF:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = frame.late_materialized_top(orders, ["c_custkey"], F.sum("o_totalprice"), 20, table(spark, d, "customer"))
    return out.select("c_custkey", "c_name", "c_mktsegment", F.round("measure", 2).alias("measure"))


def _keys(spark: S, d: str) -> tuple[DF, DF]:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
for _name, _sql, _f in (
    ("set_union_all", f"{_A} UNION ALL {_B}", lambda a, b: a.union(b)),
    ("set_union", f"{_A} UNION {_B}", lambda a, b: a.union(b).distinct()),
    ("set_intersect_all", f"{_A} INTERSECT ALL {_B}", lambda a, b: a.intersectAll(b)),
    ("set_intersect", f"{_A} INTERSECT {_B}", lambda a, b: a.intersect(b)),
    ("set_except_all", f"{_A} EXCEPT ALL {_B}", lambda a, b: a.exceptAll(b)),
    ("set_except", f"{_A} EXCEPT {_B}", lambda a, b: a.subtract(b)),
):

    @register(_name, _sql)
    def _set(spark: S, d: str, f=_f) -> DF:
        return f(*_keys(spark, d))


@register("set_union_by_name", "SELECT c_nationkey AS k, c_name AS name, NULL::DOUBLE AS extra FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark: S, d: str) -> DF:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


# functions written by users


@register("udf_scalar", "SELECT p_partkey, p_retailprice * 1.1 AS more FROM part")
def udf_scalar(spark: S, d: str) -> DF:
    @F.pandas_udf("double")
    def more(x: pd.Series) -> pd.Series:
        return x * 1.1

    return table(spark, d, "part").select("p_partkey", more("p_retailprice").alias("more"))


@register("udf_aggregate", "SELECT p_brand, max(p_size) - min(p_size) AS spread FROM part GROUP BY p_brand")
def udf_aggregate(spark: S, d: str) -> DF:
    @F.pandas_udf("int")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return table(spark, d, "part").groupBy("p_brand").agg(spread("p_size").alias("spread"))


@register("udf_table", "SELECT n_nationkey, i AS n, i * i AS square FROM nation, range(n_regionkey) t(i)")
def udf_table(spark: S, d: str) -> DF:
    @F.udtf(returnType="n long, square long")
    class Squares:
        def eval(self, k: int):
            for i in range(k):
                yield i, i * i

    spark.udtf.register("squares", Squares)
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, n, square FROM nation, LATERAL squares(n_regionkey)")


@register("udf_sql_scalar", "SELECT p_partkey, p_retailprice * (1 - 0.25) AS less FROM part")
def udf_sql_scalar(spark: S, d: str) -> DF:
    from tessera.session import Engine

    table(spark, d, "part").createOrReplaceTempView("part")
    e = Engine(spark)
    e.sql("CREATE FUNCTION discounted(p DOUBLE, r DOUBLE) RETURNS DOUBLE LANGUAGE SQL AS 'SELECT p * (1 - r)'")
    return e.sql("SELECT p_partkey, discounted(p_retailprice, 0.25D) AS less FROM part")


@register("udf_sql_table", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def udf_sql_table(spark: S, d: str) -> DF:
    from tessera.session import Engine

    table(spark, d, "nation").createOrReplaceTempView("nation")
    e = Engine(spark)
    e.sql("CREATE FUNCTION nations_of(r INT) RETURNS TABLE (n_name VARCHAR) LANGUAGE SQL AS 'SELECT n_name FROM nation WHERE n_regionkey = r'")
    return e.sql("SELECT n_name FROM nations_of(2)")


@register("udf_map_batches", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 100000")
def udf_map_batches(spark: S, d: str) -> DF:
    def halves(frames):
        for pdf in frames:
            pdf = pdf[pdf["o_totalprice"] > 100000]
            yield pdf.assign(half=pdf["o_totalprice"] / 2)[["o_orderkey", "half"]]

    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").mapInPandas(halves, "o_orderkey long, half double")

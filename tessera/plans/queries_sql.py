"""Queries given as text to the SQL front door."""

from .registry import shared_sql

shared_sql(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
    """,
    "lineitem",
)
shared_sql(
    "tpch_q3",
    """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
    """,
    "customer orders lineitem",
)
shared_sql(
    "tpch_q5",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
      AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01'
    GROUP BY n_name ORDER BY revenue DESC
    """,
    "customer orders lineitem supplier nation region",
)
shared_sql(
    "tpch_q6",
    """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
    "lineitem",
)
shared_sql(
    "tpch_q7",
    """
    SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')
    GROUP BY 1, 2, 3 ORDER BY 1, 2, 3
    """,
    "supplier lineitem orders customer nation",
)
shared_sql(
    "tpch_q8",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
    JOIN nation n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY 1 ORDER BY 1
    """,
    "part lineitem supplier orders customer nation region",
)
shared_sql(
    "tpch_q10",
    """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
    """,
    "customer orders lineitem nation",
)
shared_sql(
    "tpch_q13",
    """
    SELECT c_count, count(*) AS custdist FROM (
        SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) c
    GROUP BY c_count ORDER BY custdist DESC, c_count DESC
    """,
    "customer orders",
)
shared_sql(
    "tpch_q14",
    """
    SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'
    """,
    "lineitem part",
)
shared_sql(
    "tpch_q15",
    """
    WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
    WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey
    """,
    "lineitem supplier",
)
shared_sql(
    "tpch_q18",
    """
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS quantity
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100
    """,
    "customer orders lineitem",
)
shared_sql("sql_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS t(a, b)", "region")
shared_sql("sql_cast", "SELECT CAST(n_nationkey AS VARCHAR) AS k, TRY_CAST(n_name AS INT) AS bad, CAST(n_regionkey AS DOUBLE) AS d FROM nation", "nation")
shared_sql("sql_integer_division", "SELECT n_nationkey, 10 / 3 AS three, 7 / 2 AS also_three FROM nation", "nation", "SELECT n_nationkey, 3::BIGINT AS three, 3::BIGINT AS also_three FROM nation")
shared_sql("sql_scalar_subquery", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation WHERE n_regionkey < (SELECT avg(r_regionkey) FROM region)", "nation customer region")
shared_sql("sql_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
shared_sql("sql_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer orders")
shared_sql("sql_in", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", "customer orders")
shared_sql("sql_not_in", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "customer orders")
shared_sql("sql_cte", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT * FROM a WHERE n > 15) SELECT c_name, n FROM b JOIN customer ON c_custkey = o_custkey", "customer orders")
shared_sql("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", "region")
shared_sql("sql_lateral", "SELECT r_name, x.n_name FROM region CROSS JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS x", "region nation")
shared_sql("sql_natural_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer GROUP BY 1) y", "nation customer")
shared_sql("sql_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)", "nation supplier")
shared_sql("sql_full_join", "SELECT a.k, a.x, b.k AS k2, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k, n_regionkey AS y FROM nation WHERE n_nationkey > 10) b ON a.k = b.k", "nation")
shared_sql("sql_unnest", "SELECT t.k, u.v FROM (SELECT n_nationkey AS k, [n_nationkey, n_regionkey, 99] AS arr FROM nation) t CROSS JOIN UNNEST(t.arr) AS u(v)", "nation")
shared_sql("sql_unnest_select", "SELECT n_nationkey, unnest([n_regionkey, 7]) AS v FROM nation", "nation")
shared_sql("sql_generate_series", "SELECT value * 2 AS twice FROM generate_series(1, 20, 3)", "region", "SELECT (generate_series * 2)::INT AS twice FROM generate_series(1, 20, 3)")
shared_sql("sql_pivot", "SELECT * FROM flags PIVOT(sum(l_quantity) FOR l_returnflag IN ('A', 'N', 'R'))", "lineitem")
shared_sql("sql_unpivot", "SELECT * FROM wide UNPIVOT(v FOR n IN (p_size, p_retailprice))", "part")
shared_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS gs, CAST(grouping(o_orderpriority) AS BIGINT) AS gp, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
shared_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
shared_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
shared_sql("sql_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus", "orders")
shared_sql("sql_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 50", "customer")
shared_sql("sql_set_operations", "(SELECT n_regionkey AS k FROM nation UNION SELECT c_nationkey FROM customer) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) INTERSECT SELECT n_nationkey FROM nation", "nation customer supplier")
shared_sql("sql_nulls_order", "SELECT k, CAST(row_number() OVER (ORDER BY v ASC NULLS FIRST, k) AS INT) AS first_rank, CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, k) AS INT) AS last_rank FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) t", "nation")
shared_sql("sql_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50", "orders")
shared_sql("sql_hints", "SELECT /*+ BROADCAST(n) */ n.n_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "customer nation")
shared_sql("sql_merge_hint", "SELECT /*+ MERGE(o) */ c_mktsegment, count(*) AS n FROM customer JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment", "customer orders")
shared_sql("sql_shuffle_hash_hint", "SELECT /*+ SHUFFLE_HASH(c) */ c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment", "customer orders")
shared_sql("sql_repartition_hint", "SELECT /*+ REPARTITION(4) */ o_orderstatus, o_orderkey FROM orders WHERE o_totalprice > 400000", "orders")
shared_sql("sql_higher_order", "SELECT n_nationkey, any_match(transform(array(n_nationkey, n_regionkey), x -> x * 2), y -> y > 40) AS big, aggregate(filter(array(1, 2, n_regionkey), x -> x > 1), 0, (a, x) -> a + x) AS total, forall(array(n_nationkey), x -> x < 100) AS small FROM nation", "nation",
    "SELECT n_nationkey, list_max([n_nationkey * 2, n_regionkey * 2]) > 40 AS big, coalesce(list_sum(list_filter([1, 2, n_regionkey], lambda x: x > 1)), 0)::INT AS total, n_nationkey < 100 AS small FROM nation")
shared_sql("sql_json", "SELECT event_id, get_json_object(props, '$.k') AS k, json_array_length('[1,2,3]') AS three FROM events", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k, 3 AS three FROM events")
shared_sql("sql_tumble_tvf", "SELECT user_id, window_start, window_end, count(*) AS n FROM TUMBLE(TABLE timed, DESCRIPTOR(ms), INTERVAL '1' HOUR) GROUP BY user_id, window_start, window_end", "events",
    "SELECT user_id, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 3600000 AS window_start, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 3600000 + 3600000 AS window_end, count(*) AS n FROM events GROUP BY 1, 2, 3")
shared_sql("sql_hop_tvf", "SELECT window_start, window_end, count(*) AS n FROM HOP(TABLE timed, DESCRIPTOR(ms), 600000, 3600000) GROUP BY window_start, window_end", "events",
    "SELECT epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 600000 AS window_start, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 600000 + 3600000 AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
shared_sql("sql_session_tvf", "SELECT event_id, window_start, window_end FROM SESSION(TABLE timed, DESCRIPTOR(ms), INTERVAL '30' MINUTE)", "events",
    "SELECT event_id, epoch_us(ts) // 1000 AS window_start, epoch_us(ts) // 1000 + 1800000 AS window_end FROM events")
shared_sql("sql_tumble_scalar", "SELECT event_id, tumble_start(ms, 60000) AS s, tumble_end(ms, 60000) AS e, hop_start(ms, 10000, 60000) AS h FROM timed", "events",
    "SELECT event_id, ms - ms % 60000 AS s, ms - ms % 60000 + 60000 AS e, ms - ms % 10000 AS h FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)")


def _also(name: str, text: str, duck: str | None = None):
    """Give a query a view over one of its tables first."""
    from .registry import ORACLES, QUERIES

    run = QUERIES[name]

    def with_view(spark, sf_dir, run=run):
        from .registry import TABLES, views

        views(spark, sf_dir, *[t for t in TABLES if t in text])
        spark.sql(text)
        return run(spark, sf_dir)

    QUERIES[name] = with_view
    if duck:
        ORACLES[name] = duck


_TIMED = "CREATE OR REPLACE TEMP VIEW timed AS SELECT *, unix_millis(CAST(ts AS TIMESTAMP)) AS ms FROM events"
for _n in ("sql_tumble_tvf", "sql_hop_tvf", "sql_session_tvf", "sql_tumble_scalar"):
    _also(_n, _TIMED)
_also("sql_pivot", "CREATE OR REPLACE TEMP VIEW flags AS SELECT l_returnflag, l_quantity FROM lineitem",
    "SELECT sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem")
_also("sql_unpivot", "CREATE OR REPLACE TEMP VIEW wide AS SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "SELECT 'p_size' AS n, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part")

# Queries of the benchmark whose columns these tables lack in part: the shape is kept, ship dates stand for commit and
# receipt dates, return flags for ship modes, brands and sizes for containers, and balances and names for phone numbers.
shared_sql(
    "tpch_q4",
    """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1998-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
    GROUP BY o_orderpriority ORDER BY o_orderpriority
    """,
    "orders lineitem",
)
shared_sql(
    "tpch_q12",
    """
    SELECT l_returnflag, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high_line_count, count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01'
    GROUP BY l_returnflag ORDER BY l_returnflag
    """,
    "orders lineitem",
)
shared_sql(
    "tpch_q17",
    """
    SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_type = 'ECONOMY' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)
    """,
    "lineitem part",
)
shared_sql(
    "tpch_q19",
    """
    SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25)
       OR (p_brand = 'Brand#17' AND l_quantity BETWEEN 10 AND 40 AND p_size BETWEEN 1 AND 40)
       OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 50 AND p_size BETWEEN 1 AND 50)
    """,
    "lineitem part",
)
shared_sql(
    "tpch_q21",
    """
    SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND n_regionkey IN (1, 2)
      AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate)
    GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
    """,
    "supplier lineitem orders nation",
)
shared_sql(
    "tpch_q22",
    """
    SELECT cntry, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal
    FROM (SELECT substring(c_name, 18, 1) AS cntry, c_acctbal, c_custkey FROM customer
          WHERE substring(c_name, 18, 1) IN ('1', '3', '5', '7') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND substring(c_name, 18, 1) IN ('1', '3', '5', '7'))
            AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) custsale
    GROUP BY cntry ORDER BY cntry
    """,
    "customer orders",
)

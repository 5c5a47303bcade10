"""Column functions, a query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as T

from .registry import register, table

DF, S = DataFrame, SparkSession


@register(
    "fn_string",
    """
    SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS lo, length(p_name)::INT AS len, strlen(p_name)::INT AS octets, bit_length(p_name)::INT AS bits,
           trim('  ' || p_name || ' ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, p_name || '-' || coalesce(NULL, '') || p_brand AS cc, concat_ws('/', p_brand, p_type) AS cw,
           ascii(p_name)::INT AS asc_, chr(65 + p_size % 26) AS ch, reverse(p_type) AS rev, repeat('ab', 3) AS rep, instr(p_brand, '#')::INT AS ins,
           lpad(p_type, 12, '*') AS lp, rpad(p_type, 12, '*') AS rp, left(p_name, 3) AS le, right(p_name, 3) AS ri, substr(p_name, 2, 4) AS su, split_part(p_brand, '#', 2) AS sp,
           translate(p_type, 'ABC', 'xyz') AS tl, starts_with(p_type, 'P') AS sw, ends_with(p_type, 'L') AS ew, contains(p_brand, '1') AS co,
           regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS rr, regexp_matches(p_brand, '#1[0-9]') AS rl
    FROM part
    """,
)
def fn_string(spark: S, d: str) -> DF:
    n, b, t = "p_name", "p_brand", "p_type"
    return table(spark, d, "part").select(
        "p_partkey", T.upper(n).alias("up"), T.lower(n).alias("lo"), T.length(n).alias("len"), T.octet_length(n).alias("octets"), T.bit_length(n).alias("bits"),
        T.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), T.ltrim(F.lit("  x")).alias("lt"), T.rtrim(F.lit("x  ")).alias("rt"),
        T.concat(n, F.lit("-"), F.lit(None), b).alias("cc"), T.concat_ws("/", b, t).alias("cw"),
        T.ascii(n).alias("asc_"), T.chr(F.lit(65) + F.col("p_size") % 26).alias("ch"), T.reverse(t).alias("rev"), T.repeat(F.lit("ab"), 3).alias("rep"), T.instr(b, "#").alias("ins"),
        T.lpad(t, 12, "*").alias("lp"), T.rpad(t, 12, "*").alias("rp"), T.left(n, 3).alias("le"), T.right(n, 3).alias("ri"), T.substr(n, 2, 4).alias("su"), T.split_part(b, "#", 2).alias("sp"),
        T.translate(t, "ABC", "xyz").alias("tl"), T.starts_with(t, "P").alias("sw"), T.ends_with(t, "L").alias("ew"), T.contains(b, "1").alias("co"),
        T.regexp_replace(b, "[0-9]+", "N").alias("rr"), T.regexp_like(b, "#1[0-9]").alias("rl"),
    )


@register(
    "fn_math",
    """
    SELECT p_partkey, abs(-p_size) AS ab, ceil(p_retailprice)::BIGINT AS ce, floor(p_retailprice)::BIGINT AS fl, round(sqrt(p_size), 8) AS sq, round(cbrt(p_size), 8) AS cb,
           round(exp(p_size / 50.0), 8) AS ex, round(ln(p_size), 8) AS ln_, round(log2(p_size), 8) AS l2, round(log10(p_size), 8) AS l10, round(power(p_size, 2), 8) AS pw, sign(p_size - 25)::DOUBLE AS sg,
           factorial(p_size % 15)::BIGINT AS fa, gcd(p_size, 36)::BIGINT AS gc, lcm(p_size, 36)::BIGINT AS lc, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS cs, round(tan(p_size), 6) AS ta,
           round(asin(p_size / 100.0), 8) AS asi, round(acos(p_size / 100.0), 8) AS aco, round(atan(p_size), 8) AS at, round(atan2(p_size, 3), 8) AS a2, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS chh,
           round(tanh(p_size / 10.0), 8) AS th, round(cot(p_size), 6) AS ct, round(degrees(p_size), 6) AS de, round(radians(p_size), 8) AS ra, round(pi(), 8) AS pi_, round_even(p_retailprice, 1) AS bn
    FROM part
    """,
)
def fn_math(spark: S, d: str) -> DF:
    x = F.col("p_size")
    r = lambda c, n=8: F.round(c, n)
    return table(spark, d, "part").select(
        "p_partkey", T.abs(-x).alias("ab"), T.ceil("p_retailprice").alias("ce"), T.floor("p_retailprice").alias("fl"), r(T.sqrt(x)).alias("sq"), r(T.cbrt(x)).alias("cb"),
        r(T.exp(x / 50.0)).alias("ex"), r(T.ln(x)).alias("ln_"), r(T.log2(x)).alias("l2"), r(T.log10(x)).alias("l10"), r(T.power(x, 2)).alias("pw"), T.sign(x - 25).cast("double").alias("sg"),
        T.factorial(x % 15).alias("fa"), T.gcd(x, 36).alias("gc"), T.lcm(x, 36).alias("lc"), r(T.sin(x)).alias("si"), r(T.cos(x)).alias("cs"), r(T.tan(x), 6).alias("ta"),
        r(T.asin(x / 100.0)).alias("asi"), r(T.acos(x / 100.0)).alias("aco"), r(T.atan(x)).alias("at"), r(T.atan2(x, F.lit(3))).alias("a2"), r(T.sinh(x / 10.0), 6).alias("sh"), r(T.cosh(x / 10.0), 6).alias("chh"),
        r(T.tanh(x / 10.0)).alias("th"), r(T.cot(x), 6).alias("ct"), r(T.degrees(x), 6).alias("de"), r(T.radians(x)).alias("ra"), r(T.pi()).alias("pi_"), T.round("p_retailprice", 1).alias("bn"),
    )


@register(
    "fn_null",
    """
    SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 99) AS c, ifnull(nullif(n_regionkey, 2), -1) AS i, CASE WHEN nullif(n_regionkey, 3) IS NOT NULL THEN 1 ELSE 0 END AS n2,
           greatest(n_nationkey, n_regionkey, 7) AS g, least(n_nationkey, n_regionkey, 7) AS l, nullif(n_regionkey, 1) IS NULL AS isn, nullif(n_regionkey, 1) IS NOT NULL AS isnn,
           isnan('nan'::DOUBLE) AS nan_, coalesce(n_name, 'x') AS nv
    FROM nation
    """,
)
def fn_null(spark: S, d: str) -> DF:
    k = lambda n: T.nullif("n_regionkey", F.lit(n))
    return table(spark, d, "nation").select(
        "n_nationkey", T.coalesce(k(1), 99).alias("c"), T.ifnull(k(2), -1).alias("i"), T.nvl2(k(3), 1, 0).alias("n2"), T.greatest("n_nationkey", "n_regionkey", 7).alias("g"),
        T.least("n_nationkey", "n_regionkey", 7).alias("l"), T.isnull(k(1)).alias("isn"), T.isnotnull(k(1)).alias("isnn"), T.isnan(F.lit(float("nan"))).alias("nan_"), T.nvl("n_name", F.lit("x")).alias("nv"),
    )


@register(
    "fn_datetime",
    """
    SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, quarter(ts)::INT AS q,
           date_trunc('hour', ts)::TIMESTAMP AS th, date_trunc('month', ts)::TIMESTAMP AS tm, ts::DATE AS dt, strftime(ts, '%Y-%m-%d %H:%M') AS f
    FROM events
    """,
)
def fn_datetime(spark: S, d: str) -> DF:
    t = "ts"
    return table(spark, d, "events").select(
        "event_id", T.year(t).alias("y"), T.month(t).alias("mo"), T.day(t).alias("d"), T.hour(t).alias("h"), T.minute(t).alias("mi"), T.second(t).cast("int").alias("s"), T.quarter(t).alias("q"),
        T.date_trunc("hour", t).cast("timestamp_ntz").alias("th"), T.date_trunc("month", t).cast("timestamp_ntz").alias("tm"), T.to_date(t).alias("dt"), T.date_format(t, "yyyy-MM-dd HH:mm").alias("f"),
    )


@register(
    "fn_array",
    """
    WITH a AS (SELECT n_nationkey, n_regionkey, [n_nationkey, n_regionkey, n_regionkey, 7] AS x, [7, n_regionkey, 100] AS y FROM nation)
    SELECT n_nationkey, list_contains(x, 7) AS c, len(list_distinct(x))::INT AS dn, list_position(x, 100)::BIGINT AS p, array_to_string(list_append(x, 5), ',') AS ap, array_to_string(list_prepend(5, x), ',') AS pr,
           len(list_distinct(list_concat(x, y)))::INT AS un, len(list_intersect(list_distinct(x), list_distinct(y)))::INT AS it, len(x)::INT AS n, array_to_string(flatten([x, y]), ',') AS fl,
           array_to_string(list_filter(x, lambda e: e <> n_regionkey), ',') AS rm
    FROM a
    """,
)
def fn_array(spark: S, d: str) -> DF:
    a = table(spark, d, "nation").select("n_nationkey", "n_regionkey", T.array("n_nationkey", "n_regionkey", "n_regionkey", 7).alias("x"), T.array(7, "n_regionkey", 100).alias("y"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select(
        "n_nationkey", T.array_contains("x", 7).alias("c"), T.array_length(T.array_distinct("x")).alias("dn"), T.array_position("x", 100).alias("p"), text(T.array_append("x", 5)).alias("ap"), text(T.array_prepend(5, "x")).alias("pr"),
        T.array_length(T.array_union("x", "y")).alias("un"), T.array_length(T.array_intersect("x", "y")).alias("it"), T.cardinality("x").alias("n"), text(T.flatten(T.array("x", "y"))).alias("fl"),
        text(T.array_remove("x", F.col("n_regionkey"))).alias("rm"),
    )


@register(
    "fn_higher_order",
    """
    WITH a AS (SELECT n_nationkey, [n_nationkey, n_regionkey, 7] AS x FROM nation)
    SELECT n_nationkey, array_to_string(list_transform(x, lambda e: e * 2), ',') AS t, array_to_string(list_filter(x, lambda e: e > 3), ',') AS f, len(list_filter(x, lambda e: e > 20)) > 0 AS e,
           len(list_filter(x, lambda e: e >= 0)) = 3 AS fa, (n_nationkey + n_regionkey + 7)::BIGINT AS ag, array_to_string([n_nationkey * 2, n_regionkey * 2, 14], ',') AS z
    FROM a JOIN (SELECT n_nationkey AS k2, n_regionkey FROM nation) b ON a.n_nationkey = b.k2
    """,
)
def fn_higher_order(spark: S, d: str) -> DF:
    a = table(spark, d, "nation").select("n_nationkey", T.array("n_nationkey", "n_regionkey", 7).alias("x"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select(
        "n_nationkey", text(T.transform("x", lambda e: e * 2)).alias("t"), text(T.filter("x", lambda e: e > 3)).alias("f"), T.exists("x", lambda e: e > 20).alias("e"), T.forall("x", lambda e: e >= 0).alias("fa"),
        T.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e).alias("ag"), text(T.zip_with("x", "x", lambda p, q: p + q)).alias("z"),
    )


@register("fn_hash", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
def fn_hash(spark: S, d: str) -> DF:
    return table(spark, d, "part").select("p_partkey", T.md5("p_name").alias("m"), T.sha256("p_name").alias("s"))


@register("fn_crc32")
def fn_crc32(spark: S, d: str) -> DF:
    return table(spark, d, "part").select("p_partkey", T.crc32(F.col("p_name").cast("binary")).alias("c"), T.sha512("p_name").alias("s"), T.xxhash64("p_name").alias("x"))


@register("fn_random")
def fn_random(spark: S, d: str) -> DF:
    return table(spark, d, "nation").select("n_nationkey", T.rand().alias("r"), T.uuid().alias("u"), T.current_date().alias("d"), T.now().alias("t"))


# what the families above leave out


@register(
    "fn_string_more",
    """
    SELECT p_partkey, length(p_name)::INT AS cl, trim('  ' || p_name || ' ') AS bt, trim('xxabx', 'x') AS btx,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic,
           instr(p_name, 'e')::INT AS lo, (CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e') + 2 ELSE 0 END)::INT AS lo3, substring(p_name, 2, 5) AS su
    FROM part
    """,
)
def fn_string_more(spark: S, d: str) -> DF:
    n = "p_name"
    return table(spark, d, "part").select(
        "p_partkey", T.char_length(n).alias("cl"), T.btrim(F.concat(F.lit("  "), n, F.lit(" "))).alias("bt"), T.btrim(F.lit("xxabx"), "x").alias("btx"), T.initcap(n).alias("ic"),
        T.locate("e", n).alias("lo"), T.locate("e", n, 3).alias("lo3"), T.substring(n, 2, 5).alias("su"),
    )


@register(
    "fn_math_more",
    "SELECT p_partkey, round(ln(p_size), 8) AS lg, pow(p_size, 3)::DOUBLE AS pw, sign(p_size - 25)::DOUBLE AS sg, CASE WHEN p_size > 25 THEN 1.5 ELSE p_retailprice END AS nv, p_size * 2 AS ex, abs(p_size - 30) AS cf, sqrt(p_size) AS fu FROM part",
)
def fn_math_more(spark: S, d: str) -> DF:
    x = T.column("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.round(T.log(x), 8).alias("lg"), T.pow(x, 3).alias("pw"), T.signum(x - 25).alias("sg"),
        T.nanvl(T.when(x > 25, F.lit(float("nan"))).otherwise(F.col("p_retailprice")), F.lit(1.5)).alias("nv"),
        T.expr("p_size * 2").alias("ex"), T.call_function("abs", x - 30).alias("cf"), T.function("sqrt", "p_size").alias("fu"),
    )


@register(
    "fn_aggregate_more",
    """
    SELECT c_nationkey, round(avg(c_acctbal), 6) AS m, min(c_nationkey) AS f, max(c_nationkey) AS l, round(stddev_samp(c_acctbal), 6) AS sd, round(var_samp(c_acctbal), 1) AS va,
           round(corr(c_acctbal, c_custkey), 8) AS co, round(covar_samp(c_acctbal, c_custkey), 0) AS cs, round(covar_pop(c_acctbal, c_custkey), 0) AS cp, count(*) AS n
    FROM customer GROUP BY c_nationkey HAVING count(*) > 1
    """,
)
def fn_aggregate_more(spark: S, d: str) -> DF:
    b, k, n = "c_acctbal", "c_custkey", "c_nationkey"
    g = table(spark, d, "customer").groupBy(n).agg(
        F.round(T.mean(b), 6).alias("m"), T.first(n).alias("f"), T.last(n).alias("l"), F.round(T.stddev(b), 6).alias("sd"), F.round(T.variance(b), 1).alias("va"),
        F.round(T.corr(b, k), 8).alias("co"), F.round(T.covar_samp(b, k), 0).alias("cs"), F.round(T.covar_pop(b, k), 0).alias("cp"), F.size(T.array_agg(k)).cast("long").alias("n"),
    )
    return g.where("n > 1")


@register("fn_order_more", "SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v DESC NULLS FIRST, n_nationkey LIMIT 12")
def fn_order_more(spark: S, d: str) -> DF:
    return table(spark, d, "nation").select("n_nationkey", T.nullif("n_regionkey", F.lit(2)).alias("v")).orderBy(T.desc("v"), T.asc("n_nationkey")).limit(12)


@register("fn_datetime_more", "SELECT event_id, day(ts)::INT AS dm, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS tt, true AS ok FROM events")
def fn_datetime_more(spark: S, d: str) -> DF:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", T.dayofmonth("ts").alias("dm"), T.to_timestamp(text).cast("timestamp_ntz").alias("tt"), (T.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("ok"))


@register(
    "fn_array_more",
    """
    SELECT n_nationkey, array_to_string(list_sort(list_filter(list_distinct([n_nationkey, n_regionkey, 7]), lambda e: e <> 7 AND e <> 2)), ',') AS ex, n_nationkey + n_regionkey + 7 AS rd FROM nation
    """,
)
def fn_array_more(spark: S, d: str) -> DF:
    a = T.array("n_nationkey", "n_regionkey", 7)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.sort_array(T.array_except(a, T.array(7, 2))).cast("array<string>"), ",").alias("ex"), T.reduce(a, F.lit(0), lambda s, e: s + e).alias("rd"))


@register("fn_explode", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS e FROM nation UNION ALL SELECT n_nationkey, p + 100 * v FROM nation, (VALUES (0), (1)) t(p), LATERAL (SELECT CASE p WHEN 0 THEN n_regionkey ELSE 7 END) u(v)")
def fn_explode(spark: S, d: str) -> DF:
    n = table(spark, d, "nation")
    a = n.select("n_nationkey", T.explode(T.array("n_regionkey", "n_nationkey")).alias("e"))
    b = n.select("n_nationkey", T.posexplode(T.array("n_regionkey", 7)).alias("p", "v"))
    return a.unionByName(b.select("n_nationkey", (F.col("p") + 100 * F.col("v")).alias("e")))

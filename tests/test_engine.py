"""The front door, its rewrites and statements."""

import pytest
from pyspark.errors import PySparkException

from tessera.operators.cep import Pattern, UnsupportedPattern
from tessera.plans import dialect
from tessera.plans.pipeline import Memo, Pipeline, infer_engine
from tessera.session import AccessDenied, Engine, error_position, sqlstate
from tessera.sources.files import MissingConnector, check_evolution, read_csv, read_json, write
from tessera.sources.versioned import ConcurrentCommit, VersionedTable

from .conftest import SF


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, lake=f"file://{tmp_path}/lake")
    for t in ("nation", "region", "events"):
        e.register_parquet(t, f"{SF}/{t}.parquet")
    return e


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("SELECT CAST(a AS VARCHAR) FROM t", "SELECT CAST(a AS STRING) FROM t"),
        ("SELECT 'CAST(a AS VARCHAR)', [1, 2], x[0]", "SELECT 'CAST(a AS VARCHAR)', array(1, 2), x[0]"),
        ("SELECT 10 / 3, a / 3, 1.5 / 2", "SELECT 10 div 3, a / 3, 1.5 / 2"),
        ("SELECT any_match(x, y -> y > 1)", "SELECT exists(x, y -> y > 1)"),
        ("SELECT * FROM s PIVOT(sum(x) FOR k IN ('a'))", "SELECT sum(CASE WHEN k = 'a' THEN x END) AS `a` FROM s"),
    ],
)
def test_rewrites(text, out):
    assert dialect.rewrite(text) == out


def test_statements_split_outside_strings():
    assert dialect.split_statements("SELECT ';' AS a; -- x;\n SELECT 2;") == ["SELECT ';' AS a", "-- x;\n SELECT 2"]


@pytest.mark.parametrize(("text", "ms"), [("INTERVAL '5' MINUTE", 300_000), ("2 hours", 7_200_000), ("1500", 1500)])
def test_intervals(text, ms):
    assert dialect.milliseconds(text) == ms


def test_lake_statements(engine):
    assert engine.sql("CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS v FROM nation").first()[0] == 25
    assert engine.sql("DELETE FROM n WHERE k < 5").first()["deleted_rows"] == 5
    assert engine.sql("UPDATE n SET v = 'x' WHERE k = 7").first()["updated_rows"] == 1
    assert engine.sql("INSERT INTO n VALUES (100, 'new')").first()[0] == 1
    assert engine.sql("SELECT count(*) AS c FROM n").first()["c"] == 21
    assert engine.sql("SELECT count(*) AS c FROM n VERSION AS OF 0").first()["c"] == 25
    engine.sql("ALTER TABLE n ADD COLUMN w BIGINT; ALTER TABLE n RENAME COLUMN v TO name")
    assert engine.sql("SELECT * FROM n").columns == ["k", "name", "w"]
    engine.lake["n"].tag("named", 0)
    assert engine.sql("SELECT count(*) AS c FROM n VERSION AS OF 'named'").first()["c"] == 25
    engine.sql("TRUNCATE TABLE n")
    assert engine.sql("SELECT * FROM n").count() == 0
    engine.sql("DROP TABLE n")
    with pytest.raises(PySparkException):
        engine.sql("SELECT * FROM n")


def test_commits_are_exclusive(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.append(spark.range(3))
    with pytest.raises(ConcurrentCommit):
        t._commit([], t.read().schema, "late", base=-1)
    assert t.compact() == 1 and t.expire(keep=1) == [0] and len(t.remove_orphans()) == 1 and t.read().count() == 3


def test_merge_rejects_two_sources_for_a_row(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/m")
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    with pytest.raises(ValueError, match="several"):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"])
    assert t.merge(spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string"), ["k"], delete_when="s.v = 'x'") == {"updated": 0, "deleted": 1, "inserted": 1}
    assert sorted(r.k for r in t.read().collect()) == [2, 3]


def test_prepared_and_scripts(engine):
    p = engine.prepare("SELECT count(*) AS n FROM nation WHERE n_regionkey = $1")
    assert [d.first()["n"] for d in p.bind_many([[0], [99]])] == [engine.sql("SELECT count(*) FROM nation WHERE n_regionkey = 0").first()[0], 0]
    p.close()
    with pytest.raises(ValueError):
        p.bind(1)
    assert engine.sql("SELECT 1 AS a; SELECT 2 AS a").first()["a"] == 2


def test_policy_and_states(spark):
    e = Engine(spark, allowed=["nation"])
    spark.read.parquet(f"{SF}/nation.parquet").createOrReplaceTempView("nation")
    assert e.sql("WITH x AS (SELECT * FROM nation) SELECT count(*) AS n FROM x").first()["n"] == 25
    with pytest.raises(AccessDenied) as denied:
        e.sql("SELECT * FROM orders")
    assert sqlstate(denied.value) == "42501"
    with pytest.raises(PySparkException) as missing:
        Engine(spark).sql("SELECT no_such FROM nation")
    assert sqlstate(missing.value) == "42703"


def test_operations(engine):
    op = engine.submit("SELECT count(*) AS n FROM nation")
    assert op.result(60).to_pylist() == [{"n": 25}] and op.status() == "finished" and "seconds" in op.progress()


def test_views_and_live_tables(engine, spark):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v bigint").createOrReplaceTempView("src")
    engine.sql("CREATE MATERIALIZED VIEW sums AS SELECT k, sum(v) AS s FROM src GROUP BY k")
    assert engine.flow.views["sums"].plan[0] == "aggregate"
    spark.createDataFrame([("a", 1), ("c", 9)], "k string, v bigint").createOrReplaceTempView("src")
    engine.sql("REFRESH MATERIALIZED VIEW sums")
    assert {tuple(r) for r in engine.sql("SELECT k, s FROM sums").collect()} == {("a", 1), ("c", 9)}
    engine.sql("DROP MATERIALIZED VIEW sums")
    engine.sql("CREATE LIVE TABLE l AS SELECT count(*) AS n FROM src; REFRESH LIVE TABLE l")
    assert engine.sql("SELECT n FROM l").first()["n"] == 2
    engine.sql("DECLARE RECURSIVE VIEW r AS SELECT 1 AS n UNION SELECT n + 1 FROM r WHERE n < 5")
    assert sorted(x.n for x in engine.sql("SELECT n FROM r").collect()) == [1, 2, 3, 4, 5]


def test_match_recognize(engine, spark):
    spark.createDataFrame([("k", i * 1000) for i in range(7)], "k string, ts bigint").createOrReplaceTempView("ticks")
    out = engine.sql("SELECT * FROM ticks MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts PATTERN (A B C) WITHIN 10 SECONDS)")
    assert out.count() == 6
    with pytest.raises(UnsupportedPattern):
        engine.sql("SELECT * FROM ticks MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts PATTERN (A+ B))")
    with pytest.raises(UnsupportedPattern):
        Pattern.begin("a").one_or_more()


def test_files(spark, tmp_path, engine):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for fmt, read in (("csv", lambda p: read_csv(spark, p, "k int, v string")), ("json", lambda p: read_json(spark, p, "k int, v string"))):
        path = f"file://{tmp_path}/{fmt}"
        write(df, path, fmt, **({"header": "true"} if fmt == "csv" else {}))
        assert sorted(r.k for r in read(path).collect()) == [1, 2]
    assert engine.sql(f"COPY (SELECT * FROM nation) TO 'file://{tmp_path}/out' (FORMAT csv)").first()[0] == 25
    engine.sql(f"CREATE EXTERNAL TABLE ext STORED AS csv LOCATION 'file://{tmp_path}/out'")
    assert engine.sql("SELECT * FROM ext").count() == 25
    with pytest.raises(ValueError):
        check_evolution(df.schema, df.drop("v").schema, "additive")
    with pytest.raises(MissingConnector):
        engine.sql("CREATE EXTERNAL TABLE x STORED AS kinesis LOCATION 'x'")


def test_pipelines(spark, tmp_path):
    p = Pipeline(spark, "p").source("src_p", spark.range(10)).view("b", "SELECT id FROM a WHERE id > 2").view("a", "SELECT id FROM src_p WHERE id < 8")
    assert p.order() == ["a", "b"] and p.run()["b"].count() == 5
    assert p.expect("nowhere", "x", "true").validate()
    assert infer_engine(cdc=True) == "incremental" and infer_engine(windowed=True) == "streaming" and infer_engine() == "batch"
    memo, calls = Memo(spark, f"file://{tmp_path}/memo"), []
    for _ in range(2):
        assert memo.get("q", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1


def test_policy_is_checked_on_the_parsed_plan(spark):
    e = Engine(spark, allowed=["pub", "copy", "view_of_pub"])
    spark.range(5).createOrReplaceTempView("pub")
    spark.range(3).createOrReplaceTempView("secret")
    assert e.sql("SELECT * FROM pub p JOIN pub q USING (id)").count() == 5
    assert e.sql("WITH w AS (SELECT * FROM pub), v AS (SELECT * FROM w) SELECT * FROM v, pub").count() == 25
    assert e.sql("EXPLAIN SELECT * FROM pub").count() == 1
    e.sql("CREATE TABLE copy AS SELECT * FROM pub; DELETE FROM copy WHERE id > 2; PREPARE p AS SELECT * FROM pub WHERE id = $1")
    assert e.sql("EXECUTE p(3)").count() == 1
    for text in (
        "SELECT s.id FROM pub p, secret s", "SELECT * FROM `secret`", "SELECT * FROM default.secret", "SELECT (SELECT max(id) FROM secret) FROM pub", "SELECT * FROM pub WHERE EXISTS (SELECT 1 FROM secret)",
        "EXPLAIN SELECT * FROM secret", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "WITH w AS (SELECT * FROM secret) SELECT * FROM w", "TABLE secret", "INSERT INTO copy SELECT * FROM secret",
        "DELETE FROM copy WHERE id IN (SELECT id FROM secret)", "UPDATE copy SET id = (SELECT max(id) FROM secret)", "MERGE INTO copy USING secret ON copy.id = secret.id WHEN MATCHED THEN DELETE",
        "CREATE TABLE copy AS SELECT * FROM secret", "COPY secret TO '/tmp/x'", "COPY (SELECT * FROM secret) TO '/tmp/x'", "CREATE MATERIALIZED VIEW view_of_pub AS SELECT * FROM secret", "PREPARE q AS SELECT * FROM secret",
        "EXECUTE p((SELECT max(id) FROM secret))", "EXECUTE IMMEDIATE 'SELECT * FROM secret'", "SELECT * FROM IDENTIFIER('sec' || 'ret')", "DESCRIBE secret", "DROP TABLE secret", "TRUNCATE TABLE secret", "not a statement",
        "SELECT * FROM pub UNION ALL SELECT * FROM secret", "SELECT * FROM parquet.`/tmp/x`", "CALL system.maintain('secret')", "SELECT table_name FROM information_schema.tables",
    ):
        with pytest.raises(AccessDenied):
            e.sql(text)
    with pytest.raises(AccessDenied):
        e.table("secret")


def test_rewrites_touch_only_folders_with_hits(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.append(spark.range(100).selectExpr("id", "id % 3 AS k"), partition_by=["k"])
    t.append(spark.range(100, 200).selectExpr("id", "id % 3 AS k"))
    first, second = t.versions()[-1]["folders"]
    assert t.delete("id < 10") == 10 and t.versions()[-1]["folders"][0] == second and first not in t.versions()[-1]["folders"]
    assert t.update({"k": "k + 10"}, "id >= 190") == 10 and t.read().where("k >= 10").count() == 10
    t.merge(spark.createDataFrame([(50, 7), (900, 8)], "id long, k long"), ["id"])
    assert t.read().count() == 191 and t.read(version=1).count() == 200
    # partitions outlive every kind of rewrite
    for _ in range(2):
        names = {p.name for f in t.versions()[-1]["folders"] for p in (tmp_path / "t" / f).iterdir()}
        assert any(n.startswith("k=") for n in names) and t.partitions() == ["k"]
        t.compact()
    assert sorted(r.id for r in t.read().select("id").collect()) == sorted([*range(10, 200), 900])


def test_compaction_makes_files_of_the_target_size(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for _ in range(3):
        t.append(spark.range(0, 20_000, numPartitions=5).selectExpr("id", "uuid() AS u"))
    whole = t.size()
    t.compact(target_bytes=whole // 4)
    files = list((tmp_path / "t" / t.versions()[-1]["folders"][0]).glob("*.parquet"))
    assert 3 <= len(files) <= 6 and t.read().count() == 60_000
    t.compact()
    assert len(list((tmp_path / "t" / t.versions()[-1]["folders"][0]).glob("*.parquet"))) == 1


def test_error_positions(engine):
    with pytest.raises(PySparkException) as e:
        engine.sql("SELECT n_name\nFROM nation WHER x").collect()
    assert error_position(e.value)[0] == 2
    with pytest.raises(PySparkException) as e:
        engine.sql("SELECT nope FROM nation")
    assert error_position(e.value) == (1, 8) and error_position(ValueError("x")) is None

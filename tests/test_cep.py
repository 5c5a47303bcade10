"""The pattern matcher against a plain loop, and what it sends to Python."""

import random

import pytest

from tessera.operators import cep
from tessera.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", ["match_recognize", "match_recognize_within", "match_stages"])
def test_keys_share_python_calls(spark, name):
    """A call for each key, or for each stretch of one, would cost more than the rows."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan


def expected(rows, stages, within):
    """(id, match_id, match_stage), one row of each key at a time; without stages every row is the next."""
    out, keys = [], {}
    for k, t, i, s in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        taken, n = keys.setdefault(k, ([], [0]))
        if taken and t - taken[0][1] > within:
            taken.clear()
        if stages[len(taken)] in (None, s):
            taken.append((i, t))
        if len(taken) == len(stages):
            out += [(j, n[0], at) for at, (j, _) in enumerate(taken)]
            n[0] += 1
            taken.clear()
    return sorted(out)


@pytest.mark.parametrize("batch", ["1", "2", "7", "10000"])
def test_matches_across_batches(spark, batch):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, *range(0, 600, 3)]), i, r.choice(["a", "b", "b", "c", "other"])) for i in range(700)]
    rows += [(9, t, 1000 + t, "a") for t in range(400)]  # one key with many
    df = spark.createDataFrame(rows, "k int, ts bigint, id int, s string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lambda d: sorted((x.id, x.match_id, x.match_stage) for x in d.collect())
        for n, within in ((1, 0), (3, 4), (3, 12), (4, 10**9)):
            assert got(cep.match_any(df, "k", "ts", n, within, ["id"])) == expected(rows, [None] * n, within)
        known = [x for x in rows if x[3] != "other"]
        for stages, within in ((("a", "b", "c"), 40), (("b", "b"), 6), (("a",), 0)):
            want = expected([x for x in known if x[3] in stages], stages, within)
            assert got(cep.match_stages(df, "k", "ts", "s", cep.Pattern(stages, within), ["id"])) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_odd_columns_and_times(spark):
    df = spark.sql("SELECT 'k' AS k, CAST(id AS DOUBLE) AS ts, make_ym_interval(1, CAST(id AS INT)) AS m, make_interval(0, CAST(id AS INT)) AS c, NULL AS v FROM range(5) UNION ALL SELECT 'k', double('NaN'), NULL, NULL, NULL FROM range(3)")
    out = cep.match_any(df, "k", "ts", 2, 10)
    assert [(f.name, f.dataType) for f in out.schema][:5] == [(f.name, f.dataType) for f in df.schema]
    assert out.selectExpr("ts", "CAST(m AS STRING) AS m", "CAST(c AS STRING) AS c", "match_id", "match_stage").orderBy("ts").collect() == [(float(i), f"INTERVAL '1-{i}' YEAR TO MONTH", f"{i} months" if i else "0 seconds", i // 2, i % 2) for i in range(4)]
    assert cep.match_any(df.where("false"), "k", "ts", 2, 10).count() == 0

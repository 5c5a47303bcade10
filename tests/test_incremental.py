"""Incremental results equal recomputed ones, whatever the ticks."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.ivm import CycleLimitExceeded, IncrementalDataFrame, IncrementalFlow, RecursiveView, ZSet
from tessera.ivm.flow import plan_view

SCHEMA = "k string, v bigint, _weight bigint"
ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3), st.sampled_from([1, 1, 2, -1])), max_size=6)


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT k, sum(v) AS s FROM t GROUP BY k", "aggregate"),
        ("SELECT DISTINCT k FROM t WHERE v > 1", "distinct"),
        ("SELECT * FROM t JOIN u USING (k)", "join"),
        ("SELECT k FROM t WHERE v > 1", "linear"),
        ("SELECT k, stddev(v) AS s FROM t GROUP BY k", "diff"),
        ("SELECT k FROM t ORDER BY v LIMIT 3", "diff"),
    ],
)
def test_plans(sql, kind):
    assert plan_view(sql, ["t", "u"])[0] == kind


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(ticks=st.lists(ROWS, min_size=1, max_size=3))
def test_views_equal_recomputation(spark, ticks):
    flow = IncrementalFlow(spark)
    flow.register_source("t", spark.createDataFrame([], "k string, v bigint"))
    flow.register_view("agg", "SELECT k, count(*) AS n, sum(v) AS s, max(v) AS m FROM t GROUP BY k")
    flow.register_view("dis", "SELECT DISTINCT k FROM t")
    have: Counter = Counter()
    for rows in ticks:
        # never more retractions than there are rows
        kept = []
        for k, v, w in rows:
            if have[k, v] + w >= 0:
                have[k, v] += w
                kept.append((k, v, w))
        flow.feed("t", spark.createDataFrame(kept, SCHEMA))
        flow.step()
    groups: dict = {}
    for (k, v), w in have.items():
        if w > 0:
            groups.setdefault(k, []).extend([v] * w)
    assert {r.k: (r.n, r.s, r.m) for r in flow.snapshot("agg").collect()} == {k: (len(v), sum(v), max(v)) for k, v in groups.items()}
    assert sorted(str(r.k) for r in flow.snapshot("dis").collect()) == sorted(map(str, groups))


def test_left_join_takes_back_null_rows(spark):
    flow = IncrementalFlow(spark)
    flow.register_source("l", spark.createDataFrame([], "k int, x string"))
    flow.register_source("r", spark.createDataFrame([], "k int, y string"))
    flow.register_view("j", "SELECT k, x, y FROM l LEFT JOIN r USING (k)")
    flow.feed("l", spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"))
    flow.step()
    flow.feed("r", spark.createDataFrame([(1, "p")], "k int, y string"))
    out = flow.step()["j"]
    assert {tuple(r) for r in out.collect()} == {(1, "a", None, -1), (1, "a", "p", 1)}
    flow.feed("r", ZSet.deletes(spark.createDataFrame([(1, "p")], "k int, y string")))
    flow.step()
    assert {tuple(r) for r in flow.snapshot("j").collect()} == {(1, "a", None), (2, "b", None)}


def test_feeding_twice_lateness_and_checkpoints(spark, tmp_path):
    def make():
        flow = IncrementalFlow(spark)
        flow.register_source("t", spark.createDataFrame([], "ts bigint"), lateness=("ts", 10))
        flow.register_view("n", "SELECT ts, count(*) AS n FROM t GROUP BY ts")
        return flow

    flow = make()
    assert flow.feed_if_advanced("t", 1, spark.createDataFrame([(100,)], "ts bigint"))
    assert not flow.feed_if_advanced("t", 1, spark.createDataFrame([(100,)], "ts bigint"))
    flow.feed("t", spark.createDataFrame([(50,), (95,)], "ts bigint"))
    flow.step()
    assert sorted(r.ts for r in flow.snapshot("n").collect()) == [95, 100]
    path = flow.checkpoint(f"file://{tmp_path}/c")
    other = make()
    other.restore(path)
    other.feed("t", ZSet.deletes(spark.createDataFrame([(95,)], "ts bigint")))
    other.step()
    assert [r.ts for r in other.snapshot("n").collect()] == [100]


def test_snapshot_feed_watch_and_wrapper(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    inc = IncrementalDataFrame(df, "inc_src")
    inc.step()
    seen = []
    inc.flow.watch("inc_src_view", lambda d: seen.append(d.count()))
    inc.flow.feed_snapshot("inc_src", spark.createDataFrame([(2,), (3,)], "k int"))
    inc.flow.step()
    assert sorted(r.k for r in inc.snapshot().collect()) == [2, 3] and seen == [2]
    assert {r["_change_type"] for r in inc.flow.changes("inc_src_view").collect()} == {"insert", "delete"}


def test_recursion_limit(spark):
    with pytest.raises(CycleLimitExceeded):
        RecursiveView(lambda d: d.selectExpr("n + 1 AS n"), limit=3).run(spark.createDataFrame([(0,)], "n int"))


def test_restore_keeps_progress_and_what_was_not_ticked(spark):
    def made():
        flow = IncrementalFlow(spark)
        flow.register_source("src", spark.createDataFrame([], "k int, t long"), ("t", 5))
        flow.register_view("v", "SELECT k, count(*) AS n FROM src GROUP BY k")
        return flow

    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, t long")
    flow = made()
    assert flow.feed_if_advanced("src", 1, batch((1, 100), (2, 100)))
    flow.step()
    assert flow.feed_if_advanced("src", 2, batch((1, 101)))
    path = flow.checkpoint()
    again = made()
    again.restore(path)
    assert not again.feed_if_advanced("src", 2, batch((1, 101)))  # delivered twice
    assert again.feed_if_advanced("src", 3, batch((1, 50), (3, 102)))  # one row is late
    again.step()
    assert {(r.k, r.n) for r in again.snapshot("v").collect()} == {(1, 2), (2, 1), (3, 1)}


@pytest.mark.parametrize("seed", range(2))
def test_left_join_with_null_keys(spark, seed):
    r = random.Random(seed)
    flow = IncrementalFlow(spark)
    left, right = spark.createDataFrame([], "k int, a int"), spark.createDataFrame([], "k int, b int")
    flow.register_source("l", left)
    flow.register_source("r", right)
    flow.register_view("v", "SELECT k, a, b FROM l LEFT JOIN r USING (k)")
    have = {"l": [], "r": []}
    for _ in range(4):
        for name, schema in (("l", "k int, a int"), ("r", "k int, b int")):
            new = [(r.choice([None, 1, 2, 3]), r.randint(0, 9)) for _ in range(3)]
            gone = [have[name].pop(r.randrange(len(have[name])))] if have[name] and r.random() < 0.5 else []
            have[name] += new
            delta = ZSet.inserts(spark.createDataFrame(new, schema))
            flow.feed(name, delta.concat(ZSet.deletes(spark.createDataFrame(gone, schema))) if gone else delta)
        flow.step()
        want = spark.createDataFrame(have["l"], "k int, a int").join(spark.createDataFrame(have["r"], "k int, b int"), ["k"], "left").select("k", "a", "b")
        assert sorted(map(str, flow.snapshot("v").collect())) == sorted(map(str, want.collect()))

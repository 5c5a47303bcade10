"""Envelopes are parsed once, and a log of changes is read once."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import cdc
from tessera.sources.versioned import VersionedTable

ROW = "k BIGINT, v STRING"


def envelope(op, before, after, ts):
    return f'{{"op":"{op}","before":{before},"after":{after},"source":{{"ts_ms":{ts},"lsn":1,"table":"t"}}}}'


def test_one_parse_a_text(spark):
    """Neither fields nor filters parse the text again."""
    log = spark.range(1).select(F.concat(F.lit('{"op":"c","after":{"k":'), F.col("id").cast("string"), F.lit("}}")).alias("x"))
    out = cdc.parse_envelopes(log, "x", ROW).where("op <> 'd'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, plan


def test_odd_texts(spark):
    inner = envelope("u", '{"k":1,"v":"a"}', '{"k":1,"v":"payload"}', 5)
    texts = [inner, f'{{"payload":{inner}}}', f'{{"\\u0070ayload":{inner}}}', '{"payload":' + repr(inner.replace('"', '\\"')).replace("'", '"').replace("\\\\", "\\") + "}", '{"payload":null,"op":"c","after":{"k":2}}', "junk", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    out = cdc.parse_envelopes(df, "x", ROW).collect()
    assert len(out) == len(texts)
    assert sorted((r.op or "", r.ts_ms or 0, r.after.v if r.after else None) for r in out if r.op == "u") == [("u", 5, "payload")] * 4
    assert [r.after.k for r in out if r.op == "c"] == [2] and sum(r.op is None and r.before is None and r.after is None for r in out) == 3


@pytest.mark.parametrize("times", [1, 2])
def test_log_is_read_once(spark, tmp_path, times):
    """Keys that are gone and were never there stay away, NULL among them; later calls change what is left."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"])
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    def apply(*envelopes):
        df = spark.createDataFrame([(e,) for e in envelopes], "x string").select(seen("x").alias("x"))
        before = reads.value
        return cdc.apply_changes(t, cdc.parse_envelopes(df, "x", ROW), ["k"]), reads.value - before

    row = lambda k, v: f'{{"k":{k},"v":"{v}"}}'
    counts, n = apply(*[envelope("c", "null", row(k, "a"), 1) for k in range(4)])
    assert counts == {"updated": 0, "deleted": 0, "inserted": 4} and n == 4
    log = [envelope("u", row(1, "a"), row(1, "b"), 2), envelope("u", row(1, "b"), row(1, "c"), 3), envelope("d", row(2, "a"), "null", 2), envelope("d", row(9, "a"), "null", 2), envelope("d", row("null", "a"), "null", 2), envelope("c", "null", row(7, "n"), 2)]
    for i in range(times):
        counts, n = apply(*log)
        assert n == len(log) and counts == ({"updated": 1, "deleted": 1, "inserted": 1} if i == 0 else {"updated": 2, "deleted": 0, "inserted": 0})
    assert sorted(map(tuple, t.read().collect())) == [(0, "a"), (1, "c"), (3, "a"), (7, "n")]

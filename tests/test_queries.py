"""Every registered query against its SQL in another engine, on the smallest tables."""

import hashlib
import zlib

import pytest

from tessera.plans import registry

from .conftest import SF, same_rows

SLOW = ("stream_", "ivm_")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        same_rows(got, duck.sql(registry.ORACLES[name]).df())
    else:
        CHECKS[name](spark, duck, got)


def _sampled(spark, duck, got):
    events = duck.sql("SELECT * FROM events").df()
    assert 0.05 * len(events) < len(got) < 0.15 * len(events) and set(got.event_id) <= set(events.event_id) and got.event_id.is_unique


def _approximate(spark, duck, got):
    true = duck.sql("SELECT count(DISTINCT user_id) FROM events").fetchall()[0][0]
    assert abs(got.users[0] - true) <= 0.1 * true


def _crc(spark, duck, got):
    names = dict(duck.sql("SELECT p_partkey, p_name FROM part").fetchall())
    assert len(got) == len(names)
    for k, c, s in zip(got.p_partkey, got.c, got.s, strict=True):
        assert c == zlib.crc32(names[k].encode()) and s == hashlib.sha512(names[k].encode()).hexdigest()


def _random(spark, duck, got):
    assert got.r.between(0, 1).all() and got.r.is_unique and got.u.is_unique and got.u.str.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}").all() and got.t.nunique() == 1


#: Queries that SQL of the other engine can't express are held against what their rows must satisfy.
CHECKS = {"sample_rows": _sampled, "approximate_distinct": _approximate, "fn_crc32": _crc, "fn_random": _random}


def test_every_query_has_sql_or_a_check():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(CHECKS)

"""Every registered query of the engine against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from folium import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.SQL:
        return
    q = con.execute(registry.SQL[name])
    cols = [c[0] for c in q.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in q.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_prune(spark):
    plan = registry.QUERIES["rejections_anti"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_event_modes_are_of_users(spark, con):
    got = {r.event_type: r for r in registry.QUERIES["event_modes"](spark, SF).collect()}
    counts = {}
    for kind, user, n in con.execute("select event_type, user_id, count(*) from events where user_id is not null group by all").fetchall():
        counts.setdefault(kind, []).append((-n, user))
    assert {k: (r.mode_user, r.n_events) for k, r in got.items()} == {k: (min(v)[1], -min(v)[0]) for k, v in counts.items()}
    assert len({r.mode_user for r in got.values()}) > 1

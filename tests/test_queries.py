"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalog, queries  # noqa: F401  catalog registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def even(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql_says(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(even(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(even(x) for x in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_the_same_twice(spark, name):
    a, b = (sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["user_id", "win", "y", "z"] and df.take(1)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_robust_z_of_days_before_rounding(spark, tmp_path):
    """Days whose sums rounding moves: the score is the unrounded day's."""
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 06:00:00' + INTERVAL {i} DAY, 1, 'view', {v}, '{{}}')" for i, v in enumerate((1e-7, 3e-7, 4e-7, 9e-7, 6e-7)))
    c = duckdb.connect()
    c.execute(f"create view events as select * from (values {rows}) v(event_id, ts, user_id, event_type, value, props)")
    c.execute(f"copy (select event_id::bigint event_id, ts, user_id::bigint user_id, event_type, value::double \"value\", props from events) to '{tmp_path}/events.parquet' (format parquet)")
    want = sorted(tuple(map(even, r)) for r in c.execute(queries.SQL["robust_z_trailing"]).fetchall())
    assert len({w[3] for w in want}) > 2
    assert sorted(tuple(map(even, r)) for r in queries.QUERIES["robust_z_trailing"](spark, str(tmp_path)).select("user_id", "day", "y", "z").collect()) == want

"""Every registered query against its SQL, on the smallest data."""

import glob
import os

import pytest

from quern.plans import registry
from verify import canon

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


def test_names_are_ids_with_words():
    assert all(n[0].isalpha() and "_" in n for n in QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", ["a14_loss_summary", "a17_monitor_summary"])
def test_zero_losses(name, spark, tmp_path):
    """Runs whose val losses are zero first, last or always; an event of value 0 and an id divisible by 13 has train loss 0."""
    import duckdb

    values = {1: [0.0, 1.0, 2.0], 2: [3.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0], 4: [5.0, 6.0, 7.0]}
    rows = [(13 * (10 * run + i), i, run, v) for run, own in values.items() for i, v in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(ts) ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(tuple(canon(r[names.index(x)]) for x in sorted(df.columns)) for r in cur.fetchall())

"""Every registered query of the engine against the same in DuckDB."""

import glob
import os

import duckdb
import pytest

from veilgrid.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def rows_of(names, rows):
    return sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    rows = rows_of(got.columns, got.collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == rows_of(want.columns, want.fetchall())
    else:
        assert rows


def test_first_hit_windows_against_a_plain_fold(spark, data):
    from pyspark.sql import functions as F

    got = {r.event_id: (r.hit, r.allowed) for r in catalog.rate_first_hit_windows(spark, data).collect()}
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").collect()
    start, n = {}, {}
    for e in sorted(events, key=lambda e: (e.t, e.event_id)):
        if e.user_id not in start or e.t - start[e.user_id] >= 3_600_000_000:
            start[e.user_id], n[e.user_id] = e.t, 0
        n[e.user_id] += 1
        assert got[e.event_id] == (n[e.user_id], n[e.user_id] <= 2)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

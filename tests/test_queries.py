"""Every registered query of the engine against DuckDB."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cells(rows, order):
    def cell(x):
        return f"{x:.9g}" if isinstance(x, float) else int(x) if isinstance(x, bool) else x

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    rows = out.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    heads = [d[0] for d in result.description]
    assert sorted(heads) == sorted(out.columns)
    got = cells(rows, [out.columns.index(c) for c in sorted(heads)])
    assert got == cells(result.fetchall(), [heads.index(c) for c in sorted(heads)])


def _event_tables(spark, duck, folder, rows):
    """The events of a folder, which DuckDB sees as `events` in a connection of its own."""
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    return con


def test_time_filter_ends_at_its_second(spark, duck, tmp_path):
    """An event within the second after the end is outside; the bounds themselves are inside."""
    at = [1704239999.9, 1704240000, 1704240000.5, 1704671999.9, 1704672000, 1704672000.000001, 1704672000.7, 1704672001, None]
    times = [t and datetime.datetime.fromtimestamp(t, datetime.UTC) for t in at]
    con = _event_tables(spark, duck, tmp_path, [(k, t, 1, "view", 0.0, "{}") for k, t in enumerate(times)])
    want = con.execute(ORACLE_SQL["time_filter_macro"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["time_filter_macro"](spark, str(tmp_path)).collect()) == sorted(want) == [(k,) for k in (1, 2, 3, 4)]


def test_times_compare_with_their_fraction(spark):
    from tidemark.operators.select import run_select
    from tidemark.plans.parser import parse

    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(1, 99.5, 100), (2, 100.0, 100), (3, 100.5, 100)], "n long, s double, bound long")
        df = df.withColumn("ts", F.timestamp_seconds("s").cast(kind)).withColumn("other", F.timestamp_seconds(F.lit(100.25)).cast(kind))
        for where, want in {
            "ts <= 100": [1, 2], "ts > 100": [3], "100 < ts": [3], "ts = 100": [2], "ts != 100": [1, 3], "ts <= bound": [1, 2],
            "bound < ts": [3], "ts < 100.5": [1, 2], "ts >= 50 + 50": [2, 3], "ts < other": [1, 2], "ts < 10000000000000000": [1, 2, 3],
        }.items():
            got = run_select(df, parse(f"SELECT n FROM t WHERE {where}")).collect()
            assert sorted(r[0] for r in got) == want, (kind, where)


def test_topn_orders_by_the_time_itself(spark, duck, tmp_path):
    """Of events within one second the latest comes first, whatever its id; those without a time come last."""
    at = [1704240000.9, 1704240000.1, 1704240000.5, 1704239000.0, None, 1704240000.5]
    times = [t and datetime.datetime.fromtimestamp(t, datetime.UTC) for t in at]
    con = _event_tables(spark, duck, tmp_path, [(10 - k, t, k // 6, "view", 0.0, "{}") for k, t in enumerate(times)] + [(20, None, 7, "view", 0.0, "{}")])
    for name in ("qualify_topn", "rank_row_number"):
        want = con.execute(ORACLE_SQL[name]).fetchall()
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want), name
    top = {tuple(r) for r in QUERIES["qualify_topn"](spark, str(tmp_path)).collect()}
    assert top == {(0, 10, 1), (0, 5, 2), (0, 8, 3), (7, 20, 1)}


def test_rows_sort_by_the_time_itself(spark):
    from tidemark.operators.select import run_select
    from tidemark.plans.parser import parse

    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(1, 100.2), (2, 100.9), (3, 100.5), (4, None)], "n long, s double").withColumn("ts", F.timestamp_seconds("s").cast(kind))
        for text, want in {"SELECT n FROM t ORDER BY ts": [1, 3, 2, 4], "SELECT * FROM t ORDER BY ts DESC LIMIT 3": [4, 2, 3]}.items():
            assert [r["n"] for r in run_select(df, parse(text)).collect()] == want, (kind, text)
        assert [r["n"] for r in run_select(df, parse("SELECT n FROM t ORDER BY ts DESC LIMIT 1"), undefined_last=True).collect()] == [2]

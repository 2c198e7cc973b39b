"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from barloom import queries

DIR = "/root/testdata/sf0.001"
TABLES = "customer events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events of one type, some of them zero: the least value of some hours, never their last."""
    folder = tmp_path_factory.mktemp("zeros")
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-02 00:00:00' + INTERVAL 20 MINUTE * i AS ts, 1 AS user_id, 'click' AS event_type,
    CASE WHEN i % 30 = 1 THEN 0.0 ELSE 1 + i % 7 END::DOUBLE AS value, '' AS props FROM range(180) r(i)) TO '{folder}/events.parquet'""")
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), c


def agrees(spark, zeros, name):
    want = zeros[1].execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    return plain(queries.QUERIES[name](spark, zeros[0]).select(*names).collect()) == plain(want.fetchall())


def test_a_run_keeps_bars_with_zeros(spark, zeros):
    assert agrees(spark, zeros, "run_features")


def test_the_report_of_a_run_counts_bars_with_zeros_as_kept(spark, zeros):
    assert agrees(spark, zeros, "run_report")


@pytest.fixture(scope="module")
def autumn(tmp_path_factory):
    """Events of one type around the end of summer time in New York."""
    folder = tmp_path_factory.mktemp("autumn")
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-11-02 12:00:00' + INTERVAL 20 MINUTE * i AS ts, 1 AS user_id, 'click' AS event_type,
    (1 + i % 7)::DOUBLE AS value, '' AS props FROM range(180) r(i)) TO '{folder}/events.parquet'""")
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["run_report", "run_features"])
def test_a_run_takes_bars_of_all_seasons(spark, autumn, name):
    assert agrees(spark, autumn, name)

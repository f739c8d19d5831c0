"""Every query of the engine against its SQL, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from weftline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    want = sorted(repr([plain(r[have.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("orders", "customers"), [(1_000_001, "range(40)"), (300, "range(40)"), (300, "range(0)"), (300, "(SELECT nullif(range, 3) FROM range(40))")])
def test_append_rows_to_odd_tables(spark, tmp_path, orders, customers):
    """Orders that hold every key that would be drawn; orders without a customer; no customers; a customer without a key."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT k::BIGINT AS c_custkey, 'x' AS c_name, 1::INT AS c_nationkey FROM {customers} t(k)")
    con.execute(f"CREATE VIEW orders AS SELECT k::BIGINT AS o_orderkey, CASE WHEN k % 7 <> 0 THEN k % 45 END::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1.5::DOUBLE AS o_totalprice FROM range({orders}) t(k)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = QUERIES["append_rows"](spark, str(tmp_path)).select("n_new", "n_keys", "clashes", "orphans", "tables").collect()
    assert [tuple(r) for r in got] == con.execute(ORACLES["append_rows"]).fetchall()

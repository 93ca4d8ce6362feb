"""Every query of the metrics engine against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


def table(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = table(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    done = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    assert got == table(tuple(r[names.index(c)] for c in columns) for r in done.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)

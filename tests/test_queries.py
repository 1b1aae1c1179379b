"""Every registered query of the library against its SQL on the supplied tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from skein.plans import catalog
from skein.sources.derive import BASE

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    """A value as both engines give it."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF_DIR)
    got = df.collect()
    if name not in catalog.oracle_sql():
        return
    ran = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in ran.description]
    want = ran.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert normal(df.columns, got) == normal(names, want)

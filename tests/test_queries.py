"""Every query against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os
from collections import Counter

import pytest

from tessera import registry


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    sql = registry.ORACLES.get(name)
    if not sql:
        assert rows
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    expected = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])

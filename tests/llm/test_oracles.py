import glob
import os
from collections import Counter

import pytest

from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == Counter(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())

"""Every core query against its DuckDB SQL on the smallest test tables."""

import glob
import math
import os

import pytest

from quirewright.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, FOLDER)
    got = [r.asDict() for r in df.collect()]
    if sql is None:
        return
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(names)

    def plain(row):
        values = (row[c] for c in sorted(names))
        return str([float(f"{v:.9g}") if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) else v for v in values])

    assert sorted(map(plain, got)) == sorted(map(plain, want))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE.get(name))

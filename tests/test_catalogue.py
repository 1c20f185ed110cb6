import os

import duckdb
import pytest

from spanloom.plans import catalogue

AT = "/root/testdata/sf0.01"
TABLES = ["documents", "benchmark", "pages", "conversations", "labels", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, AT)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        return
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda rows: sorted((tuple(r) for r in rows), key=str)
    want = norm([r[names.index(c)] for c in sorted(names)] for r in cur.fetchall())
    assert norm([r[c] for c in sorted(names)] for r in got) == want

import duckdb
import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark orders labels".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    key = lambda row: tuple(map(repr, row))
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=key)
    assert mine == theirs

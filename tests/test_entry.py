import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def norm(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        got.count()
        return
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert norm(map(tuple, got.select(*names).collect())) == norm(rel.fetchall())

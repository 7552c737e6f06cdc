import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return "[" + ",".join(map(plain, value)) + "]" if isinstance(value, (list, tuple)) else repr(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    frame, relation = entry.queries()[name](spark, sf_dir), duck.sql(entry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(k) for k in columns]
    got = sorted(tuple(plain(r[k]) for k in columns) for r in frame.collect())
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

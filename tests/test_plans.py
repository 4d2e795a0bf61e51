"""Every query of the library against its SQL twin, over the whole small tables."""

import math

import duckdb
import pytest

from lamina import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(v) if isinstance(v, (str, bool)) else repr(float(v))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    rel = duck.sql(plans.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    have = sorted(tuple(norm(v) for v in r) for r in got.select(*cols).collect())
    assert have == want and have


def test_negative_control(spark, duck):
    """A wrong window frame must be seen."""
    sql = plans.oracle_sql()["layout_cursor"].replace("and 1 preceding", "and current row")
    want = sorted(norm(r[2]) for r in duck.sql(sql).fetchall())
    assert want != sorted(norm(r["x"]) for r in plans.queries()["layout_cursor"](spark, DIR).collect())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

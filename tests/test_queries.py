"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(frame):
    cols = sorted(frame.columns)
    value = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(value(v) for v in r) for r in frame[cols].astype(object).values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = pd.DataFrame(df.collect(), columns=df.columns)
    if sql := registry.oracle_sql().get(name):
        found = duck.sql(sql)
        assert plain(got) == plain(pd.DataFrame(found.fetchall(), columns=found.columns))
    else:
        assert len(got) > 0


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())

"""Every registered query of the engine against its SQL twin in DuckDB."""

import duckdb
import pandas as pd
import pytest

from strandweave.plans import catalog
from strandweave.sources.bind import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v).replace(" 00:00:00", "").removesuffix(".0"))
    return sorted(df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_twin(spark, name):
    """What SQL can't say gives rows of a stable schema; its small cases are in the other tests."""
    query = catalog.QUERIES[name]
    found = query(spark, DATA)
    assert found.schema == query(spark, DATA).schema
    assert not found.isEmpty()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    twin = duck.sql(catalog.ORACLE_SQL[name])
    expected = pd.DataFrame(twin.fetchall(), columns=twin.columns)
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found) == normal(expected)

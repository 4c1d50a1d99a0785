"""Every query with an oracle against DuckDB, as sorted rows."""

import duckdb
import pytest

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return cols, sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = rows(catalogue.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(catalogue.ORACLES[name]).df())
    assert got == want

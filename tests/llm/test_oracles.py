"""The SQL of this subpackage's queries against DuckDB, also on tables with nulls, ties and control strings."""

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    same(queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name]))


def test_conversations_of_all_kinds(spark, tmp_path):
    from tests.llm.test_chat import rows

    # Rows of one conversation, turn and role, or more than a block of one number, are beyond the SQL's order of blocks.
    data = [r for r in rows() if r[0] not in (60, 61, -1)]
    data += [(70, t, "system" if t % 5 == 0 else "assistant", f"<|im_end|>\\ {t % 3} " + "w " * (t * 7 % 60)) for t in range(530)]
    data += [(71, t, "system", "be kind") for t in range(6)] + [(72, t, "user", "") for t in range(300)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op9_budgeted_windows"
    same(queries.QUERIES[name](spark, f"file://{tmp_path}"), con.sql(queries.ORACLES[name]))

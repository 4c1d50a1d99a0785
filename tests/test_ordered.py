"""Windows over a total order against plain loops, on even, tied, null and one-key data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import operations, ordered, search

SCHEMA = "id long, k string, t long, v long, s string"


def shapes():
    rnd = random.Random(2)
    mixed = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, 1, 2, 3, rnd.randrange(1000)]), rnd.choice([None, rnd.randrange(9)]), rnd.choice("xyz")) for i in range(400)]
    return {"mixed": mixed, "one key": [(i, "a", i * 7 % 400, 1, "xyz"[i % 3]) for i in range(400)], "one time": [(i, "b", 5, i, "x") for i in range(300)], "no time": [(i, None, None, i, None) for i in range(50)], "one row": [(1, "a", 1, 1, "x")], "none": []}


def low(*values):
    """Ascending, nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


@pytest.fixture(params=sorted(shapes()))
def case(spark, request):
    rows = shapes()[request.param]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_running_sum(case):
    rows, df = case
    got = {r.id: (r.before, r.total) for r in ordered.running_sum(df, "v", [F.col("t"), F.col("id")], ranges=7).collect()}
    want, at, total = {}, 0, sum(r[3] or 0 for r in rows)
    for r in sorted(rows, key=lambda r: low(r[2], r[0])):
        want[r[0]] = (at, total)
        at += r[3] or 0
    assert got == want


def test_previous(case):
    rows, df = case
    got = {r.id: r.p for r in ordered.previous(df, "k", "s", [F.col("t"), F.col("id")], "p", ranges=7).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: low(r[2], r[0])):
        want[r[0]] = last.get(r[1])
        last[r[1]] = r[4]
    assert got == want


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_beyond(case, n):
    rows, df = case
    got = sorted(r.id for r in ordered.beyond(df, "k", n, [F.col("t"), F.col("id")]).collect())
    want = []
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: low(r[2], r[0]), reverse=True)
        want += [r[0] for r in mine[n:]]
    assert got == sorted(want)


@pytest.mark.parametrize("down", [True, False])
def test_pages(case, down):
    rows, df = case
    order = [(F.col("t"), down), (F.col("id"), False)]
    whole = [r.id for r in df.orderBy(F.col("t").desc_nulls_last() if down else F.col("t").asc_nulls_first(), "id").collect()]
    for start in (0, 13, 150, len(rows) - 3, len(rows) + 5):
        if start >= 0:
            assert [r.id for r in ordered.page(df, order, start, 10, ranges=8).collect()] == whole[start : start + 10], start
    docs = df.select("id", F.col("t").cast("double").alias("created_at"))
    deep, search.DEEP = search.DEEP, 20
    try:
        assert [r.id for r in search.sort_page(docs, descending=down, page=9, size=20).collect()] == whole[160:180]
    finally:
        search.DEEP = deep


def test_no_task_has_more_than_a_fair_share_of_one_key(spark):
    df = spark.range(20_000).select("id", F.lit("a").alias("k"), F.lit(1).alias("t"), F.lit(1).alias("v"))
    shares = ordered.in_ranges(df, [F.col("k"), F.col("t"), F.col("id")], 16).groupBy(ordered.GROUP).count().collect()
    assert len(shares) == 16 and max(r["count"] for r in shares) < 2 * 20_000 / 16
    plan = ordered.page(df, [(F.col("t"), False), (F.col("id"), False)], 19_000, 10, 16)
    skipped = re.search(r"Offset (\d+)", plan._jdf.queryExecution().optimizedPlan().toString())
    assert int(skipped[1]) < 2 * 20_000 / 16  # rows before the page within its range
    assert [r.id for r in plan.collect()] == list(range(19_000, 19_010))


def test_retention_keeps_few_rows_a_task_before_it_shuffles(spark):
    df = spark.range(1000).select("id", F.lit("a").alias("k"))
    plan = operations.beyond_newest(df, "k", 3, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

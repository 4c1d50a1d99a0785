"""Windows over a total order without one task that holds it: ranges of the order, and what each range hands to the next.

An order is a list of expressions, ascending, nulls first (a descending number is negated); the last ones should tell all rows
apart, for rows that are equal in all of them stay together in one range. Rows are cut into ranges at quantiles of a sample that a
hash chooses. The sample decides only how even the ranges are, never a result, and is at most about SAMPLE keys for each range
however large the table is. A range's own part is a window in its task; sums, last rows or counts of all ranges are one small
table of a row each, which is carried along the order and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows aimed at in one range, most ranges, keys in the sample for each range.
RANGE_ROWS, MOST_RANGES, SAMPLE = 1 << 20, 4095, 64
KEY, GROUP = "__key", "__range"


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df with __key (the order as a struct) and __range, numbers that ascend with the order from 0."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = df.withColumn(KEY, key)
    total = df.count()
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    ranges = max(1, min(ranges, MOST_RANGES, total))
    if ranges == 1:
        return keyed.withColumn(GROUP, F.lit(0))
    one_of = max(1, total // (ranges * SAMPLE))
    sampled = keyed.filter(F.pmod(F.xxhash64(KEY), F.lit(one_of)) == 0).agg(F.sort_array(F.collect_list(KEY)).alias("s"))
    places = F.sequence(F.lit(1), F.lit(ranges - 1))
    cuts = sampled.select(F.array_distinct(F.filter(F.transform(places, lambda i: F.get("s", F.floor(i * F.size("s") / ranges).cast("int"))), lambda x: x.isNotNull())).alias("__cuts"))
    # How many cuts lie below the key, by halving; one row of cuts goes to every task.
    steps = [1 << p for p in reversed(range(ranges.bit_length()))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < F.col(KEY), at + step).otherwise(at))
    return keyed.crossJoin(F.broadcast(cuts)).withColumn(GROUP, below).drop("__cuts")


def _inside() -> Window:
    return Window.partitionBy(GROUP).orderBy(KEY)


def running_sum(df: DataFrame, value: str, order: list[Column], before: str = "before", total: str = "total", ranges: int | None = None) -> DataFrame:
    """df with the sum of `value` over all earlier rows of the order, and over all rows."""
    rows = in_ranges(df, order, ranges)
    none = F.lit(0)
    sums = rows.groupBy(GROUP).agg(F.coalesce(F.sum(value), none).alias("__s"))
    # One row for each range, at most MOST_RANGES + 1.
    carried = sums.select(GROUP, F.coalesce(F.sum("__s").over(Window.orderBy(GROUP).rowsBetween(Window.unboundedPreceding, -1)), none).alias("__c"), F.sum("__s").over(Window.partitionBy(F.lit(0))).alias(total))
    own = F.coalesce(F.sum(value).over(_inside().rowsBetween(Window.unboundedPreceding, -1)), none)
    return rows.withColumn(before, own).join(F.broadcast(carried), GROUP).withColumn(before, F.col("__c") + F.col(before)).drop(GROUP, KEY, "__c")


def previous(df: DataFrame, key: str, value: str, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """df with `name`: the value of the row before, among the rows of the same key. The order is that of (key, *order) over all
    rows, so a key with many rows is cut like any other."""
    rows = in_ranges(df, [F.col(key), *order], ranges)
    here = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    last = rows.groupBy(GROUP).agg(F.max_by(here, KEY).alias("__l"))
    carried = last.select(GROUP, F.lag("__l").over(Window.orderBy(GROUP)).alias("__c"))
    out = rows.withColumn("__p", F.lag(here).over(_inside())).join(F.broadcast(carried), GROUP)
    before = F.coalesce("__p", "__c")
    return out.withColumn(name, F.when(before["k"].eqNullSafe(F.col(key)), before["v"])).drop(GROUP, KEY, "__p", "__c")


def beyond(df: DataFrame, key: str, n: int, recency: list[Column]) -> DataFrame:
    """The rows of each key that are older than its n newest; recency: ascending, nulls oldest, telling the rows of a key apart.

    Each task keeps its n newest rows of a key, so the n-th newest of all is found from few rows; the rest is a filter. Keys are
    joined null-safe, and a key with many rows is only compared with its one limit.
    """
    rows = df.withColumn(KEY, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(recency)]))
    newest = rows.select(key, KEY).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(KEY).desc()))).filter(F.col("__n") <= n)
    limit = newest.groupBy(key).agg(F.min(KEY).alias("__limit"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == n)
    limit = limit.select(F.col(key).alias("__k"), "__limit")
    return rows.join(limit, F.col(key).eqNullSafe(F.col("__k")) & (F.col(KEY) < F.col("__limit"))).select(*df.columns)


def page(df: DataFrame, order: list[tuple[Column, bool]], start: int, size: int, ranges: int | None = None) -> DataFrame:
    """Rows start to start + size of an order of (expression, descending) pairs; ascending has nulls first, descending last.

    Ranges of the first expression are counted, and only those are kept that the page touches; a range of one value that is
    still large is cut by the next expression. What is left is sorted.
    """
    sort = [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in order]
    rows = df
    for c, down in order:
        cut = in_ranges(rows, [c], ranges)
        counts = cut.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(KEY).alias("values")).collect()  # a row for each range
        at, kept, spread = 0, [], 0
        for r in sorted(counts, key=lambda r: r[GROUP], reverse=down):
            if at + r.n > start and at < start + size:
                kept.append(r)
            elif at + r.n <= start:
                spread += r.n
            at += r.n
        if not kept:
            return df.limit(0)
        start -= spread
        rows = cut.filter(F.col(GROUP).isin([r[GROUP] for r in kept])).drop(GROUP, KEY)
        if len(kept) > 1 or kept[0]["values"] > 1:
            break
    return rows.orderBy(*sort).offset(start).limit(size)

"""Connected components of an edge table, distributed, without hot vertices in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that can be reached from each node of `edges` (two long columns).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change: then every
    node points straight at the smallest of its component. Each step is a group-by with map-side combine and one join
    whose skewed side AQE may split. The edges of each round are written to the shared folder, which cuts the lineage.
    Self loops and repeated edges are harmless, edges with a null end are no edges, no edges give an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = stored(e, "cc")
    mark = _mark(e)
    if not mark[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below reads two plain tables and AQE can split a vertex with very many edges.
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # Large star: neighbours above u point at the least of u's neighbourhood.
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its neighbours below point at the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.select("u", F.col("m").alias("v")).unionAll(moved).distinct(), "cc")
        new_mark = _mark(new)
        discard(e)
        discard(low)
        e = new
        if new_mark == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = new_mark
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def _mark(e: DataFrame) -> tuple:
    """Count and an order-free digest of the edges."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h

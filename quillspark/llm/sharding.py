"""Sharding by vector bin packing.

Documents of equal text form a group with the vector (bytes, tokens, rows). Groups are placed from large to small, each in
the shard where the dot product of its vector with the shard's residual capacity is highest, so bytes, tokens and rows are
balanced jointly. Only groups above 1/FINE of a total take part one by one (at most 3 * FINE of them); all others are
packed as at most CLASSES * SLICES bundles by size class and hash. So the driver places a number of items that doesn't
grow with the data, and text is never shuffled. A group of more bytes than a whole shard may hold can't keep the law of
near equal sizes in one piece; it is dealt by doc_id (rows without one by their place) to the least number of parts that
fit.

Tokens are a column of counts, if one is named, as op6 or op8 give them; else the runs of letters, of digits and of other
marks, which are what byte-level BPE splits a text into.

Size is the UTF-8 length plus 1 (null: 1); null and empty texts are one group. Texts count as equal if their 64-bit hash,
size and CRC-32 are. Repeated rows are rows like any other and get a slot each. Slots are gapless from 0 in each shard:
positions within small sub-buckets, in the order of doc_id, plus the counts of those before. Texts of any length are read
once. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.llm.common import free_name, scratch, stored, text_or_empty

SHARDS = 8
FINE = 8192
CLASSES, SLICES = 24, 256
#: Rows aimed at in one sub-bucket of a shard, and the most sub-buckets.
SLOT_ROWS, MOST_SUBS = 50_000, 4096


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of non-negative vectors, placed from large to small by the highest dot product."""
    total = vectors.sum(0)
    items = vectors / np.where(total > 0, total / shards, 1)
    residual, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(1, initial=0))):
        out[i] = k = int((residual @ items[i]).argmax())
        residual[k] -= items[i]
    return out


#: Columns that tell a group of equal texts.
GROUP = ["h", "size", "text_crc32"]
#: Fixed value: the split of byte-level BPE without its white space.
PIECES = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def _measured(docs: DataFrame, text: str, key: str, tokens: str | None, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, h, tokens and, to carry, the whole row as a struct."""
    t = text_or_empty(text)
    count = F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)) if tokens else F.regexp_count(t, F.lit(PIECES)).cast("long")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("h"), *([] if carry else [count.alias("tokens")]), *whole)


def _bundle() -> Column:
    """The bundle of a row or group by its size and hash."""
    size_class = F.least(F.floor(F.log2(F.col("size").cast("double"))).cast("int"), F.lit(CLASSES - 1))
    return size_class * SLICES + F.pmod(F.col("h"), F.lit(SLICES)).cast("int")


def _plan(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """Where each large group's parts and each bundle go (numbers of rows that the constants bound), and the number of rows."""
    spark = rows.sparkSession
    sums = [F.sum(F.col("size")).alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    totals = rows.agg(*sums).first()
    of = {c: totals[c] or 0 for c in ("bytes", "tokens", "rows")}
    groups = stored(rows.groupBy(*GROUP).agg(*sums), "groups")
    large = (F.col("bytes") * FINE > of["bytes"]) | (F.col("tokens") * FINE > of["tokens"]) | (F.col("rows") * FINE > of["rows"])
    capacity = max(1, of["bytes"] / shards)
    items, names = [], []
    for g in groups.filter(large).orderBy(*GROUP).collect():  # fewer than 3 * FINE
        parts = int(-(-g.bytes // capacity)) if g.bytes > capacity else 1
        items += [(g.bytes / parts, g.tokens / parts, g.rows / parts)] * parts
        names += [(*(g[c] for c in GROUP), p, parts) for p in range(parts)]
    bundles = groups.filter(~large).groupBy(_bundle().alias("bundle")).agg(*[F.sum(c).alias(c) for c in of]).orderBy("bundle").collect()
    items += [(b.bytes, b.tokens, b.rows) for b in bundles]
    placed = pack(np.array(items, float).reshape(-1, 3), shards).tolist()
    of_large = spark.createDataFrame([(*n, s) for n, s in zip(names, placed, strict=False)], "h long, size long, text_crc32 long, part int, parts int, large_shard int")
    of_bundle = spark.createDataFrame([(b.bundle, s) for b, s in zip(bundles, placed[len(names) :], strict=True)], "bundle int, bundle_shard int")
    return of_large, of_bundle, of["rows"]


def _placed(rows: DataFrame, plan: tuple[DataFrame, DataFrame, int], shards: int) -> DataFrame:
    """rows with shard and sub (its sub-bucket of the shard), written: parts of rows without doc_id depend on their place."""
    of_large, of_bundle, n_rows = plan
    parts = of_large.filter("part = 0").select(*GROUP, "parts")
    own = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())
    subs = max(1, min(MOST_SUBS, n_rows // (SLOT_ROWS * shards) + 1))
    put = rows.withColumns({"place": F.xxhash64(own), "sub": F.pmod(F.xxhash64(own, F.col("h")), F.lit(subs)).cast("int")})
    put = put.join(F.broadcast(parts), GROUP, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod("place", "parts").cast("int")))
    put = put.join(F.broadcast(of_large.drop("parts")), [*GROUP, "part"], "left")
    put = put.withColumn("bundle", F.when(F.col("parts").isNull(), _bundle())).join(F.broadcast(of_bundle), "bundle", "left")
    kept = [c for c in rows.columns if c not in ("h", "tokens")]
    return stored(put.select(*kept, "sub", F.coalesce("large_shard", "bundle_shard").alias("shard")), "placed")


def _numbered(put: DataFrame) -> DataFrame:
    """put with slot in place of sub."""
    counts = put.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))  # at most shards * MOST_SUBS rows
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "sub", before.alias("before"))
    at = F.row_number().over(W.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32"))
    out = put.withColumn("at", at).join(F.broadcast(counts), ["shard", "sub"])
    return out.withColumn("slot", F.col("before") + F.col("at") - 1).drop("sub", "before", "at")


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", tokens: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    with scratch(docs.sparkSession) as keep:
        rows = stored(_measured(docs, text, key, tokens), "sizes")  # the one pass over the texts
        put = keep(_placed(rows, _plan(rows, shards), shards))
    return _numbered(put).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", key: str = "doc_id", tokens: str | None = None) -> None:
    """Write docs as one folder for each shard, each row once with its slot, in the shard's order of sub-buckets.

    The columns `shard` and `slot` are added under free names if docs has such columns. Rows keep their place from plan to
    file, nothing is joined by doc_id: repeated ids and rows without one are each written once.
    """
    shard, slot = free_name("shard", docs.columns), free_name("slot", docs.columns)
    with scratch(docs.sparkSession):
        plan = _plan(stored(_measured(docs, text, key, tokens), "sizes"), shards)
        out = _numbered(_placed(_measured(docs, text, key, tokens, carry=True), plan, shards))
        out.select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)

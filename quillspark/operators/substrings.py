"""Substring search that scans few documents: stored trigrams find the candidates, LIKE decides.

The table at `path` has rows of a trigram (of small letters, 21 bits a character) and the documents of one task's batch that
have it in one of the columns, in folders by a hash of the trigram, and beside it how many documents have each trigram. A pattern's literal runs (what % and _ part) give its
trigrams; the few rarest of them are read, documents that have all of these are candidates, and the same LIKE as in a scan is
asked of them alone. A pattern without a run of three characters is asked of all documents. Null texts have no trigrams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.arrow import bounded_batches

#: Trigrams of a pattern that are looked up; bytes of text for one write task.
RAREST, TASK_BYTES = 4, 16 << 20


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text as they stand, by code points; repeats included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _packed(docs: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """gram, key (array): a row for each distinct trigram of an Arrow batch of documents."""
    bounded_batches(docs.sparkSession, 4000, 4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, np.unique(trigrams(t))) for c in b.columns[1:] for i, t in enumerate(c.to_pylist()) if len(t) > 2]
            if not found:
                continue
            grams, code = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
            pair = np.unique(code * b.num_rows + np.repeat([i for i, _ in found], [len(g) for _, g in found]))
            ends = np.searchsorted(pair, np.arange(len(grams) + 1) * b.num_rows)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(0).take(pa.array(pair % b.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.array(grams), keys], names=["gram", "key"])

    texts = [F.lower(F.coalesce(c, F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)]
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *texts)
    return rows.mapInArrow(run, f"gram long, key array<{rows.schema['key'].dataType.simpleString()}>")


def write_trigrams(docs: DataFrame, path: str, columns: tuple[str, ...] = ("filename", "extracted_text"), key: str = "id") -> None:
    """Write the trigrams of docs at path. Tasks and folders follow the bytes of text; a frequent trigram is spread by key."""
    total = docs.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])).alias("b")).first().b or 0
    tasks = max(1, -(-total // TASK_BYTES))
    salts = math.ceil(math.sqrt(tasks))
    buckets = -(-tasks // salts)
    rows = _packed(docs, columns, key).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    rows = rows.repartition(buckets * salts, "bucket", F.pmod(F.xxhash64(F.col("key")[0]), F.lit(salts))).sortWithinPartitions("bucket", "gram")
    spark = docs.sparkSession
    meta = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(total > 0).alias("texts"))
    if not total:
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        return
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    spark.read.parquet(f"{path}/grams").groupBy("bucket", "gram").agg(F.sum(F.size("key")).alias("n")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def candidates(spark: SparkSession, path: str, text: str, key: str = "id") -> DataFrame | None:
    """The documents that may match; None if the pattern has no trigram."""
    runs = [r for r in re.split("[%_]", text) if len(r) >= 3]
    if not runs:
        return None
    small = spark.range(1).select(F.array(*[F.lower(F.lit(r)) for r in runs]).alias("runs")).first().runs
    asked = spark.createDataFrame([(g,) for g in sorted({g for r in small for g in trigrams(r).tolist()})], "gram long")
    meta = spark.read.parquet(f"{path}/meta").first()
    if not meta.texts:
        return spark.range(0).withColumnRenamed("id", key)
    buckets = meta.buckets
    # As many as the pattern has characters.
    wanted = {r.gram: r.bucket for r in asked.select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")).collect()}
    if not wanted:
        return None
    here = F.col("bucket").isin(list(set(wanted.values()))) & F.col("gram").isin(list(wanted))
    found = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").filter(here).select("gram", "n").collect()}
    rows = spark.read.parquet(f"{path}/grams")
    if len(found) < len(wanted):
        return rows.select(F.explode("key").alias(key)).limit(0)
    rare = sorted(found, key=lambda g: (found[g], g))[:RAREST]
    met = rows.filter(F.col("bucket").isin(list({wanted[g] for g in rare})) & F.col("gram").isin(rare))
    return met.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select(F.col("key").alias(key))


def like_search(docs: DataFrame, text: str, path: str, key: str = "id") -> DataFrame:
    """search.like_search over documents whose trigrams are at path."""
    some = candidates(docs.sparkSession, path, text, key)
    return search.like_search(docs if some is None else docs.join(some, key, "left_semi"), text)

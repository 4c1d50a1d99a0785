"""Shared plumbing: the cluster's shared folder, written intermediate tables, ordered range buckets."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; long texts make the default of 10,000 rows too large for a Python worker.
ARROW_ROWS = 1000
#: Python works on slices of a batch that hold about so many bytes of text.
SLICE_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower (never raise) the session's Arrow batch size to ARROW_ROWS. It stays lowered, since plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


#: Bytes of one Arrow batch where that is bounded.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """As small_batches, and batches end at about ARROW_BYTES too, however few rows that are (a longer row is alone)."""
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = re.match(r"(\d+)b?$", spark.conf.get(key, "64m"))
    if not digits or not 0 < int(digits[1]) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of our own, but only on a local master:
    on a cluster each machine would write to its own disk, so there that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and {master or 'this master'} needs a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return base


#: Paths made inside the innermost scratch() block.
_made: ContextVar[list[str] | None] = ContextVar("quillspark_made", default=None)
_released: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which release() removes, at the driver's end at the latest."""
    own = _own_dir(spark)
    if own not in _released:
        _released.add(own)
        atexit.register(_release_at_exit, spark)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; no result that hasn't been written may be read afterwards."""
    remove_path(spark, _own_dir(spark))


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        if spark.sparkContext._jsc is not None:
            release(spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, the tables that stored() has written inside it, but for those given to what it yields."""
    made, kept = [], set()
    token = _made.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quill_path)
        return df

    try:
        yield keep
    finally:
        _made.reset(token)
        outer = _made.get()
        for path in made:
            if path not in kept:
                remove_path(spark, path)
            elif outer is not None:
                outer.append(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Spark's file system layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends in replicated files, not in executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what stored() wrote for df; nothing may read df afterwards."""
    if path := getattr(df, "_quill_path", None):
        remove_path(df.sparkSession, path)


def free_name(wish: str, taken: Iterable[str]) -> str:
    """A column name like `wish` that none of the others has (Spark's names don't tell cases apart)."""
    have = {c.lower() for c in taken}
    while wish.lower() in have:
        wish += "_"
    return wish


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def with_document(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows whose `id` is a document's; ids of documents are made distinct in each task before they are dealt out."""
    return rows.join(docs.select(F.col(f"`{key}`").cast("long").alias("id")).filter("id is not null").distinct(), "id", "left_semi")


def slices(sizes: Iterable[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about `most`; a larger row is alone."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += n
    if end > start:
        yield start, end


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


#: Bytes of text aimed at in one ordered bucket.
BUCKET_BYTES = 16 << 20


def ordered_buckets(df: DataFrame, key: str, size: Column, bucket_bytes: int = BUCKET_BYTES) -> tuple[Column, int]:
    """A column that numbers range buckets of `key` from 0 in ascending order, and the number of buckets.

    One pass over `key` and the byte sizes finds the boundaries (a quantile sketch, so no row is left out and no
    bucket depends on a sample); only as many numbers as there are buckets reach the driver. Null keys are in bucket
    0. Rows of one key are always in one bucket.
    """
    k = F.col(f"`{key}`").cast("long")
    total = df.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, min(int(-(-(total.b or 0) // bucket_bytes)), total.n or 1, 100_000))
    if n == 1:
        return F.lit(0), 1
    cuts = df.agg(F.percentile_approx(k, [i / n for i in range(1, n)], min(100 * n, 1_000_000)).alias("q")).first().q
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0), 1

    # Tell the bucket of a key with a balanced tree of comparisons: about log2(n) of them for each row.
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(cuts) <= 64:
        return F.when(k.isNull(), 0).otherwise(tree(0, len(cuts))), len(cuts) + 1

    @F.pandas_udf("int")
    def bucket(keys):
        import numpy as np

        return keys.__class__(np.where(keys.isna(), 0, np.searchsorted(cuts, keys.fillna(cuts[0]), side="left")).astype("int32"))

    return bucket(k), len(cuts) + 1

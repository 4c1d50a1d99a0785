"""A stream of uploads: the first of each content wins, across batches, and each batch is registered once.

Each micro-batch is ingested against the register of the batches before it and writes its results to a folder of its number. A
batch that is replayed after a failure reads the same earlier batches and overwrites its own folder, so results and register hold
it once, however often it runs. The state is the register itself: a table that Spark reads by its key columns, not rows that
executors hold, and copies of one content meet no single task (operators.ingest).

Copies in one batch are told in the order of their file names, as in a batch ingest; over batches the earlier batch wins. With
`days`, a content counts as known for so long after it was registered, and is new again after that.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.operators import ingest

FILES = "filename string, content binary, file_size long"
REGISTER = "filename string, doc_id string, file_hash string, registered_at double"


def register_batch(batch: DataFrame, number: int, base: str, now: float, days: float | None = None, day: Column | None = None) -> None:
    """Ingest one batch of files and write its results (with registered_at) to base/batch=<number>, in place of any that are there."""
    spark = batch.sparkSession
    known = earlier(spark, base, number).filter("doc_id is not null")
    if days is not None:
        known = known.filter(F.col("registered_at") > now - days * 86_400)
    known = known.select(F.col("doc_id").alias("id"), "filename", "file_hash")
    ingest.ingest(batch, known, day).withColumn("registered_at", F.lit(now)).write.mode("overwrite").parquet(f"{base}/batch={number}")


def earlier(spark: SparkSession, base: str, number: int) -> DataFrame:
    """What the batches before `number` have written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    paths = [f"{base}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
    return spark.read.schema(REGISTER).parquet(*paths) if paths else spark.createDataFrame([], REGISTER)


def register_stream(files: DataFrame, base: str, checkpoint: str, days: float | None = None, day: Column | None = None, clock=time.time, **trigger) -> StreamingQuery:
    """Start a query that registers each batch below base; trigger: of writeStream.trigger (default: what there is now)."""
    stream = files.writeStream.foreachBatch(lambda batch, number: register_batch(batch, number, base, clock(), days, day)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def registered(spark: SparkSession, base: str, now: float) -> DataFrame:
    """The register: one row for each document of all batches."""
    return ingest.registered(spark.read.parquet(base), now)


def batches(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of tables of files (FILES); per_batch: tables taken at a time."""
    reader = spark.readStream.schema(FILES)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)

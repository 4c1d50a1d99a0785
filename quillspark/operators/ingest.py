"""Ingest: validate, tell duplicates, place, register, in one plan over a batch of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.text import safe_filename
from quillspark.operators import store


def placement(category: Column, name: Column, file_hash: Column, day: Column) -> Column:
    """category/yyyy-mm-dd/12 hex digits_safe name. The digits are those of name and content, so a task that runs again
    writes the same path."""
    unique = F.substring(F.sha2(F.concat_ws("\0", file_hash, name), 256), 1, 12)
    return F.concat_ws("/", category, F.date_format(day, "yyyy-MM-dd"), F.concat(unique, F.lit("_"), safe_filename(name)))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its base when . and .. are followed."""
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("low")),
    )
    return (depth["low"] >= 0) & ~F.startswith(path, F.lit("/"))


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, file_size of the files below a path; a stream of them with readStream has the same columns."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("file_size"))


def ingest(files: DataFrame, known: DataFrame, day: Column | None = None, check_duplicates: bool = True, most: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """One result for each file: success, doc_id, file_hash, file_size, mime_type, category, stored_path, duplicate_of,
    message, error.

    files: filename, file_size and content, or file_hash in its place; known: id, filename, file_hash of the register. A
    file whose content is registered, or is that of an earlier file of the batch (by filename), is a duplicate: a success
    without a new document. Rejected files have the reason as error.
    """
    rows = checked(files, most)
    if check_duplicates:
        # The first of each content is an aggregate with map-side combine; copies never meet in one task.
        first = rows.groupBy("file_hash").agg(F.min(F.when(F.col("v.valid"), F.struct("filename", "own"))).alias("first"), F.count(F.lit(1)).alias("n"))
        there = known.groupBy("file_hash").agg(F.min(F.struct("id", "filename")).alias("there"))
        about = first.join(there, "file_hash", "left")
        rows = store.with_facts(rows, about, "file_hash", "n", "own")
    else:
        rows = rows.withColumns({"first": F.struct("filename", "own"), "there": F.lit(None).cast("struct<id:string,filename:string>")})
    of = F.when(F.col("there").isNotNull(), F.col("there")).when(F.col("first.own") != F.col("own"), F.struct(F.col("first.own").alias("id"), F.col("first.filename").alias("filename")))
    return results(rows.withColumn("of", F.when(F.col("v.valid"), of)), day)


def checked(files: DataFrame, most: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """files without content, with file_hash, v (what the checks say) and own (the id that a new document would have)."""
    hashed = files if "file_hash" in files.columns else files.withColumn("file_hash", F.sha2("content", 256))
    own = F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\0", "filename", "file_hash"), 256), 1, 16))
    return hashed.drop("content").withColumn("v", store.validate_upload(F.col("filename"), F.col("file_size"), most)).withColumn("own", own)


def results(rows: DataFrame, day: Column | None = None) -> DataFrame:
    """The results of checked rows with `of`: struct(id, filename) of the document whose content a file has, or null."""
    day = F.current_date() if day is None else day
    valid = F.col("v.valid")
    new = valid & F.col("of").isNull()
    return rows.select(
        "filename",
        valid.alias("success"),
        F.when(new, F.col("own")).alias("doc_id"),
        F.when(valid, F.col("file_hash")).alias("file_hash"),
        "file_size",
        F.col("v.mime_type").alias("mime_type"),
        F.col("v.category").alias("category"),
        F.when(new, placement(F.col("v.category"), F.col("filename"), F.col("file_hash"), day)).alias("stored_path"),
        F.col("of.id").alias("duplicate_of"),
        F.when(new, F.concat(F.lit("File ingested as document "), "own")).when(valid, "Duplicate file — skipped").alias("message"),
        F.when(~valid, F.col("v.reason")).alias("error"),
    )


def registered(results: DataFrame, now: float) -> DataFrame:
    """The new documents of an ingest as rows of the register, with status uploaded."""
    return results.filter("doc_id is not null").dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("id"), "filename", F.col("stored_path").alias("file_path"), "file_size", "mime_type", "file_hash",
        F.lit("uploaded").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def register(known: DataFrame, uploads: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(new rows of the register, uploads refused as duplicates with existing_id).

    uploads: filename, file_path, file_size, mime_type, file_hash. Of several with one hash the first by filename is new.
    """
    own = F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\0", "filename", "file_hash"), 256), 1, 16))
    rows = uploads.withColumn("own", own)
    # The register's id and the first upload of each content: aggregates with map-side combine. Copies of one content never
    # meet in one task; with_facts tells them by the few contents that are there more than once.
    first = rows.groupBy("file_hash").agg(F.min(F.struct("filename", "file_path", "own")).alias("first"), F.count(F.lit(1)).alias("n"))
    there = known.groupBy("file_hash").agg(F.min("id").alias("existing_id"))
    told = store.with_facts(rows, first.join(there, "file_hash", "left"), "file_hash", "n", "own")
    # Of uploads that are alike in all columns one is new.
    head = F.col("existing_id").isNull() & (F.struct("filename", "file_path", "own") == F.col("first"))
    columns = [c for c in uploads.columns]
    fresh = told.filter(head).groupBy("filename", "file_path", "file_hash", "own").agg(*[F.min(c).alias(c) for c in columns if c not in ("filename", "file_path", "file_hash")], F.count(F.lit(1)).alias("n"))
    new = fresh.select(*columns, F.col("own").alias("id"), F.lit("uploaded").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    again = fresh.filter("n > 1").select(*columns, F.col("own").alias("existing_id"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("i")).drop("i")
    refused = told.filter(~head).select(*columns, F.coalesce("existing_id", "first.own").alias("existing_id"))
    return new, refused.unionByName(again)


def write_files(files: DataFrame, results: DataFrame, base: str) -> None:
    """Write the contents of the new documents below base, one row a document, dealt by category and day. Each call appends: a
    stream that may replay a batch writes below a folder of the batch (streaming.uploads)."""
    new = results.filter("doc_id is not null").select("filename", "doc_id", "stored_path", "file_hash")
    keyed = files.withColumn("file_hash", F.sha2("content", 256))
    rows = keyed.join(new, ["filename", "file_hash"]).dropDuplicates(["doc_id"])
    parts = F.split("stored_path", "/")
    rows.select("doc_id", "stored_path", "content", parts[0].alias("category"), parts[1].alias("day")).write.mode("append").partitionBy("category", "day").parquet(base)

"""File sources and injectable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import extension, file_kind
from quillspark.operators.recovery import retried


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file verbatim, UTF-8 with replacement of bad bytes."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), "content").select("path", F.coalesce("valid", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    ext = extension(F.col("path"))
    return rows.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), ext.alias("extension"), file_kind(ext, 0).alias("category"), file_kind(ext, 1).alias("mime_type"), F.sha2("content", 256).alias("file_hash"))


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new files as binaryFile rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path)


#: bytes -> (text, confidence); what PDF, OCR and speech libraries would do.
Extractor = Callable[[bytes], tuple[str, float]]
RESULT = "path string, category string, text string, confidence double, error string"


def extract(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """One result row for each file; an exception, or a category without an extractor, becomes a failed record."""
    rows = files.select("path", file_kind(extension(F.col("path")), 0).alias("category"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, category, content in frame.itertuples(index=False):
                try:
                    if category not in extractors:
                        out.append((path, category, "", 0.0, f"no extractor for {category}"))
                        continue
                    text, confidence = extractors[category](bytes(content))
                    out.append((path, category, text, confidence, None))
                except Exception as e:  # any library error belongs to the record
                    out.append((path, category, "", 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "category", "text", "confidence", "error"])

    return rows.mapInPandas(run, RESULT)


def infer(docs: DataFrame, model: Callable[[str], str] | None, text: str = "text", key: str = "doc_id", carry: str | None = None, **retry) -> DataFrame:
    """doc_id, answer, error: a model's answer to each text, tried again as recovery.retried does (attempts, base, factor, cap,
    sleep); an empty answer is an error. Without a model a record that says so. carry: a string column that goes along, so
    that answers needn't be joined to their rows again. Pass a model that connects when it is first called."""
    also = [F.col(carry).cast("string").alias(carry)] if carry else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__prompt"), *also)
    if model is None:
        return rows.drop("__prompt").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit("no model available")})
    names = ["doc_id", *([carry] if carry else []), "answer", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, t, *rest in frame.itertuples(index=False):
                try:
                    answer = retried(model, t, **retry)
                    out.append((i, *rest, answer or None, None if answer else "the model gave an empty answer"))
                except Exception as e:  # a failed call is a failed record
                    out.append((i, *rest, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))

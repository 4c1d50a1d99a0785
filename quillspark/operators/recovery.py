"""Recovery: error classes, retries, checkpoints to resume from, the append-only log."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS

#: Statuses that a retry can't change.
PERMANENT = frozenset({400, 401, 403, 404, 405, 406, 422})
#: Operations whose failures are warnings.
MODEL_OPERATIONS = ("ocr", "whisper", "ai")
LOG = "timestamp double, operation string, document_id string, success boolean, attempts int, error string, severity string, details string"
STATE = "document_id string, stage string, data string, created_at double, updated_at double"


class ProcessingError(Exception):
    """An error that the library raises itself."""


class HttpError(Exception):
    def __init__(self, status: int, message: str = "", retry_after: str | None = None):
        super().__init__(message or f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def severity(kind: Column, operation: Column) -> Column:
    """critical for exhausted memory and system errors, error for the library's own; of others warning if the operation is OCR,
    speech or a model. kind: the exception's class name."""
    return F.when(kind.isin("MemoryError", "SystemError"), "critical").when(kind == ProcessingError.__name__, "error").when(operation.isin(*MODEL_OPERATIONS), "warning").otherwise("error")


def skips_document(kind: Column, message: Column) -> Column:
    """Whether an error means that the document can't be processed at all: a missing or locked file, or a corrupt one."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return kind.isin("FileNotFoundError", "PermissionError") | ((kind == ProcessingError.__name__) & (F.contains(low, F.lit("corrupt")) | F.contains(low, F.lit("invalid"))))


def http_message(status: Column, detail: Column, model: Column) -> Column:
    return (
        F.when(status == 401, "Invalid API key.")
        .when(status == 403, "Access denied. Check API permissions.")
        .when(status == 404, F.concat(F.lit("Model '"), model, F.lit("' not found at the API endpoint.")))
        .when(status == 429, "Rate limit exceeded. Try again later.")
        .when((status >= 500) & (status < 600), F.concat(F.lit("Model server error (HTTP "), status.cast("string"), F.lit(").")))
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), detail))
    )


def retried(call: Callable[..., Any], *args: Any, attempts: int = 3, base: float = DEFAULTS.retry_base_s, factor: float = DEFAULTS.retry_factor, cap: float = DEFAULTS.retry_cap_s, sleep: Callable[[float], Any] = time.sleep, **kwargs: Any) -> Any:
    """The call's result, tried again with growing delays; permanent HTTP statuses and the last failure are raised.

    A 429 with a Retry-After in seconds waits that long.
    """
    delay = base
    for attempt in range(1, attempts + 1):
        try:
            return call(*args, **kwargs)
        except Exception as e:
            status = getattr(e, "status", None)
            if attempt == attempts or status in PERMANENT:
                raise
            wait = delay
            if status == 429 and getattr(e, "retry_after", None) is not None:
                try:
                    wait = float(e.retry_after)
                except ValueError:
                    wait = delay
            sleep(wait)
            delay = min(delay * factor, cap)


# --- log --------------------------------------------------------------------------------------------------------------


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries as JSON lines."""
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """All entries, oldest first; lines that aren't JSON of the schema are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy("timestamp")


# --- checkpoints --------------------------------------------------------------------------------------------------------


def save_state(spark: SparkSession, path: str, states: DataFrame) -> None:
    """Append states (document_id, stage, data as JSON text, created_at, updated_at); the newest of a document counts."""
    states.write.mode("append").json(path)


def current_states(saved: DataFrame) -> DataFrame:
    """The newest state of each document, with the time when its first one was made; a state without a stage is a deletion.

    An aggregate with map-side combine, however often a document has been saved.
    """
    latest = saved.filter("document_id is not null").groupBy("document_id").agg(F.max_by(F.struct("stage", "data"), "updated_at").alias("s"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return latest.filter("s.stage is not null").select("document_id", "s.stage", "s.data", "created_at", "updated_at")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """Current states, newest first; damaged lines are skipped."""
    return current_states(spark.read.schema(STATE).option("mode", "DROPMALFORMED").json(path)).orderBy(F.col("updated_at").desc(), "document_id")


def delete_states(spark: SparkSession, path: str, ids: DataFrame, now: float) -> None:
    ids.select("document_id", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("data"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")).write.mode("append").option("ignoreNullFields", "false").json(path)


def unfinished(documents: DataFrame, states: DataFrame, last_stage: str, key: str = "document_id") -> DataFrame:
    """documents that aren't done, with the stage to resume from (null: from the start)."""
    return documents.join(states.select(F.col("document_id").alias(key), "stage", "data"), key, "left").filter(F.coalesce("stage", F.lit("")) != last_stage)


def resume(todo: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Every document through the stages after the one it has reached, set-wise: a stage takes those that are due and the
    others pass by. Each stage keeps the columns. An unknown stage starts anew."""
    names = [n for n, _ in stages]
    for i, (name, run) in enumerate(stages):
        reached = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("stage")), F.lit(0))
        due = run(todo.filter(reached <= i)).withColumn("stage", F.lit(name))
        todo = due.unionByName(todo.filter(reached > i))
    return todo

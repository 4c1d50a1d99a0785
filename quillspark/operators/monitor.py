"""Monitoring: metric snapshots, timings, health, the dashboard; token streams of models."""

from __future__ import annotations

import contextlib
import os
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.text import half_up
from quillspark.operators import operations

METRICS = ["cpu_percent", "ram_percent", "ram_used_gb", "ram_total_gb", "disk_percent", "disk_free_gb", "disk_total_gb"]
SNAPSHOT = "timestamp double, " + ", ".join(f"{m} double" for m in METRICS)
TIMING = "operation string, duration_ms double, timestamp double, document_id string, success boolean"
POINTS = 100


def sample(folder: str = "/") -> dict[str, float]:
    """A snapshot of this machine from /proc and the file system: CPU share since boot, used memory without buffers and cache."""
    with open("/proc/stat") as f:
        ticks = [int(x) for x in f.readline().split()[1:]]
    with open("/proc/meminfo") as f:
        kb = {k: int(v.split()[0]) for k, v in (line.split(":", 1) for line in f)}
    total = max(kb.get("MemTotal", 0), 1)
    used = max(total - kb.get("MemFree", 0) - kb.get("Buffers", 0) - kb.get("Cached", 0), 0)
    disk = os.statvfs(folder)
    size, free = disk.f_frsize * disk.f_blocks, disk.f_frsize * disk.f_bavail
    gb = 1024.0**3
    return {
        "timestamp": time.time(),
        "cpu_percent": round(100 * (1 - ticks[3] / max(sum(ticks), 1)), 1),
        "ram_percent": round(100 * used / total, 1),
        "ram_used_gb": round(used * 1024 / gb, 2),
        "ram_total_gb": round(total * 1024 / gb, 2),
        "disk_percent": round(100 * (size - free) / size, 1) if size else 0.0,
        "disk_free_gb": round(free / gb, 2),
        "disk_total_gb": round(size / gb, 2),
    }


def snapshots(spark: SparkSession, samples: list[dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([tuple(float(s[c]) for c in ("timestamp", *METRICS)) for s in samples], SNAPSHOT)


def metric_history(history: DataFrame, limit: int = POINTS, kept: int = DEFAULTS.history_size, metrics: list[str] = METRICS, key: str | None = None) -> DataFrame:
    """(metric, timestamp, value): the newest `limit` of the kept snapshots as points of each metric.

    Only the newest rows are unpivoted: a top-k over snapshots, no window over all of them.
    """
    order = [F.col("timestamp").desc(), *([F.col(key)] if key else [])]
    newest = history.orderBy(*order).limit(min(limit, kept))
    return newest.unpivot(["timestamp"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


@contextlib.contextmanager
def measured(records: list[tuple], operation: str, document_id: str | None = None) -> Iterator[None]:
    """Appends a timing of the block to records; an exception is recorded as no success and goes on."""
    began, ok = time.perf_counter(), True
    try:
        yield
    except BaseException:
        ok = False
        raise
    finally:
        records.append((operation, round((time.perf_counter() - began) * 1000, 2), time.time(), document_id, ok))


def timings(spark: SparkSession, records: list[tuple]) -> DataFrame:
    return spark.createDataFrame(records, TIMING)


def retained(timing: DataFrame, n: int = DEFAULTS.history_size, *order: Column) -> DataFrame:
    """The newest n records of each operation."""
    return operations.newest(timing, "operation", n, *(order or (F.col("timestamp").desc(),)))


def uptime(history: DataFrame, started: Column, now: Column) -> DataFrame:
    """One row: uptime_seconds (2 digits) since `started`, collection_count of the snapshots since then, system_available."""
    since = F.count_if(F.col("timestamp") >= started)
    return history.agg(since.alias("collection_count")).select(half_up((now - started).cast("double"), 2).alias("uptime_seconds"), "collection_count", (F.col("collection_count") > 0).alias("system_available"))


def dashboard(timing: DataFrame, history: DataFrame | None = None, cache: DataFrame | None = None, points: int = POINTS, kept: int = DEFAULTS.history_size, *order: Column, started: Column | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """The dashboard's frames: averages and counts of each operation, its newest points, the latest snapshot and the points of
    each metric, with `started` (seconds, as is now: by default this moment) the uptime, the cache's statistics
    (operators.cache.snapshot)."""
    rows = retained(timing, kept, *order)
    out = {
        "operations": rows.groupBy("operation").agg(half_up(F.avg("duration_ms"), 2).alias("avg_ms"), F.count(F.lit(1)).alias("n")),
        "recent_timings": rows.filter(F.col("rn") <= points).select("operation", "timestamp", F.col("duration_ms").alias("value")),
    }
    if history is not None:
        if started is not None:
            out["uptime"] = uptime(history, started, F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now)
        out |= {"system": history.orderBy(F.col("timestamp").desc()).limit(1), "system_history": metric_history(history, points, kept)}
    return out | ({"cache": cache} if cache is not None else {})


def health(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """One row: all_passed, and a summary "passed/all checks passed"; no checks count as passed."""
    n, ok = F.count(F.lit(1)), F.count_if(F.coalesce(F.col(passed), F.lit(False)))
    return checks.agg((n == ok).alias("all_passed"), F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" checks passed")).alias("summary"))


# --- token streams --------------------------------------------------------------------------------------------------


def stream_tokens(lines: DataFrame, key: str = "stream", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, order, token) of streamed NDJSON answers: empty and bad lines are skipped, lines after the first that says
    done too; the token is `response` or the message's content."""
    v = F.try_parse_json(line)
    token = F.coalesce(F.try_variant_get(v, "$.response", "string"), F.try_variant_get(v, "$.message.content", "string"), F.lit(""))
    rows = lines.withColumns({"__ok": v.isNotNull(), "token": token, "__done": F.coalesce(F.try_variant_get(v, "$.done", "boolean"), F.lit(False))}).filter("__ok")
    # Where a stream ends is one number a stream, so a long stream needn't be sorted in one task to cut it.
    end = rows.filter("__done").groupBy(key).agg(F.min(order).alias("__end"))
    cut = rows.join(end, key, "left").filter(F.col("__end").isNull() | (F.col(order) <= F.col("__end")))
    return cut.filter("token <> ''").select(key, order, "token")


def collected(tokens: DataFrame, key: str = "stream", order: str = "line_no", token: str = "token") -> DataFrame:
    """(key, text, tokens_out): a stream's tokens joined in order, and the words of the text.

    An answer is one string of one row; models bound its length.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token]), "")
    rows = tokens.groupBy(key).agg(text.alias("text"))
    return rows.withColumn("tokens_out", F.regexp_count("text", F.lit(r"(?U)\S+")).cast("long"))

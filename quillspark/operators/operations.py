"""Operational analytics: bounded histories, caches, retention, logs, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.config import DEFAULTS
from quillspark.functions.text import half_up
from quillspark.operators import ordered


def newest(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The newest n rows of each key; Spark filters ranks before the shuffle where it can."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def beyond_newest(df: DataFrame, key: str, n: int, *recency: Column) -> DataFrame:
    """The rows that retention removes: all but the newest n of each key. recency: ascending expressions, the last of which
    tells the rows of a key apart."""
    return ordered.beyond(df, key, n, list(recency))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key by the order columns, the last of which is unique: an aggregate, nothing is sorted."""
    kept = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("e")).select(key, "e.*")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rolling_timings(timings: DataFrame, key: str, value: str, n: int, *order: Column) -> DataFrame:
    """Mean (2 digits) and count of the newest n records of each key."""
    kept = newest(timings, key, n, *order)
    return kept.groupBy(key).agg(half_up(F.avg(value), 2).alias("avg_ms"), F.count(F.lit(1)).alias("n"))


def evict_lru(entries: DataFrame, size: str, budget: Column, *order: Column, ranges: int | None = None) -> DataFrame:
    """Entries to drop, least recently used first, until the rest fits the budget, with `before` and `total`. order: ascending
    expressions, nulls first; the running sum goes over ranges of it, whatever its columns hold."""
    rows = ordered.running_sum(entries, size, list(order), ranges=ranges)
    return rows.filter(F.col("total") - F.col("before") > budget)


def expired(entries: DataFrame, now: float) -> DataFrame:
    return entries.filter(F.col("expires_at") < now)


def cache_stats(entries: DataFrame, now: float, budget_mb: float = DEFAULTS.cache_budget_mb) -> DataFrame:
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return entries.agg(F.count(F.lit(1)).alias("entries"), size.cast("long").alias("bytes"), half_up(size / 1048576.0, 2).alias("mb"), (size > budget_mb * 1048576).alias("is_full"), F.count_if(F.col("expires_at") < now).alias("expired"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    return half_up(F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0)), 4)


def log_query(log: DataFrame, operation: str | None = None, severity: str | None = None, document_id=None, since=None, until=None, limit: int = 100, order: str = "timestamp") -> DataFrame:
    """Matching rows, oldest first; limit 0 means all."""
    tests = [operation and F.col("operation") == operation, severity and F.col("severity") == severity, None if document_id is None else F.col("document_id") == document_id, None if since is None else F.col("timestamp") >= since, None if until is None else F.col("timestamp") <= until]
    for t in tests:
        if isinstance(t, Column):
            log = log.filter(t)
    log = log.orderBy("timestamp", order)
    return log.limit(limit) if limit else log


def log_tail(log: DataFrame, n: int, *order: Column) -> DataFrame:
    return log.orderBy(*order).limit(n)


def backoff_delay(attempt: Column, base: float = DEFAULTS.retry_base_s, factor: float = DEFAULTS.retry_factor, cap: float = DEFAULTS.retry_cap_s) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(cap))


def transitions(events: DataFrame, key: str, status: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """events with status_from: the status of the event before it, among those of its key."""
    return ordered.previous(events, key, status, list(order), "status_from", ranges)


def assembled(rows: DataFrame, key: str, order: str, text: str, sep: str = " ") -> DataFrame:
    """Texts of a key joined in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep).alias("text"))


def chat_history(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", system: Column | None = None) -> DataFrame:
    """(key, messages): an array of struct(role, content), the system message first if there is one, then the turns in order.

    system: the system prompt (null or empty: none), an expression over the key. A conversation is one row, as models take it.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(role).alias("role"), F.col(text).alias("content"))))
    out = rows.groupBy(key).agg(F.transform(turns, lambda x: F.struct(x["role"], x["content"])).alias("messages"))
    if system is None:
        return out
    first = F.when(F.coalesce(system, F.lit("")) != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))))
    return out.withColumn("messages", F.concat(F.coalesce(first, F.slice("messages", 1, 0)), "messages"))


def ocr_page(words: Column) -> Column:
    """struct(text, confidence) of an array of struct(text, conf): words with conf > 0 that aren't blank."""
    kept = F.filter(words, lambda w: (w["conf"] > 0) & (F.trim(w["text"]) != ""))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, w: a + w["conf"]) / F.size(kept) / 100
    return F.struct(F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("text"), F.least(F.greatest(F.coalesce(F.when(F.size(kept) > 0, mean), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def transcript_confidence(mean_logprob: Column, language: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.exp(mean_logprob), language, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

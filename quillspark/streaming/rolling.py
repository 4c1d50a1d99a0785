"""Streaming forms of the monitor: a sampler and per-operation means over the last N events."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.operators import monitor


def sampler(spark: SparkSession, seconds: int = 5) -> DataFrame:
    """A row every `seconds` with a sequence number, for metric snapshots."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)


def metric_stream(spark: SparkSession, seconds: int = 5) -> DataFrame:
    """A stream of metric snapshots, one every `seconds`, of the machine that takes the sample."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame([monitor.sample()] * len(f))[["timestamp", *monitor.METRICS]].astype(float)

    return sampler(spark, seconds).select("value").mapInPandas(take, monitor.SNAPSHOT)


def rolling_means(events: DataFrame, key: str = "operation", value: str = "duration_ms", order: str = "timestamp", n: int = DEFAULTS.history_size) -> DataFrame:
    """For each key with new events: mean and count of its newest n. State is n values a key, however many events come, kept by
    a heap of n; late events count if they are among the newest n, and change nothing else."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            kept = heapq.nlargest(n, chain(kept, zip(f[order].tolist(), f[value].tolist(), strict=True)))
        state.update(([a for a, _ in kept], [b for _, b in kept]))
        yield pd.DataFrame({key: [k[0]], "avg_ms": [sum(b for _, b in kept) / len(kept)], "n": [len(kept)]})

    return events.select(key, F.col(order).cast("double").alias(order), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"{key} string, avg_ms double, n long", "at array<double>, v array<double>", "update", "NoTimeout")


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark: an extension of ours."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")

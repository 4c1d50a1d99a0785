"""The typed result cache as a table: put, get, exists, delete, expire, evict, statistics; caches by content hash.

A cache is a DataFrame of (entry_type, cache_key, value, content_type, created_at, expires_at, size_bytes, access_count,
last_accessed); times are epoch seconds. Every operator takes a cache and gives a result or the cache as it is afterwards; the
caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.structure import canonical_json
from quillspark.operators import operations

COLUMNS = "entry_type string, cache_key string, value string, content_type string, created_at double, expires_at double, size_bytes long, access_count long, last_accessed double"
KEY = ["entry_type", "cache_key"]
#: Seconds that results of extraction stay: OCR pages, transcripts.
OCR_TTL_S, TRANSCRIPT_TTL_S = 3600.0, 30 * 86400.0


def entries(values: DataFrame, now: Column | float, ttl: float = DEFAULTS.cache_ttl_s, value: str = "value", key: str | None = None) -> DataFrame:
    """Cache entries of (entry_type, value as JSON text); the key is that of the canonical value where none is given."""
    now = F.lit(now).cast("double") if not isinstance(now, Column) else now
    raw = canonical_json(F.col(value))
    rows = values.withColumn("__raw", raw)
    own = F.sha2("__raw", 256)
    return rows.select(
        "entry_type",
        (F.coalesce(F.col(key), own) if key else own).alias("cache_key"),
        F.col("__raw").alias("value"),
        F.lit("application/json").alias("content_type"),
        now.alias("created_at"),
        (now + ttl).alias("expires_at"),
        F.octet_length("__raw").cast("long").alias("size_bytes"),
        F.lit(0).cast("long").alias("access_count"),
        F.lit(None).cast("double").alias("last_accessed"),
    )


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of those of equal type and key: an aggregate, so a hot key is combined early."""
    columns = [c for c in cache.columns if c not in KEY]
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = both.groupBy(*KEY).agg(F.max_by(F.struct(*columns), F.struct("__new", "created_at", "value")).alias("e"))
    return latest.select(*KEY, "e.*").select(*cache.columns)


def is_live(now: float) -> Column:
    """Not expired: no expiry, or one that isn't past."""
    return F.col("expires_at").isNull() | (F.col("expires_at") >= now)


def readable(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("")), F.lit(False))


def lookup(cache: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """(entry_type, cache_key, outcome, value) for each different wanted key: hit, miss, expired or corrupt.

    Only a hit has a value. Wanted keys may repeat; they are counted in `times`.
    """
    asked = wanted.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"))
    found = asked.join(cache.select(*KEY, "value", "expires_at", F.lit(True).alias("__there")), KEY, "left")
    outcome = F.when(F.col("__there").isNull(), "miss").when(~is_live(now), "expired").when(~readable(F.col("value")), "corrupt").otherwise("hit")
    return found.select(*KEY, "times", outcome.alias("outcome"), F.when(outcome == "hit", F.col("value")).alias("value"))


def after_lookup(cache: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """The cache after wanted keys have been read in turn: expired and corrupt ones are gone, hits counted and dated."""
    seen = lookup(cache, wanted, now).select(*KEY, "times", "outcome")
    rows = cache.join(seen, KEY, "left").filter(F.coalesce("outcome", F.lit("")).isin("", "hit"))
    hit = F.col("outcome") == "hit"
    rows = rows.withColumns({"access_count": F.when(hit, F.col("access_count") + F.col("times")).otherwise(F.col("access_count")), "last_accessed": F.when(hit, F.lit(now).cast("double")).otherwise(F.col("last_accessed"))})
    return rows.select(*cache.columns)


def tally(seen: DataFrame) -> DataFrame:
    """hits, misses, hit_ratio of a lookup: a corrupt entry is found once and then missing, an expired one missing."""
    hits = F.sum(F.when(F.col("outcome") == "hit", F.col("times")).when(F.col("outcome") == "corrupt", 1).otherwise(0))
    counted = seen.agg(F.coalesce(hits, F.lit(0)).cast("long").alias("hits"), F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("n"))
    return counted.select("hits", (F.col("n") - F.col("hits")).alias("misses")).select("hits", "misses", operations.hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"))


def exists(cache: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """The wanted keys that a live entry has."""
    return wanted.join(cache.filter(is_live(now)).select(*KEY), KEY, "left_semi")


def duplicates(cache: DataFrame, values: DataFrame, now: float, value: str = "value") -> DataFrame:
    """The rows of values whose content is cached already under their type."""
    keyed = values.withColumn("cache_key", F.sha2(canonical_json(F.col(value)), 256))
    return keyed.join(cache.filter(is_live(now)).select(*KEY), KEY, "left_semi").drop("cache_key")


def delete(cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the cache without the keys, one row with the number of entries deleted)"""
    gone = cache.join(keys.select(*KEY), KEY, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return cache.join(keys.select(*KEY), KEY, "left_anti").select(*cache.columns), gone


def delete_values(cache: DataFrame, values: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    return delete(cache, values.select("entry_type", F.sha2(canonical_json(F.col(value)), 256).alias("cache_key")))


def clear(cache: DataFrame, entry_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number deleted): all entries, or those of one type."""
    mine = F.lit(True) if entry_type is None else F.col("entry_type") == entry_type
    return cache.filter(~mine), cache.filter(mine).agg(F.count(F.lit(1)).alias("deleted"))


def clear_expired(cache: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(the live entries, one row with the number deleted); an entry that expires right now stays."""
    return cache.filter(is_live(now)), cache.filter(~is_live(now)).agg(F.count(F.lit(1)).alias("deleted"))


def cleanup(cache: DataFrame, now: float, budget_mb: float = DEFAULTS.cache_budget_mb) -> DataFrame:
    """The cache after expired entries and then, while it is over budget, the least recently used ones have gone."""
    live = cache.filter(is_live(now))
    order = [F.col("last_accessed"), F.col("access_count"), F.col("entry_type"), F.col("cache_key")]
    gone = operations.evict_lru(live, "size_bytes", F.lit(int(budget_mb * 1024 * 1024)), *order)
    return live.join(gone.select(*KEY), KEY, "left_anti").select(*cache.columns)


def snapshot(cache: DataFrame, now: float, seen: DataFrame | None = None, budget_mb: float = DEFAULTS.cache_budget_mb) -> DataFrame:
    """One row: entries, bytes, mb, is_full, expired, by_type (map), hits, misses, hit_ratio."""
    parts = cache.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"), F.count_if(~is_live(now)).alias("x"))
    size = F.coalesce(F.sum("b"), F.lit(0))
    stats = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        size.cast("long").alias("bytes"),
        operations.half_up(size / 1048576.0, 2).alias("mb"),
        (size >= budget_mb * 1048576).alias("is_full"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("expired"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry_type", "n")))).alias("by_type"),
    )
    counted = tally(seen) if seen is not None else cache.sparkSession.range(1).select(F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"), F.lit(0.0).alias("hit_ratio"))
    return stats.crossJoin(F.broadcast(counted))  # one row each


def cached_results(files: DataFrame, cache: DataFrame, entry_type: str, now: float, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(files with the value cached for their content's SHA-256, files that have none and must be worked on).

    Expired entries and those that can't be read count as none.
    """
    live = cache.filter((F.col("entry_type") == entry_type) & is_live(now) & readable(F.col("value"))).select(F.col("cache_key").alias("content_hash"), "value")
    keyed = files.withColumn("content_hash", F.sha2(F.col(content), 256))
    return keyed.join(live, "content_hash"), keyed.join(live.select("content_hash"), "content_hash", "left_anti")

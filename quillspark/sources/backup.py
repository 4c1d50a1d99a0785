"""Table backups: timestamped copies of a table's folder with checksums; list, verify, restore, prune; atomic replacement."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 10


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of a folder's files: each is hashed where it is read, only digests are combined."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", r"^.*/", "")
    each = files.filter(~F.startswith(name, F.lit("_"))).select(F.sha2(F.concat(name, F.lit(":"), F.sha2("content", 256)), 256).alias("h"))
    # A sum of 60-bit parts of the digests doesn't depend on order and combines map-side.
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)) for i in (1, 16, 31, 46)]
    return each.agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts], F.count(F.lit(1)).cast("string")), 256).alias("s")).first().s


def create(spark: SparkSession, table: str, backups: str, keep: int = KEEP, now: datetime.datetime | None = None) -> str:
    """Copy the table at a path to a new backup; the path of the backup. Older ones beyond `keep` are removed.

    The checksum is part of the name, so a backup that was copied in part has none and is no backup.
    """
    stamp = (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S_%f")
    work = f"{backups}/_making-{uuid.uuid4().hex}"
    spark.read.parquet(table).write.parquet(work)
    path = f"{backups}/{stamp}-{checksum(spark, work)}.backup"
    src, fs = _fs(spark, work)
    fs.rename(src, _fs(spark, path)[0])
    prune(spark, backups, keep)
    return path


def listed(spark: SparkSession, backups: str) -> list[dict]:
    """Backups, newest first: path, created (stamp), checksum, size_bytes."""
    at, fs = _fs(spark, backups)
    if not fs.exists(at):
        return []
    found = []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if s.isDirectory() and name.endswith(".backup") and "-" in name:
            stamp, _, digest = name.removesuffix(".backup").partition("-")
            found.append({"path": s.getPath().toString(), "created": stamp, "checksum": digest, "size_bytes": fs.getContentSummary(s.getPath()).getLength()})
    return sorted(found, key=lambda b: b["created"], reverse=True)


def verify(spark: SparkSession, path: str) -> bool:
    """Whether a backup still has the content that its name says."""
    return exists(spark, path) and checksum(spark, path) == path.rsplit("-", 1)[-1].removesuffix(".backup")


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write rows in place of the table at path. Readers never see a part of a table, but between the two renames none is
    there. rows may come from the table itself."""
    at, fs = _fs(spark, path)
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        rows.write.parquet(new)
        if fs.exists(at):
            fs.rename(at, _fs(spark, old)[0])
        fs.rename(_fs(spark, new)[0], at)
    except BaseException:
        if not fs.exists(at) and exists(spark, old):
            fs.rename(_fs(spark, old)[0], at)
        fs.delete(_fs(spark, new)[0], True)
        raise
    fs.delete(_fs(spark, old)[0], True)


def restore(spark: SparkSession, backup: str, table: str) -> bool:
    """Put a backup in the table's place; False, and the table as it was, if there is no such backup or it is damaged."""
    if not verify(spark, backup):
        return False
    replace(spark, spark.read.parquet(backup), table)
    return True


def prune(spark: SparkSession, backups: str, keep: int = KEEP) -> int:
    """Remove all but the newest `keep` backups; the number removed."""
    gone = listed(spark, backups)[keep:]
    for b in gone:
        at, fs = _fs(spark, b["path"])
        fs.delete(at, True)
    return len(gone)

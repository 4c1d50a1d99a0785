"""Document store operators: ingest checks, duplicates, upserts, deletes, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.text import extension, file_kind

#: The statuses of a document.
STATUSES = ["pending", "uploaded", "extracting", "extracted", "preprocessing", "preprocessed", "ai_inferring", "ai_completed", "validating", "validated", "stored", "failed", "duplicate", "cancelled"]


def validate_upload(name: Column, size: Column, most: int = DEFAULTS.max_upload_bytes) -> Column:
    """struct(valid, reason, extension, category, mime_type)"""
    ext = extension(name)
    category = file_kind(ext, 0)
    reason = F.when(ext == "", "no extension").when(category == "unknown", "extension not allowed").when(size > most, "too large")
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), ext.alias("extension"), category.alias("category"), file_kind(ext, 1).alias("mime_type"))


def first_ids(df: DataFrame, content: Column, key: str = "id") -> DataFrame:
    """(file_hash, key): the smallest key of each content; an aggregate with map-side combine, so copies never meet in one task."""
    return df.groupBy(content.alias("file_hash")).agg(F.min(key).alias(key))


def new_only(arrivals: DataFrame, known: DataFrame, key: str = "file_hash") -> DataFrame:
    return arrivals.join(known.select(key), key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Changes win over rows of equal key if their version is as high; of changes with one key and version the largest row.

    An aggregate with map-side combine, so the rows of a hot key never meet in one task.
    """
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new", *rest)).alias("__row"))
    return latest.select(*keys, "__row.*").select(*table.columns)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The first row with a key's value, none if there isn't any; the filter reaches the scan."""
    return table.filter(F.col(key) == value).limit(1)


def insert(table: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """The table with new rows; a row whose unique columns exist already, in the table or twice among the new, is an error."""
    clash = rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*unique)
    known = rows.select(*unique).join(table.select(*unique), unique, "left_semi")
    found = clash.unionByName(known).limit(1).collect()
    if found:
        raise ValueError(f"not unique: {found[0].asDict()}")
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, key: str, value, now: float, **columns) -> DataFrame:
    """Columns of one row set anew, unknown ones ignored, updated_at always bumped; a missing id changes nothing."""
    hit = F.col(key) == value
    sets = {c: F.when(hit, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in {**columns, "updated_at": now}.items() if c in table.columns}
    return table.withColumns(sets)


def updated(table: DataFrame, key: str, value, now: float, **columns) -> tuple[DataFrame, DataFrame]:
    """(the table after update, the row as it is then: none if the id is missing)"""
    after = update(table, key, value, now, **columns)
    return after, lookup(after, key, value)


def delete(table: DataFrame, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number deleted): rows that satisfy the condition go, without one all do."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return table.filter(~hit), table.filter(hit).agg(F.count(F.lit(1)).alias("deleted"))


def children(parents: DataFrame, table: DataFrame, *order: str, key: str = "id", foreign: str = "document_id") -> DataFrame:
    """A parent's rows of a child table in order: its chunks by index, its history by time."""
    rows = table.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")
    return rows.orderBy(foreign, *order)


def record(table: DataFrame) -> DataFrame:
    """Rows as records: null texts are "", null numbers 0, a status that isn't known is failed."""
    out = {}
    for f in table.schema.fields:
        kind = f.dataType.simpleString()
        if f.name == "status":
            out[f.name] = known_status(F.col("status"))
        elif kind == "string":
            out[f.name] = F.coalesce(F.col(f.name), F.lit(""))
        elif kind in ("double", "bigint", "int"):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(kind))
    return table.withColumns(out)


def delete_with_artifacts(gone: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the documents of `gone` (column id): keys says by which column each table knows them."""
    return {name: t.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, t in tables.items()}


def delete_documents(gone: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str], index_path: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(delete_with_artifacts, the paths of the stored files that go with the documents). gone: id, and file_path where files
    are stored. With index_path the documents leave the stored index too, at once; tables and files are the caller's to write
    and remove."""
    if index_path:
        from quillspark.operators import index

        index.delete_documents(gone.select("id"), index_path)
    paths = gone.select("file_path").filter("file_path is not null").distinct() if "file_path" in gone.columns else gone.select(F.lit(None).cast("string").alias("file_path")).limit(0)
    return delete_with_artifacts(gone, tables, keys), paths


def transaction(spark, changes: dict[str, DataFrame]) -> None:
    """Replace several tables (path -> rows), one after the other. All are staged first; if staging fails none changes, but
    a failure between two replacements leaves the first replaced."""
    from quillspark.sources import backup

    staged = {}
    try:
        for path, rows in changes.items():
            staged[path] = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
            rows.write.parquet(staged[path])
        for path, at in staged.items():
            backup.replace(spark, spark.read.parquet(at), path)
    finally:
        for at in staged.values():
            backup.remove(spark, at)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str = "id", foreign: str = "document_id") -> tuple[DataFrame, DataFrame]:
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, key: str = "id", foreign: str = "document_id") -> DataFrame:
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def known_status(status: Column) -> Column:
    return F.when(status.isin(STATUSES), status).otherwise("failed")


#: Rows of one key from which on the key's facts are broadcast and its rows aren't shuffled.
HOT_ROWS = 1_000_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """rows left-joined to facts (one row a key, with the number of rows that have it in `count`).

    Keys of more than HOT_ROWS rows are at most one for each HOT_ROWS rows: their facts are broadcast, and in the shuffled join
    of the others their rows go wherever a hash of `spread` says, so no task gets a hot key's rows.
    """
    names = [c for c in facts.columns if c not in (key, count)]
    hot = facts.filter(F.col(count) > HOT_ROWS).select(F.col(key).alias("__hot"), F.struct(*names).alias("__of_hot"))
    cold = facts.filter(F.col(count) <= HOT_ROWS).select(F.col(key).cast("string").alias("__cold"), F.struct(*names).alias("__of_cold"))
    told = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    told = told.withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\0"), F.sha2(F.col(spread).cast("string"), 256))))
    told = told.join(cold, F.col("__at") == F.col("__cold"), "left")
    of = F.coalesce("__of_hot", "__of_cold")
    return told.select(*rows.columns, *[of[n].alias(n) for n in names])


def with_chunk_counts(docs: DataFrame, chunks: DataFrame, key: str = "id", foreign: str = "document_id") -> DataFrame:
    counts = chunks.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias("chunks_count"))
    return docs.join(counts, key, "left").fillna(0, ["chunks_count"])


def status_counts(docs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return docs.agg(F.count(F.lit(1)).alias("total"), n("stored").alias("stored"), n("failed").alias("failed"), (F.count(F.lit(1)) - n("stored") - n("failed")).alias("pending"))

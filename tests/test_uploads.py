"""The stream of uploads against the batch ingest: copies within and across batches, replays, bad files, expiry."""

from pyspark.sql import functions as F

from quillspark.operators import ingest
from quillspark.streaming import uploads

DAY = "2024-05-01"
BATCHES = [
    [("a1.txt", b"one"), ("a2.txt", b"two"), ("a3.txt", b"one"), ("a4.exe", b"one")],
    [("b1.txt", b"two"), ("b2.txt", b"three"), ("b3.txt", b"")],
    [("c1.txt", b"one"), ("c2.txt", b"three"), ("c3.txt", b"four"), ("c4.txt", b"four")],
]


def rows(df):
    return sorted(tuple(r) for r in df.drop("batch", "registered_at").collect())


def drop(spark, path, number):
    df = spark.createDataFrame([(n, c, len(c)) for n, c in BATCHES[number]], uploads.FILES)
    df.coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_ingest_and_replays_change_nothing(spark, tmp_path):
    src, base, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    known = spark.createDataFrame([], "id string, filename string, file_hash string")
    for number in range(3):
        drop(spark, src, number)
        uploads.register_stream(uploads.batches(spark, src), base, check, day=F.lit(DAY).cast("date")).awaitTermination()
        files = spark.createDataFrame([(n, c, len(c)) for b in BATCHES[: number + 1] for n, c in b], uploads.FILES)
        assert rows(spark.read.parquet(base)) == rows(ingest.ingest(files, known, F.lit(DAY).cast("date")))
    names = {r.filename for r in uploads.registered(spark, base, 1.0).collect()}
    assert {"a1.txt", "a2.txt", "b2.txt", "c3.txt"} <= names and "c1.txt" not in names
    before = rows(spark.read.parquet(base))
    # The last batch's end was lost: it runs again, and overwrites its own folder.
    for mark in (tmp_path / "check/commits").iterdir():
        if mark.name.strip(".").startswith("2"):
            mark.unlink()
    uploads.register_stream(uploads.batches(spark, src), base, check, day=F.lit(DAY).cast("date")).awaitTermination()
    assert rows(spark.read.parquet(base)) == before
    uploads.register_batch(spark.createDataFrame([(n, c, len(c)) for n, c in BATCHES[1]], uploads.FILES), 1, base, 5.0, day=F.lit(DAY).cast("date"))
    assert rows(spark.read.parquet(base)) == before


def test_an_expired_content_is_new_again(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("a1.txt", b"one", 3)], uploads.FILES)
    for number, now in enumerate((0.0, 80_000.0, 90_000.0)):
        uploads.register_batch(df, number, base, now, days=1.0)
    assert sorted(r.batch for r in spark.read.parquet(base).filter("doc_id is not null").collect()) == [0, 2]


def test_copies_of_register_calls(spark):
    ups = spark.createDataFrame([("b", "p1", 1, "m", "h"), ("a", "p2", 1, "m", "h"), ("a", "p2", 1, "m", "h"), ("c", "p3", 1, "m", "k"), ("d", "p4", 1, "m", "g")], "filename string, file_path string, file_size long, mime_type string, file_hash string")
    known = spark.createDataFrame([("doc", "x", "k")], "id string, filename string, file_hash string")
    new, refused = ingest.register(known, ups, 1.0)
    assert sorted(r.filename for r in new.collect()) == ["a", "d"]
    own = {r.filename: r.id for r in new.collect()}
    assert sorted((r.filename, r.existing_id) for r in refused.collect()) == [("a", own["a"]), ("b", own["a"]), ("c", "doc")]

"""Labels of sizes beyond the small tables', as SQL has them."""

import duckdb
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.plans import catalogue, lifecycle  # noqa: F401


def test_label_texts_of_long_documents_equal_sql(spark, tmp_path):
    sizes = [0, 1, 320, 8191, 99_999, 103_219, 103_220, 128_657, 1_900_000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(catalogue.ORACLES["label_texts"]).fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in catalogue.QUERIES["label_texts"](spark, str(tmp_path)).collect()} == want


def test_the_last_unit_takes_what_is_larger(spark):
    row = spark.range(1).select(text.size_label_all_units(F.lit(2.0**51)).alias("pb"), text.size_label_all_units(F.lit(2.0**51), "TB").alias("tb")).first()
    assert tuple(row) == ("2.0 PB", "2048.0 TB")

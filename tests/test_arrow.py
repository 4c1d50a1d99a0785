"""Python in tasks gets bounded batches."""

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text


def test_normalising_bounds_the_batches(spark):
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    text.normalize_unicode(F.col("x"))

    @F.pandas_udf("long")
    def size(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    assert spark.range(0, 5000, 1, 1).select(size(F.col("id")).alias("n")).agg(F.max("n")).first()[0] <= 1000

"""Arrow batches of bounded size for Python in tasks."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch.
ROWS, BYTES = 4000, 16 << 20


def bounded_batches(spark: SparkSession, most_rows: int = ROWS, most_bytes: int = BYTES) -> None:
    """Lower (never raise) the session's bounds of Arrow batches to so many rows and about so many bytes (a longer row is
    alone). They stay lowered, since plans read them when they run."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= most_rows:
        spark.conf.set(rows, most_rows)
    digits = re.match(r"(\d+)b?$", spark.conf.get(size, "64m"))
    if not digits or not 0 < int(digits[1]) <= most_bytes:
        spark.conf.set(size, str(most_bytes))

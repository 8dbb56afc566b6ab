"""Bounds on the batches that Spark hands to Python."""

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def arrow_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> None:
    """Arrow batches end at ``most_bytes`` or ``rows``, whichever comes first, so that long texts can't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

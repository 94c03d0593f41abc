"""How much a Python worker gets at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers by their bytes, so that long texts don't add up to a large batch.

    A lower limit that the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))

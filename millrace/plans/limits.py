"""How much data may be held by every task at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

MODEL_BYTES_KEY = "spark.millrace.maxModelBytes"
DEFAULT_MODEL_BYTES = 64 * 1024 * 1024


def model_budget(spark: SparkSession) -> int:
    """Largest center matrix, in bytes, that is shipped to every task as a whole."""
    return int(spark.conf.get(MODEL_BYTES_KEY, str(DEFAULT_MODEL_BYTES)))

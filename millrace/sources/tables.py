"""Relational inputs by path or connection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, path: str | None = None, jdbc: Mapping[str, str] | None = None
) -> DataFrame:
    """A parquet table, or one behind JDBC (``url``, ``dbtable``, and for a parallel read
    ``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``)."""
    if (path is None) == (jdbc is None):
        raise ValueError("give either a path or JDBC options")
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()

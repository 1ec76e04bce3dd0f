"""Row-local steps on file streams.

Parsing, nearest-center search and click-log preparation with known statistics keep no state, so
the same functions serve streaming frames. Only the readers differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.clicklog import parse_clicklog
from millrace.sources.dense import parse_points


def points_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.readStream.text(path))


def clicklog_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_clicklog(spark.readStream.text(path))

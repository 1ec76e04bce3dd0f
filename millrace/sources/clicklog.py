"""Tab-separated click log: label, 13 integers, 26 categories; empty means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of the public click-log data set.
NUM_INTEGERS = 13
NUM_CATEGORIES = 26

LABEL = "label"
INT_COLS = [f"i{j}" for j in range(1, NUM_INTEGERS + 1)]
CAT_COLS = [f"c{j}" for j in range(1, NUM_CATEGORIES + 1)]


def parse_clicklog(lines: DataFrame, delimiter: str = "\t") -> DataFrame:
    """``label INT, i1…i13 INT, c1…c26 STRING`` from ``value``.

    Fields beyond the layout are ignored, absent ones are missing. A malformed integer, or a line
    without a label, fails the query. No quoting rules apply, unlike in the CSV reader.
    """
    fields = lines.select(F.split("value", delimiter, -1).alias("f"))
    ints = [f"int(nullif(get(f, {j}), '')) AS {c}" for j, c in enumerate(INT_COLS, 1)]
    cats = [f"nullif(get(f, {j}), '') AS {c}" for j, c in enumerate(CAT_COLS, 1 + NUM_INTEGERS)]
    return fields.selectExpr(f"int(get(f, 0)) AS {LABEL}", *ints, *cats)


def read_clicklog(spark: SparkSession, path: str) -> DataFrame:
    return parse_clicklog(spark.read.text(path))


def clicklog_line() -> Column:
    """The text form of a row; missing values become empty fields."""
    order = [LABEL, *INT_COLS, *CAT_COLS]
    return F.expr("concat_ws('\t', " + ", ".join(f"coalesce(string({c}), '')" for c in order) + ")")


def write_clicklog(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(clicklog_line().alias("value")).write.mode(mode).text(path)

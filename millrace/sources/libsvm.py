"""LibSVM text: ``label idx:val …`` with 1-based ascending indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """``label DOUBLE, features`` as a sparse struct with 0-based indices.

    Spark's reader parses the lines; unwrapping its vector type keeps the vectors sparse and in the
    JVM. ``num_features`` is required: finding it out would cost a pass over the data.
    """
    rows = spark.read.format("libsvm").option("numFeatures", num_features).load(path)
    v = F.unwrap_udt("features")
    return rows.select(
        "label",
        F.struct(
            v["size"].alias("size"), v["indices"].alias("indices"), v["values"].alias("values")
        ).alias("features"),
    )


def sparse_entries(df: DataFrame, features: str = "features") -> DataFrame:
    """Long form of a sparse struct column: ``idx`` (1-based) and ``val`` per stored entry."""
    rest = [c for c in df.columns if c != features]
    zipped = F.arrays_zip(F.col(features)["indices"], F.col(features)["values"])
    return df.select(*rest, F.explode(zipped).alias("e")).select(
        *rest, (F.col("e")["indices"] + 1).alias("idx"), F.col("e")["values"].alias("val")
    )


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes a ``value`` column of LibSVM lines."""
    df.select("value").write.mode(mode).text(path)

"""Dense vectors and centers as text.

Points are one ``x1,x2,…,xd`` line each. Initial centers carry their id last, ``(x1,…,xd,id)``;
final centers are written with the id first, ``(id,x1,…,xd)``. Parsers take any frame with a
``value`` column, so they serve streams as well. A malformed number fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.parallelism import at_least


def parse_points(lines: DataFrame) -> DataFrame:
    """``features`` of each line; commas at its end are ignored."""
    fields = F.split(F.rtrim("value", F.lit(",")), ",")
    return lines.select(fields.cast("array<double>").alias("features"))


def parse_indexed_centers(lines: DataFrame) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"[()]", ""), ",")
    return lines.select(fields.alias("f")).select(
        F.element_at("f", -1).cast("int").alias("cid"),
        F.slice("f", F.lit(1), F.size("f") - 1).cast("array<double>").alias("center"),
    )


def read_points(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``features`` per line, in at least ``partitions`` parts if given."""
    lines = spark.read.text(path)
    return parse_points(lines if partitions is None else at_least(lines, partitions))


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """True centers: same text as points."""
    return read_points(spark, path).withColumnRenamed("features", "center")


def read_indexed_centers(spark: SparkSession, path: str) -> DataFrame:
    return parse_indexed_centers(spark.read.text(path))


def csv_line(vector: Column) -> Column:
    return F.array_join(vector.cast("array<double>").cast("array<string>"), ",")


def write_points(df: DataFrame, path: str, features: str = "features", mode: str = "error") -> None:
    df.select(csv_line(F.col(features)).alias("value")).write.mode(mode).text(path)


def indexed_line(cid: Column, center: Column) -> Column:
    return F.concat(F.lit("("), csv_line(center), F.lit(","), cid.cast("string"), F.lit(")"))


def write_indexed_centers(centers: DataFrame, path: str, mode: str = "error") -> None:
    line = indexed_line(F.col("cid"), F.col("center"))
    centers.select(line.alias("value")).write.mode(mode).text(path)


def final_line(cid: Column, center: Column) -> Column:
    return F.concat(F.lit("("), cid.cast("string"), F.lit(","), csv_line(center), F.lit(")"))


def parse_final_centers(lines: DataFrame) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"[()]", ""), ",")
    return lines.select(fields.alias("f")).select(
        F.element_at("f", 1).cast("int").alias("cid"),
        F.slice("f", F.lit(2), F.size("f") - 1).cast("array<double>").alias("center"),
    )


def write_centers(
    centers: DataFrame, path: str, mode: str = "error", text: bool = False
) -> None:
    """Trained centers. ``mode='error'`` refuses an existing path, ``'overwrite'`` replaces it."""
    if text:
        line = final_line(F.col("cid"), F.col("center"))
        centers.select(line.alias("value")).write.mode(mode).text(path)
    else:
        centers.write.mode(mode).parquet(path)

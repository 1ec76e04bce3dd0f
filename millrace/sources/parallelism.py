"""Requested input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def at_least(df: DataFrame, partitions: int, *by: str) -> DataFrame:
    """``df`` in at least ``partitions`` parts.

    A table of few small files reads in few tasks; only such a one is redistributed. Anything that
    already has the parts, as every large table does, passes untouched. Rows move by the hash of
    the columns ``by`` (all if none is named; name a key, so that Spark reads and moves only the
    columns that are used later): a repeated task sends them the same way, without the sort that a round-robin
    distribution needs for that. Meant for scans: counting the parts of a frame behind a shuffle
    would run that shuffle.
    """
    if df.rdd.getNumPartitions() >= partitions:
        return df
    return df.repartition(partitions, *(by or df.columns))

"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What separates words: the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; a null stays null."""
    return F.translate(text, UPPER, LOWER)


def computed_once(value: Column) -> Column:
    """``value`` behind a generator of one row, so that no filter on it is pushed below and computes it anew."""
    return F.explode(F.array(value))


def as_row(names: list[str]) -> Column:
    """The user's columns as one struct ``row``, so that none can clash with a working column."""
    fields = [F.col(f"`{c}`") for c in names]
    return (F.struct(*fields) if fields else F.lit(None)).alias("row")


def of_row(names: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in names]

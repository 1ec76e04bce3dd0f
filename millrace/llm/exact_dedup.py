"""Exact duplicates by distributed radix partitioning, most significant bytes first.

A document is read as its length followed by its bytes. Round by round, every group of documents that
agree so far is split by the next bytes; the number of bytes taken grows from round to round. A
document alone in its group leaves, and so does a group whose bytes have ended: those are equal, byte
by byte, without any digest. Only documents that still share their group go on to the next round.

A round first counts the groups, with partial counts before the shuffle, and keeps those of two and
more. Their table then meets the documents in a sorted join whose two sides Spark can split where one
group is large. No group is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import ascii_lower, text_or_empty
from millrace.plans.scratch import remove, write_and_read, write_table

#: Bytes of the first round, the factor from round to round, and the most that a round takes.
FIRST_BYTES, GROWTH, MOST_BYTES = 64, 8, 1 << 20


def normalised(text: Column) -> Column:
    """What is compared: null as empty, A to Z in lower case."""
    return ascii_lower(text_or_empty(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``, without its text, with ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the largest ``id_col`` stays; among repeated rows with that id
    exactly one does, and a null id counts as smaller than any other. A null text equals an empty
    one. An empty table gives an empty result. Columns named like the results are replaced. The
    result is a table in the shared folder, as the rounds before it are not kept.
    """
    spark = docs.sparkSession
    results = {text_col.lower(), "keep_id", "group_size", "kept"}
    others = [c for c in docs.columns if c.lower() not in results]
    bytes_ = normalised(F.col(text_col)).cast("binary")
    first = docs.select(
        F.struct(*others).alias("row"), F.col(id_col).alias("id"), bytes_.alias("rest")
    ).select(
        "row",
        "id",
        F.octet_length("rest").alias("size"),
        _head(FIRST_BYTES).alias("head"),
        _tail(FIRST_BYTES).alias("rest"),
    )
    shared, groups = _shared(first, ["size", "head"], F.count(F.lit(1)).alias("n"))
    state, path = write_table(
        _meet(first, shared, ["size", "head"]).select(
            "row",
            "id",
            "size",
            "head",
            F.when(F.col("n") > 1, F.col("rest")).alias("rest"),
            F.col("n").isNull().alias("alone"),
            F.monotonically_increasing_id().alias("number"),  # fixed from here on: it is written
        ),
        "radix",
    )
    remove(spark, groups)
    done = [state.filter("alone").select(_finished(F.col("id"), F.lit(1), F.lit(True)))]
    state, keys, width, paths = state.filter("NOT alone"), ["size", "head"], FIRST_BYTES, [path]
    while not state.isEmpty():
        width = min(width * GROWTH, MOST_BYTES)
        split = state.withColumn("piece", _head(width)).withColumn("rest", _tail(width))
        top = F.max(F.struct("id", "number")).alias("top")
        shared, groups = _shared(split, [*keys, "piece"], F.count(F.lit(1)).alias("n"), top)
        over = F.col("n").isNull() | (F.octet_length("rest") == 0)
        stored, path = write_table(
            _meet(split, shared, [*keys, "piece"]).select(
                "row", "id", "number", F.when(~over, F.col("rest")).alias("rest"), "n", "top",
                F.col("top.number").alias("group"), over.alias("over"),
            ),
            "radix",
        )
        remove(spark, groups)
        keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id"))
        kept = F.coalesce(F.col("number") == F.col("top.number"), F.lit(True))
        size = F.coalesce("n", F.lit(1))
        done.append(stored.filter("over").select(_finished(keep_id, size, kept)))
        paths.append(path)
        state, keys = stored.filter("NOT over").select("row", "id", "number", "rest", "group"), ["group"]
    result = write_and_read(reduce(DataFrame.unionByName, done).select("result.*"), "exact-groups")
    for path in paths:
        remove(spark, path)
    return result.select(*(F.col(f"row.{c}").alias(c) for c in others), "keep_id", "group_size", "kept")


def _head(width: int) -> Column:
    return F.substring("rest", 1, width)


def _tail(width: int) -> Column:
    return F.substring("rest", width + 1, (1 << 31) - 1 - width)


def _finished(keep_id: Column, size: Column, kept: Column) -> Column:
    return F.struct(
        "row", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept")
    ).alias("result")


def _shared(rows: DataFrame, keys: list[str], *counts: Column) -> tuple[DataFrame, str]:
    """The groups of two and more, written so that the join's sides are plain shuffles; and their path."""
    return write_table(rows.groupBy(*keys).agg(*counts).filter("n > 1"), "radix-groups")


def _meet(rows: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """By sorting on both sides at every size: the groups grow with the corpus, so none is broadcast."""
    return rows.join(shared.hint("merge"), keys, "left")

"""Packing tokenised documents into training sequences by best-two-fit.

Documents longer than a sequence are cut into pieces; nothing else is cut. Where a piece goes depends
on its length only, so the packing is planned on the counts by length, at most ``capacity`` numbers
whatever the corpus. One plan row says which ranks of a length go to which sequences; the pieces
then look up their places in a join. No piece passes through the driver and no group is gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.columns import as_row, of_row
from millrace.llm.vocabulary import WordEncoder, broadcast_file, once_per_worker
from millrace.plans.scratch import write_and_read

CAPACITY = 2048
#: Rows that one window over pieces of a length sorts at most, on average: a block's pieces of one length.
BLOCK_ROWS = 10_000

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
)


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: the other columns of ``docs``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, with ``keep_ids``, ``ids``.

    ``vocabulary`` is a file of the ``tokenizers`` library in lower case, whose splitter drops white
    space and parts letters from punctuation, so texts may be encoded word by word. A null text counts as
    empty; every document ends with ``end_id``, so each has at least one piece. Repeated rows give
    repeated pieces. A column of ``docs`` named like a result column is replaced.
    """
    model = broadcast_file(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        words = once_per_worker(model, WordEncoder)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            counts, starts, lengths, sums, kept = [0], [], [], [], []
            for text in batch:
                ids = words.text(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    kept.append(piece if keep_ids else b"")
                counts.append(len(starts))
            ends = np.cumsum([0, *map(len, kept)]) // 4
            values = pa.array(np.frombuffer(b"".join(kept), "<i4"), pa.int32())
            fields = [
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
            ]
            structs = pa.StructArray.from_arrays(fields, ["start", "length", "ids_crc32", "ids"])
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs)

    names = ["piece", "start", "length", "ids_crc32", "ids"]
    taken = {text_col.lower(), *names}
    others = [c for c in docs.columns if c.lower() not in taken]
    pieces = F.arrow_udf(encode, PIECES)(F.col(text_col))
    rows = docs.select(as_row(others), F.posexplode(pieces).alias("number", "made"))
    wanted = names[1:] if keep_ids else names[1:-1]
    return rows.select(
        *of_row(others), F.col("number").alias("piece"), *(F.col(f"made.{n}").alias(n) for n in wanted)
    )


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Best-two-fit on counts by length.

    A bin takes the longest document left, then again and again the longest that still fits. Then
    its smallest document gives way to two unpacked ones that fill the widened gap more tightly, the
    tightest such pair first, as long as there is one. The finished pattern is used for as many bins
    as the counts allow, so each step uses up a length or nearly so: at most one step more than
    capacity / length for each length, thus fewer than 10 x capacity steps of at most capacity rows.

    Rows: length, first rank, last rank (exclusive), first bin, pieces of this length in a bin,
    offset of the first of them.
    """
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    lengths = sorted(left)
    used_ranks: Counter = Counter()
    plan, bins = [], 0
    while lengths:
        pattern, gap = _fill(lengths, left, capacity)
        while gap and pattern:
            smallest = min(pattern)
            pair = _tightest_pair(lengths, left, pattern, gap + smallest, smallest)
            if pair is None:
                break
            pattern[smallest] -= 1
            if not pattern[smallest]:
                del pattern[smallest]
            pattern.update(pair)
            gap += smallest - sum(pair)
        times = min(left[n] // c for n, c in pattern.items())
        offset = 0
        for n in sorted(pattern, reverse=True):
            c = pattern[n]
            plan.append((n, used_ranks[n], used_ranks[n] + c * times, bins, c, offset))
            used_ranks[n] += c * times
            left[n] -= c * times
            offset += n * c
        bins += times
        lengths = [n for n in lengths if left[n]]
    return plan


def _fill(lengths: list[int], left: dict[int, int], capacity: int) -> tuple[Counter, int]:
    pattern, gap, top = Counter(), capacity, len(lengths)
    while True:
        top = bisect_right(lengths, gap, 0, top)
        if not top:
            return pattern, gap
        n = lengths[top - 1]
        pattern[n] = min(left[n], gap // n)
        gap -= n * pattern[n]
        top -= 1


def _tightest_pair(lengths, left, pattern, room, least) -> tuple[int, int] | None:
    """The two free documents with the largest sum over ``least`` and within ``room``."""
    best, pair = least, None
    low, high = 0, bisect_right(lengths, room) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room:
            high -= 1
        elif a + b <= best:
            low += 1
        elif left[a] - pattern.get(a, 0) < 1 + (low == high):
            low += 1
        elif left[b] - pattern.get(b, 0) < 1:
            high -= 1
        else:
            best, pair = a + b, (a, b)
            if best == room:
                break
            low += 1
    return pair


def pack(
    pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences without gaps, from offset 0.

    ``keys`` are columns that spread the rows; equal keys do no harm, repeated rows get places of
    their own. A length that is null or not within 1 to ``capacity`` gets null places. Columns named
    like the two new ones are replaced. The rows are written to the shared folder once, because they
    are counted first and placed afterwards.
    """
    spark = pieces.sparkSession
    others = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    stored = write_and_read(
        pieces.select(
            F.struct(*others).alias("row"),
            F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length"),
            F.xxhash64(*keys).alias("spread"),
        ),
        "pieces",
    )
    blocks = max(1, -(-stored.count() // BLOCK_ROWS))
    dealt = stored.withColumn("block", F.pmod("spread", F.lit(blocks)))
    by_block = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {
        r.length: r.n
        for r in by_block.filter(F.col("length").between(1, capacity))
        .groupBy("length")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row per length up to the capacity
    }
    plan = spark.createDataFrame(
        plan_bins(counts, capacity),
        "at bigint, first bigint, last bigint, bin bigint, per_bin bigint, shift bigint",
    )
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    starts = by_block.select(F.col("length").alias("of"), F.col("block").alias("in_block"), earlier)
    within = Window.partitionBy("length", "block").orderBy("spread")
    ranked = (
        dealt.withColumn("number", F.row_number().over(within) - 1)
        .join(starts, (F.col("length") == F.col("of")) & (F.col("block") == F.col("in_block")))
        .select("row", "length", (F.col("number") + F.col("earlier")).alias("rank"))
    )
    index: Column = F.col("rank") - F.col("first")
    return ranked.join(
        F.broadcast(plan),  # bounded by the capacity, see plan_bins
        (F.col("length") == F.col("at"))
        & (F.col("rank") >= F.col("first"))
        & (F.col("rank") < F.col("last")),
        "left",
    ).select(
        "row.*",
        (F.col("bin") + F.floor(index / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("shift") + index % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, ``n_tokens``.

    Takes what ``pack`` gives for pieces with their ids; a sequence has at most ``capacity`` of them.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return (
        placed.filter(F.col("sequence_id").isNotNull())
        .groupBy("sequence_id")
        .agg(ids.alias("ids"))
        .withColumn("n_tokens", F.size("ids"))
    )

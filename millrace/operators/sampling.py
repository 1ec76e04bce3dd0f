"""Sampling whose outcome depends on row keys only."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.uniform import keyed_digest, keyed_uniform
from millrace.functions.vectors import vector_kind
from millrace.plans.scratch import write_table

TASK_BYTES = 128 * 1024 * 1024

# exp(-mean) must stay well above the smallest double; larger means are split into parts.
POISSON_PART = 64.0
# The keyed uniform has 32 random bits, so no draw lies above this probability.
LARGEST_UNIFORM = 1.0 - 2.0**-32


def _text_key(key: str) -> Column:
    """The key as text; a null is a key of its own, so its rows are sampled like any others."""
    return F.coalesce(F.col(key).cast("string"), F.lit("\0null"))


def sample_k(df: DataFrame, key: str, k: int, seed: int = 42, partial: int | None = None) -> DataFrame:
    """Exactly k rows without replacement (all rows if there are fewer); null keys take part.

    The k-th smallest digest is found on the key alone, as a top-k per task and one merge of k digests
    from every task; only rows up to it, k but for repeated keys, take part in the sort with their
    payload. Nothing is estimated or run while planning. ``partial`` has no effect any more.
    """
    digest = keyed_digest(seed, _text_key(key))
    if df.columns != [key]:
        smallest = df.select(digest.alias("digest")).orderBy("digest").limit(k)
        df = df.filter(digest <= smallest.agg(F.max("digest")).scalar())
    return df.orderBy(digest, F.col(key)).limit(k)


def smallest_digests(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The rows of :func:`sample_k` in no order, for any k, without sorting them in one place.

    Rounds of counting by hexadecimal digits of the digest find the last one that belongs: a round gives
    at most 2^(4 DIGITS) counts, and only a digest prefix held by at most LAST rows is sorted.
    """
    if k <= 0:
        return df.filter(F.lit(False))
    digest = keyed_digest(seed, _text_key(key))
    keyed = df.withColumn("_digest", digest)
    prefix, left = "", k
    while True:
        width = len(prefix) + DIGITS
        part = keyed.filter(F.startswith("_digest", F.lit(prefix)))
        counts = part.groupBy(F.substring("_digest", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("c"))
        found = sorted((r["p"], r["c"]) for r in counts.collect())  # at most 2^(4 DIGITS)
        last = None
        for p, c in found:
            if c >= left:
                last = p, c
                break
            left -= c
        if last is None:  # fewer rows than asked for
            return df
        prefix = last[0]
        if last[1] == left:
            return keyed.filter(F.substring("_digest", 1, width) <= prefix).drop("_digest")
        if last[1] <= LAST or width >= DIGEST_LENGTH:
            break
    inside = keyed.filter(F.startswith("_digest", F.lit(prefix)))
    # rows that share the last digest share the key, too; as many of them as are missing are taken
    tail = inside.orderBy("_digest", key).limit(left).drop("_digest")
    before = keyed.filter(F.substring("_digest", 1, len(prefix)) < prefix).drop("_digest")
    return before.unionByName(tail)


#: Digits of a digest that one round of counting looks at, all its digits, and rows that are sorted in one place.
DIGITS, DIGEST_LENGTH, LAST = 3, 32, 10_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a number from 0 in the given order, without gaps and without a window over all rows.

    Rows are dealt out by range and sorted within their parts; a part's rows are counted, and what the
    earlier parts hold is added. Only one count per part is put in order in one place. The sorted rows
    are written once, to the shared folder, so that both steps see the same parts.
    """
    spark = df.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    table, _ = write_table(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", PART_BITS)
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per part
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["n"]
    known = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _before bigint"))
    within = F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    joined = table.withColumn("_part", part).join(known, "_part")
    return joined.select(*df.columns, (F.col("_before") + within).alias(name))


#: Low bits of a monotonically increasing id that count the rows of a part.
PART_BITS = 33
#: Sampled rows up to which a window numbers them.
LOCAL_K = 10_000


def initial_centers(
    points: DataFrame, key: str, k: int, seed: int = 42, features: str = "features"
) -> DataFrame:
    """k sampled points as ``(cid, center)``, ids 0 … k-1 in sampling order; sparse points stay sparse.

    Up to LOCAL_K of them are merged and numbered in one place, never the points. More are found by counting
    digests and numbered by ranges; the centers are the same. With repeated keys, which of the rows gets which
    number is open.
    """
    wanted = points.select(key, features)
    sparse = vector_kind(points, features) == "sparse"
    center = F.col(features) if sparse else F.col(features).cast("array<double>")
    order = [keyed_digest(seed, _text_key(key)), F.col(key)]
    if k <= LOCAL_K:
        picked = sample_k(wanted, key, k, seed)
        number = F.row_number().over(Window.orderBy(*order)) - 1
    else:
        picked = numbered(smallest_digests(wanted, key, k, seed), order, "cid")
        number = F.col("cid").cast("int")
    return picked.select(number.alias("cid"), center.alias("center"))


def poisson_steps(mean: float) -> list[float]:
    """Cumulative Poisson probabilities below the largest possible draw."""
    steps, term, total, n = [], math.exp(-mean), math.exp(-mean), 0
    while total <= LARGEST_UNIFORM:
        steps.append(total)
        n += 1
        term *= mean / n
        if total + term == total and n > mean:
            break
        total += term
    return steps


def sample_poisson(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Sample with replacement: each row appears Poisson(fraction) times, decided by its key.

    The count inverts the cumulative distribution at a keyed uniform. A sum of independent Poisson
    draws is Poisson, so a large fraction is drawn in parts.
    """
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    if fraction == 1.0:
        return df
    if fraction == 0.0:
        return df.filter(F.lit(False))
    parts = [POISSON_PART] * int(fraction // POISSON_PART)
    parts += [p for p in [fraction - POISSON_PART * len(parts)] if p > 0]
    uniforms = {
        f"_u{i}": keyed_uniform(seed, F.concat(_text_key(key), F.lit(f"#{i}")))
        for i in range(len(parts))
    }
    reached = [
        (F.col(u) >= step).cast("int") for u, p in zip(uniforms, parts) for step in poisson_steps(p)
    ]
    copies = F.explode(F.array_repeat(F.lit(True), functools.reduce(operator.add, reached)))
    return df.withColumns(uniforms).select(*df.columns, copies.alias("_copy")).drop("_copy")


def sample_with_replacement(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sampler. Which rows it picks depends on how the input is partitioned."""
    return df if fraction == 1.0 else df.sample(True, fraction, seed)

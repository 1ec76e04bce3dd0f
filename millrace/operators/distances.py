"""Distances of given pairs of vectors that are too long, or too wide, for an expression per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import as_doubles

#: Differences held at once by the kernel.
TILE_VALUES = 1 << 17


def long_form(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Entries ``(key, idx, val)`` of sparse vectors, indices from 0."""
    zipped = F.arrays_zip(F.col(features)["indices"].alias("i"), F.col(features)["values"].alias("x"))
    return df.select(key, F.inline(zipped)).toDF(key, "idx", "val")


def long_distances(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, sqdist)`` of the pairs ``(a, b)``, from entries ``(a, idx, val)`` and ``(b, idx, val)``.

    A vector is as many rows as it has entries, so its length does not matter. Entries come to the
    pairs by id, the right ones with their sign turned, and add up by pair and index: that sum is the
    exact difference, so nothing cancels, unlike in ``|a|² + |b|² - 2 a·b``. Features are no key, so one
    that a third of all vectors have is no hot key; nothing but the given pairs is formed. Rows are dealt out
    by pair once, for both sums. A vector without entries is zero; repeated pairs count once.
    """
    pairs = pairs.select("a", "b").distinct()
    ours = pairs.join(left.select("a", "idx", "val"), "a").select("a", "b", "idx", F.col("val").cast("double").alias("val"))
    theirs = pairs.join(right.select("b", "idx", "val"), "b").select("a", "b", "idx", (-F.col("val").cast("double")).alias("val"))
    none = pairs.select("a", "b", F.lit(None).cast("int").alias("idx"), F.lit(0.0).alias("val"))
    dealt = ours.unionByName(theirs).unionByName(none).repartition("a", "b")
    differences = dealt.groupBy("a", "b", "idx").agg(F.sum("val").alias("d"))
    return differences.groupBy("a", "b").agg(F.sum(F.col("d") * F.col("d")).alias("sqdist"))


def wide_sqdist(a: str | Column, b: str | Column) -> Column:
    """Squared distance of two dense vector columns, on the flat values of Arrow batches.

    For vectors of hundreds of dimensions and more, where an expression would call a function for every
    value. A null vector gives null; vectors of different length are an error. The vectors should be stored
    columns: Spark does not hand expressions with lambdas to an Arrow function.
    """

    @F.arrow_udf("double")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        known = np.array(x.is_valid()) & np.array(y.is_valid())
        sizes = [np.where(known, np.diff(v.offsets.to_numpy()), 0) for v in (x, y)]
        wrong = np.flatnonzero(sizes[0] != sizes[1])
        if len(wrong):
            raise ValueError(f"vectors differ in dimension: {sizes[0][wrong[0]]} and {sizes[1][wrong[0]]}")
        rows = np.flatnonzero(known)
        flat = [v.values.to_numpy(zero_copy_only=False) for v in (x, y)]
        starts = [v.offsets.to_numpy() for v in (x, y)]
        out = np.zeros(len(x))
        ends = np.cumsum(sizes[0][rows])
        at = 0
        while at < len(rows):
            # whole vectors, as many as fill a tile, one at least
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE_VALUES, "right")))
            first, last = rows[at], rows[upto - 1]
            if upto - at == last - first + 1:
                p, q = (f[s[first] : s[last + 1]] for f, s in zip(flat, starts))
            else:
                p, q = (np.concatenate([f[s[r] : s[r + 1]] for r in rows[at:upto]]) for f, s in zip(flat, starts))
            d = p.astype(np.float64) - q
            d *= d
            lengths = sizes[0][rows[at:upto]]
            filled = np.flatnonzero(lengths)
            if len(filled):
                begin = np.cumsum(lengths) - lengths
                out[rows[at:upto][filled]] = np.add.reduceat(d, begin[filled])
            at = upto
        return pa.array(out, mask=~known)

    return distance(as_doubles(a), as_doubles(b))

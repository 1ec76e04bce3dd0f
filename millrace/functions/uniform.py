"""Random numbers that are a pure function of a seed and a position.

The value at a position never depends on partitioning, task order or retries, so a lost task that
runs again yields the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published 64-bit hash generator (Numerical Recipes, 3rd edition, p. 352).
FACTOR_1 = 3935559000370003845
OFFSET_1 = 2691343689449507681
FACTOR_2 = 4768777513237032717
SHIFTS_1 = (21, 37, 4)
SHIFTS_2 = (20, 41, 5)
SCALE = 2.0**-64


def counter_values(seed: int, positions: np.ndarray) -> np.ndarray:
    """Uniforms in [0, 1] at ``positions``; 64-bit integer steps wrap around."""
    right_a, left_a, right_b = (np.int64(s) for s in SHIFTS_1)
    left_b, right_c, left_c = (np.int64(s) for s in SHIFTS_2)
    with np.errstate(over="ignore"):
        state = positions.astype(np.int64) + np.int64(seed)
        state = state * np.int64(FACTOR_1) + np.int64(OFFSET_1)
        state ^= state >> right_a
        state ^= state << left_a
        state ^= state >> right_b
        state *= np.int64(FACTOR_2)
        state ^= state << left_b
        state ^= state >> right_c
        state ^= state << left_c
    return state.astype(np.float64) * SCALE + 0.5


def counter_ints(seed: int, positions: np.ndarray, bound: int) -> np.ndarray:
    """Integers in [0, bound). The uniform may round up to 1.0, hence the clamp."""
    drawn = np.floor(counter_values(seed, positions) * bound).astype(np.int64)
    return np.minimum(drawn, bound - 1)


def counter_uniform(position: Column, seed: int) -> Column:
    """Uniform DOUBLE at each position."""

    @F.arrow_udf("double")
    def drawn(batch: pa.Array) -> pa.Array:
        return pa.array(counter_values(seed, batch.to_numpy(zero_copy_only=False)))

    return drawn(position.cast("bigint"))


def counter_int(position: Column, seed: int, bound: int) -> Column:
    """Uniform BIGINT in [0, bound) at each position."""

    @F.arrow_udf("bigint")
    def drawn(batch: pa.Array) -> pa.Array:
        return pa.array(counter_ints(seed, batch.to_numpy(zero_copy_only=False), bound))

    return drawn(position.cast("bigint"))


def keyed_digest(seed: int, key: Column) -> Column:
    """Text digest of a row key; ordering by it is a repeatable shuffle of the rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def keyed_uniform(seed: int, key: Column) -> Column:
    """Uniform DOUBLE in [0, 1) with 32 random bits, computed without Python."""
    bits = F.conv(F.substring(keyed_digest(seed, key), 1, 8), 16, 10).cast("double")
    return bits / F.lit(float(2**32))

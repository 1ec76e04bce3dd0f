"""Signed feature hashing of string tokens.

The hash is 32-bit MurmurHash3 (x86 variant) of the token's UTF-8 bytes. Spark's built-in ``hash``
uses another seed and treats the last bytes of a string differently, and its ``HashingTF`` has no
sign, so the hash runs in Arrow batches: every NumPy step handles all tokens of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit MurmurHash3 (published algorithm).
MIX_1 = 0xCC9E2D51
MIX_2 = 0x1B873593
STEP_FACTOR = 5
STEP_ADD = 0xE6546B64
FINAL_1 = 0x85EBCA6B
FINAL_2 = 0xC2B2AE35

HASH_SEED = 0


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mix(k: np.ndarray) -> np.ndarray:
    return _rotate(k * np.uint32(MIX_1), 15) * np.uint32(MIX_2)


TAIL_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)


def murmur3(tokens: pa.Array, seed: int = HASH_SEED) -> np.ndarray:
    """Signed 32-bit hash of every string in ``tokens``."""
    if not len(tokens):
        return np.zeros(0, np.int32)
    raw = tokens.cast(pa.large_binary())
    if raw.null_count:
        raise ValueError("a token to hash must not be null")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    begin, size = offsets[:-1], np.diff(offsets)
    body = raw.buffers()[2]
    data = np.zeros(offsets[-1] + 4, np.uint8)
    if body is not None:
        data[:-4] = np.frombuffer(body, np.uint8, count=offsets[-1])
    # words[i] is the little-endian word that starts at byte i
    words = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    blocks = size >> 2
    h = np.full(len(size), seed, np.uint32)
    with np.errstate(over="ignore"):
        live = np.arange(len(size))
        for b in range(int(blocks.max())):
            live = live[blocks[live] > b]
            mixed = h[live] ^ _mix(words[begin[live] + 4 * b])
            h[live] = _rotate(mixed, 13) * np.uint32(STEP_FACTOR) + np.uint32(STEP_ADD)
        # an empty tail mixes to 0 and changes nothing
        h ^= _mix(words[begin + 4 * blocks] & TAIL_MASKS[size & 3])
        h ^= size.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(FINAL_1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(FINAL_2)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def murmur3_column(token: Column) -> Column:
    """Signed 32-bit hash of a string column."""

    @F.arrow_udf("int")
    def hashed(tokens: pa.Array) -> pa.Array:
        return pa.array(murmur3(tokens))

    return hashed(token)


def hash_index(h: Column, num_features: int) -> Column:
    """0-based bucket of a hash. Widened first: the absolute value of the least INT is no INT."""
    return (F.abs(h.cast("bigint")) % F.lit(num_features).cast("bigint")).cast("int")


def hash_sign(h: Column) -> Column:
    return F.when(h >= 0, 1).otherwise(-1)


def signed_sums(tokens: pa.ListArray, num_features: int) -> pa.ListArray:
    """Per row: sum of signs by bucket, zero sums left out, ascending buckets."""
    starts = tokens.offsets.to_numpy()
    flat = tokens.values.slice(int(starts[0]), int(starts[-1] - starts[0]))
    hashes = murmur3(flat).astype(np.int64)
    rows = np.repeat(np.arange(len(tokens), dtype=np.int64), np.diff(starts))
    # Row, bucket and sign in one integer: a plain sort brings equal buckets of a row together.
    keys = np.sort(2 * (rows * num_features + np.abs(hashes) % num_features) + (hashes < 0))
    signs, keys = 1 - 2 * (keys & 1), keys >> 1
    last = np.flatnonzero(np.diff(keys, append=-1))
    sums = np.diff(np.cumsum(signs)[last], prepend=0)
    keys, sums = keys[last][sums != 0], sums[sums != 0]
    ends = np.cumsum(np.bincount(keys // num_features, minlength=len(tokens)))
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array((keys % num_features).astype(np.int32)), pa.array(sums.astype(np.int32))],
        names=["idx", "val"],
    )
    return pa.ListArray.from_arrays(offsets, entries)


def hashed_entries(tokens: Column, num_features: int) -> Column:
    """``ARRAY<STRUCT<idx INT, val INT>>`` of an ``ARRAY<STRING>`` column; idx is 0-based.

    One Arrow pass hashes, adds up collisions, drops cancelled buckets and sorts, so a row never
    leaves its partition.
    """

    @F.arrow_udf("array<struct<idx:int,val:int>>")
    def summed(batch: pa.Array) -> pa.Array:
        return signed_sums(batch, num_features)

    return summed(tokens)


def token_hashes(tokens: Column) -> Column:
    """``ARRAY<INT>`` of the hashes of an ``ARRAY<STRING>`` column."""

    @F.arrow_udf("array<int>")
    def hash_all(batch: pa.Array) -> pa.Array:
        starts = batch.offsets.to_numpy()
        flat = batch.values.slice(int(starts[0]), int(starts[-1] - starts[0]))
        offsets = (starts - starts[0]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(murmur3(flat)))

    return hash_all(tokens)


def entries_of_hashes(hashes: Column, num_features: int) -> Column:
    """The sums of :func:`hashed_entries` as column expressions over given hashes.

    ``hashes`` must be a column of the frame: Spark allows no Python function inside a lambda.
    """
    signed = F.transform(
        hashes,
        lambda h: F.struct(hash_index(h, num_features).alias("idx"), hash_sign(h).alias("s")),
    )
    buckets = F.array_sort(F.array_distinct(F.transform(signed, lambda e: e["idx"])))

    def total(i: Column) -> Column:
        return F.aggregate(
            signed, F.lit(0), lambda acc, e: acc + F.when(e["idx"] == i, e["s"]).otherwise(0)
        )

    sums = F.transform(buckets, lambda i: F.struct(i.alias("idx"), total(i).alias("val")))
    return F.filter(sums, lambda e: e["val"] != 0)

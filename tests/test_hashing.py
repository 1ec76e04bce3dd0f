import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing

# Published test vectors of the 32-bit hash with seed 0, and one click-log token.
VECTORS = {
    "": 0x00000000,
    "hello": 0x248BFA47,
    "hello, world": 0x149BBB7F,
    "0:68fd1e64": 0xF97B42C1,
}


def test_known_hashes():
    got = hashing.murmur3(pa.array(list(VECTORS))).view(np.uint32)
    assert got.tolist() == list(VECTORS.values())


def _plain(data: bytes) -> int:
    """The published definition, one byte string at a time."""

    def rot(x, r):
        return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    h, full = 0, len(data) // 4 * 4
    for i in range(0, full, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = (rot(h ^ (rot(k, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(data) > full:
        k = int.from_bytes(data[full:], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= rot(k, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_all_lengths_and_slices():
    words = ["", "a", "ab", "abc", "abcd", "héé", "日本語のテキスト", "x" * 1001, "0:", "25:"] * 3
    arr = pa.array(words)
    want = [_plain(w.encode()) for w in words]
    assert hashing.murmur3(arr).view(np.uint32).tolist() == want
    assert hashing.murmur3(arr.slice(4, 9)).view(np.uint32).tolist() == want[4:13]
    assert hashing.murmur3(arr.cast(pa.large_string())).view(np.uint32).tolist() == want
    assert len(hashing.murmur3(pa.array([], pa.string()))) == 0
    with pytest.raises(ValueError):
        hashing.murmur3(pa.array(["a", None]))


def test_least_int_has_a_valid_index(spark):
    df = spark.createDataFrame([(-(2**31),), (-1,), (0,), (7,)], "h int")
    rows = df.select(
        hashing.hash_index(F.col("h"), 10).alias("i"), hashing.hash_sign(F.col("h")).alias("s")
    ).collect()
    assert [(r.i, r.s) for r in rows] == [(8, -1), (1, -1), (0, 1), (7, 1)]


def _brute(tokens, n):
    sums = {}
    for t in tokens:
        h = _plain(t.encode())
        h -= (h >= 2**31) << 32
        sums[abs(h) % n] = sums.get(abs(h) % n, 0) + (1 if h >= 0 else -1)
    return sorted((i, v) for i, v in sums.items() if v)


@pytest.mark.parametrize("buckets", [1, 4, 16, 1 << 20])
def test_entries_by_brute_force(spark, buckets):
    rows = [[f"{i}:{(r * 7 + i) % 11}" for i in range(r % 9)] for r in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t array<string>")
    got = (
        df.repartition(3)
        .withColumn("h", hashing.token_hashes(F.col("t")))
        .select(
            "id",
            hashing.hashed_entries(F.col("t"), buckets).alias("a"),
            hashing.entries_of_hashes(F.col("h"), buckets).alias("n"),
        )
        .orderBy("id")
        .collect()
    )
    for tokens, r in zip(rows, got):
        assert [tuple(e) for e in r.a] == _brute(tokens, buckets)
        assert r.a == r.n


def test_opposite_signs_cancel(spark):
    tokens = [f"0:{i}" for i in range(40)]
    plus = next(t for t in tokens if _plain(t.encode()) < 2**31)
    minus = next(t for t in tokens if _plain(t.encode()) >= 2**31)
    df = spark.createDataFrame([([plus, minus],)], "t array<string>")
    assert df.select(hashing.hashed_entries(F.col("t"), 1).alias("e")).first().e == []

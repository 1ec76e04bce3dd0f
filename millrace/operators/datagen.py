"""Gaussian-mixture data addressed by row id.

Every number is a function of the seed and a position, so a row depends on its id alone: the output
is the same for any partitioning, and nothing has to be sent to the tasks, not even the centers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.uniform import counter_ints, counter_values
from millrace.operators.sampling import TASK_BYTES, initial_centers, sample_k

# Settings of the published benchmark workload.
DEFAULT_SEED = 42
DEFAULT_NOISE = 0.05
CENTER_RANGE = 10.0
SIGMA_LIMIT = 5.0

BYTES_PER_VALUE = 8
SMALLEST_UNIFORM = 2.0**-64
# Values drawn at a time, so that the working arrays stay in the processor cache.
TILE_CELLS = 1 << 17


def rows_for_size(gib: float, d: int) -> int:
    """Rows of d doubles that fill ``gib`` GiB."""
    return math.ceil(math.ceil(gib * 2**30) / (BYTES_PER_VALUE * d))


def rows_for_size_column(gib: Column, d: Column) -> Column:
    size = F.ceil(gib.cast("double") * F.lit(float(2**30))).cast("bigint")
    return F.ceil(size / (d * BYTES_PER_VALUE)).cast("bigint")


@dataclass(frozen=True)
class Mixture:
    """k clusters in d dimensions.

    Positions of the random stream: k·d for the centers, k for the sigmas, then 2 + 2·d per point
    (cluster, noise switch, and two per dimension).
    """

    d: int
    k: int
    seed: int = DEFAULT_SEED
    noise: float = DEFAULT_NOISE
    center_range: float = CENTER_RANGE
    sigma_limit: float = SIGMA_LIMIT

    def __post_init__(self) -> None:
        if self.k < 1 or self.d < 1:
            raise ValueError("a mixture needs at least one cluster and one dimension")

    def center_values(self, cids: np.ndarray) -> np.ndarray:
        at = cids[:, None] * self.d + np.arange(self.d)
        return counter_values(self.seed, at) * self.center_range - self.center_range / 2

    def sigma_values(self, cids: np.ndarray) -> np.ndarray:
        return counter_values(self.seed, self.k * self.d + cids) * self.sigma_limit

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        return self.k * (self.d + 1) + ids * (2 + 2 * self.d)

    def point_values(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, noise flag and vector of each id."""
        start = self._starts(ids)
        cids = counter_ints(self.seed, start, self.k)
        noisy = counter_values(self.seed, start + 1) >= 1.0 - self.noise
        used, at = np.unique(cids, return_inverse=True)
        dims = start[:, None] + 2 + 2 * np.arange(self.d)
        u = counter_values(self.seed, dims)
        v = counter_values(self.seed, dims + 1)
        normal = np.sqrt(-2.0 * np.log(np.maximum(u, SMALLEST_UNIFORM))) * np.cos(2 * np.pi * v)
        spread = np.where(
            noisy[:, None], u * self.sigma_limit, self.sigma_values(used)[at][:, None] * normal
        )
        return cids, noisy, self.center_values(used)[at] + spread


def mixture_centers(ids: DataFrame, mixture: Mixture, key: str = "cid") -> DataFrame:
    """Adds ``center`` and ``sigma`` of every cluster id in ``ids``."""

    @F.arrow_udf("struct<center:array<double>,sigma:double>")
    def drawn(batch: pa.Array) -> pa.Array:
        cids = batch.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.StructArray.from_arrays(
            [_list_array(mixture.center_values(cids)), pa.array(mixture.sigma_values(cids))],
            names=["center", "sigma"],
        )

    return ids.withColumn("_c", drawn(F.col(key))).select(*ids.columns, "_c.center", "_c.sigma")


def mixture_points(ids: DataFrame, mixture: Mixture, key: str = "point_id") -> DataFrame:
    """Adds ``true_cid``, ``is_noise`` and ``features`` to every id in ``ids``."""

    @F.arrow_udf("struct<true_cid:bigint,is_noise:boolean,features:array<double>>")
    def drawn(batch: pa.Array) -> pa.Array:
        keys = batch.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = max(1, TILE_CELLS // mixture.d)
        tiles = [mixture.point_values(keys[i : i + rows]) for i in range(0, max(len(keys), 1), rows)]
        cids, noisy, x = (np.concatenate(part) for part in zip(*tiles))
        return pa.StructArray.from_arrays(
            [pa.array(cids), pa.array(noisy), _list_array(x)],
            names=["true_cid", "is_noise", "features"],
        )

    return ids.withColumn("_p", drawn(F.col(key))).select(
        *ids.columns, "_p.true_cid", "_p.is_noise", "_p.features"
    )


def _list_array(x: np.ndarray) -> pa.ListArray:
    rows, width = x.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))


def gaussian_mixture(
    spark: SparkSession,
    mixture: Mixture,
    n_rows: int | None = None,
    gib: float | None = None,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(points, centers, init)`` for exactly ``n_rows`` rows, or as many as fill ``gib``.

    ``init`` are k sampled points as ``(cid, center)``. Unless ``partitions`` says otherwise a task
    generates at most 128 MiB of vectors.
    """
    if (n_rows is None) == (gib is None):
        raise ValueError("give either n_rows or gib")
    n = n_rows if n_rows is not None else rows_for_size(gib, mixture.d)
    if partitions is None:
        needed = math.ceil(n * mixture.d * BYTES_PER_VALUE / TASK_BYTES)
        partitions = max(spark.sparkContext.defaultParallelism, needed)
    ids = spark.range(0, n, 1, partitions).withColumnRenamed("id", "point_id")
    points = mixture_points(ids, mixture)
    cids = spark.range(mixture.k).select(F.col("id").cast("int").alias("cid"))
    centers = mixture_centers(cids, mixture)
    return points, centers, mixture_init(ids, mixture, mixture.k)


def mixture_init(ids: DataFrame, mixture: Mixture, k: int, key: str = "point_id") -> DataFrame:
    """k of the points at ``ids`` as ``(cid, center)``; the ids are sampled before any point is drawn."""
    picked = sample_k(ids.select(key), key, k, mixture.seed)
    return initial_centers(mixture_points(picked, mixture, key), key, k, mixture.seed)

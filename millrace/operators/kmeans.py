"""k-means training from given initial centers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from millrace.functions.vectors import sparsify, vector_kind
from millrace.operators.nearest import (
    BLOCK,
    COUNTS,
    NO_CENTER,
    Centers,
    CenterTable,
    SparseRows,
    assigned_sums,
    centers_from_means,
    collect_centers,
    nearest_column,
    plain_centers,
    sparse_means,
    vector_means,
)
from millrace.plans.limits import model_budget
from millrace.plans.scratch import remove, write_table

DENSE = T.ArrayType(T.DoubleType())
SPARSE = T.StructType(
    [
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def center_schema(kind: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("cid", T.IntegerType(), False),
            T.StructField("center", DENSE if kind == "dense" else SPARSE, False),
            T.StructField("n", T.LongType(), True),
        ]
    )


STORAGE_LEVELS = {
    "MEMORY_ONLY": StorageLevel.MEMORY_ONLY,
    "MEMORY_ONLY_SER": StorageLevel.MEMORY_ONLY,
    "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK,
    "MEMORY_AND_DISK_SER": StorageLevel.MEMORY_AND_DISK,
    "DISK_ONLY": StorageLevel.DISK_ONLY,
}


def storage_level(name: str) -> StorageLevel:
    """Storage level by name. A cached DataFrame is always serialized, so the SER forms coincide."""
    if name not in STORAGE_LEVELS:
        raise ValueError(f"unknown storage level: {name}")
    return STORAGE_LEVELS[name]


def _as_frame(spark: SparkSession, model: Centers, counts: dict[int, int] | None, kind: str) -> DataFrame:
    def written(center: np.ndarray):
        if kind == "dense":
            return [float(v) for v in center]
        at = np.flatnonzero(center)
        return len(center), [int(i) for i in at], [float(v) for v in center[at]]

    rows = [
        (int(cid), written(center), counts[int(cid)] if counts else None)
        for cid, center in zip(model.ids, model.matrix)
    ]
    return spark.createDataFrame(rows, center_schema(kind))


def one_round(points: DataFrame, model: Centers, features: str) -> tuple[Centers, dict[int, int]]:
    """One assignment and update; returns k·d numbers to the driver, which also ends the lineage."""
    sums = assigned_sums(points, model, features).toArrow()
    counts: dict[int, int] = {}
    parts = [sums.column(c).to_pylist() for c in ("cid", "block", "n")]
    for cid, block, n in zip(*parts, strict=True):
        counts[cid] = max(n, counts.get(cid, 0))
    ids = np.array(sorted(counts), np.int64)
    matrix = np.zeros((len(ids), model.matrix.shape[1]))
    row = {int(cid): i for i, cid in enumerate(ids)}
    for cid, block, x in zip(parts[0], parts[1], sums.column("x"), strict=True):
        if block != COUNTS:
            values = x.values.to_numpy(zero_copy_only=False)
            matrix[row[cid], block * BLOCK : block * BLOCK + len(values)] = values / counts[cid]
    return Centers(ids, matrix), counts


def _round_by_table(
    points: DataFrame, centers: DataFrame, features: str, budget: int
) -> tuple[DataFrame, str]:
    """The same round for center tables beyond the budget; they stay in written tables.

    Points without a center are counted under ``NO_CENTER`` and dropped behind the sums: a filter on the
    search's result would make it run twice.
    """
    table = CenterTable.write(centers, budget)
    near = nearest_column(points, features, table)
    assigned = points.select(near["cid"].alias("cid"), features)
    if vector_kind(points, features) == "sparse":
        # the assignment enters two aggregations, so it is made once
        assigned, path = write_table(assigned, "assigned")
        means = sparse_means(assigned, "cid", features)
    else:
        means, path = centers_from_means(vector_means(assigned, "cid", features)), None
    updated = write_table(means.filter(F.col("cid") != NO_CENTER), "round")
    for done in (table.path, path):
        if done is not None:
            remove(points.sparkSession, done)
    return updated


def _in_form(centers: DataFrame, kind: str) -> DataFrame:
    """Centers as dense or sparse vectors."""
    if vector_kind(centers, "center") == kind:
        return centers
    if kind == "sparse":
        return centers.withColumn("center", sparsify("center", 0.0))

    @F.arrow_udf(DENSE)
    def filled(column: pa.Array) -> pa.Array:
        rows = SparseRows.of(column)
        width = int(rows.size[0]) if len(rows.size) else 0
        ends = np.arange(len(rows.size) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.filled(np.arange(len(rows.size)), width).reshape(-1)))

    return centers.withColumn("center", filled("center"))


def fit_lloyd(
    points: DataFrame,
    init: DataFrame,
    iterations: int,
    features: str = "features",
    storage: str | None = "MEMORY_AND_DISK",
    budget: int | None = None,
) -> DataFrame:
    """Lloyd's algorithm for exactly ``iterations`` rounds from ``init`` ``(cid, center)``.

    Returns ``(cid, center, n)``, n being the points that formed the center in the last round. Points
    are dense or sparse, and so are the centers; those returned have the form of ``init``. Of sparse points
    at most a tile is filled up: a task adds their stored entries to its table of sums.

    - No convergence test; 0 rounds return the initial centers with n NULL.
    - A center that gets no point disappears.
    - Ties go to the smallest ``cid``; points with no comparable distance (NaN) are left out.
    - ``storage=None`` reads the points anew each round instead of caching them.
    """
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    level = storage_level(storage) if storage is not None else None
    spark = points.sparkSession
    budget = model_budget(spark) if budget is None else budget
    form = vector_kind(init, "center")
    model = collect_centers(init, budget)
    data = points.select(features)
    # A single pass gains nothing from a cache.
    cached = level is not None and iterations > 1
    if cached:
        data = data.persist(level)
    try:
        if model is not None:
            counts = None
            for _ in range(iterations):
                model, counts = one_round(data, model, features)
            return _as_frame(spark, model, counts, form)
        table = plain_centers(init).select(
            F.col("cid").cast("int").alias("cid"), "center", F.lit(None).cast("bigint").alias("n")
        )
        previous = None
        for _ in range(iterations):
            table, path = _round_by_table(data, table, features, budget)
            if previous is not None:
                remove(spark, previous)
            previous = path
        return _in_form(table, form)
    finally:
        if cached:
            data.unpersist()


def _center_rows(spark: SparkSession, ids: Iterable[int], centers: Iterable) -> DataFrame:
    rows = [(int(cid), [float(v) for v in c], None) for cid, c in zip(ids, centers)]
    return spark.createDataFrame(rows, center_schema("dense")).drop("n")


def _vector_rdd(vectors: DataFrame):
    """The column ``v`` of ML vectors as the JVM's RDD of the older vector type; no row passes through Python."""
    jvm = vectors.sparkSession._jvm
    older = MLUtils.convertVectorColumnsFromML(vectors, "v")._jdf
    kind = jvm.org.apache.spark.mllib.linalg.VectorUDT()
    encoder = getattr(jvm.org.apache.spark.sql.catalyst.encoders, "AgnosticEncoders$UDTEncoder")
    return getattr(older, "as")(encoder(kind, kind.getClass())).rdd()


def fit_library(
    points: DataFrame,
    init: DataFrame | None,
    k: int,
    iterations: int,
    features: str = "features",
    storage: str = "MEMORY_AND_DISK",
    seed: int = 42,
) -> DataFrame:
    """Spark's own k-means; returns ``(cid, center)``.

    With ``init`` it starts from those k centers, which the library holds on the driver, and makes
    ``iterations`` rounds unless no center moves any more. The DataFrame estimator accepts no initial
    model, so the vectors go to the older API, within the JVM. Without ``init`` the estimator picks its own
    start (``k-means||``) and stops once every center moves less than 1e-4. Centers that get no point are
    kept. Points must be dense.
    """
    level = storage_level(storage)
    spark = points.sparkSession
    if vector_kind(points, features) != "dense":
        raise TypeError("the library is given dense points only; use fit_lloyd for sparse ones")
    vectors = points.select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    if init is None:
        estimator = KMeans(featuresCol="v", k=k, maxIter=iterations, tol=1e-4, seed=seed)
        data = vectors.persist(level)
        try:
            return _center_rows(spark, range(k), estimator.fit(data).clusterCenters())
        finally:
            data.unpersist()
    start = _in_form(plain_centers(init), "dense").orderBy("cid").limit(k + 1).persist()
    data = vectors.persist(level)
    try:
        ids = [r["cid"] for r in start.select("cid").collect()]
        if len(ids) != k:
            raise ValueError(f"{len(ids)} initial centers given for k = {k}" + " or more" * (len(ids) > k))
        jvm = spark._jvm
        given = _vector_rdd(start.orderBy("cid").select(array_to_vector("center").alias("v"))).toJavaRDD().collect()
        library = jvm.org.apache.spark.mllib.clustering
        trainer = library.KMeans().setK(k).setMaxIterations(iterations).setEpsilon(0.0)
        trainer.setInitialModel(library.KMeansModel(given))
        trained = trainer.run(_vector_rdd(data)).clusterCenters()
        found = [list(c.toArray()) for c in trained]
    finally:
        data.unpersist()
        start.unpersist()
    return _center_rows(spark, ids, found)


def fit(
    points: DataFrame, init: DataFrame | None, iterations: int, method: str = "lloyd", **options
) -> DataFrame:
    """Training by name: ``lloyd`` (ours) or ``library`` (Spark's)."""
    if method == "lloyd":
        return fit_lloyd(points, init, iterations, **options)
    if method == "library":
        return fit_library(points, init, iterations=iterations, **options)
    raise ValueError(f"unknown training method: {method}")


def long_form(centers: DataFrame) -> DataFrame:
    """``(cid, dim, x)`` with dim from 1."""
    return centers.select("cid", F.posexplode("center").alias("dim", "x")).select(
        "cid", (F.col("dim") + 1).alias("dim"), "x"
    )

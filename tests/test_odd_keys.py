"""Null keys, mixed widths, cancelling distances and declared counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import features, nearest, sampling
from millrace.sources import parallelism

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


@pytest.fixture(scope="module")
def keyed(spark):
    """A seventh of the keys is null."""
    key = F.when(F.col("id") % 7 != 0, F.col("id"))
    return spark.range(2100).select(key.alias("k"), F.col("id").alias("payload"))


def test_null_keys_are_sampled(keyed):
    copies = sampling.sample_poisson(keyed, "k", 1.5)
    nulls = copies.filter("k IS NULL").count()
    assert nulls % 300 == 0 and 2000 < copies.filter("k IS NOT NULL").count() < 3500
    assert sampling.sample_k(keyed, "k", 9).count() == 9
    assert sampling.sample_k(keyed, "k", 5000).count() == 2100


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_null_key_is_a_cluster(spark, engine):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 4.0]), (1, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "k long, features array<double>").repartition(3)
    sums = nearest.vector_sums(df, "k", engine=engine)
    assert sorted(map(tuple, sums.collect()), key=str) == sorted(
        [(None, 0, 4.0, 2), (None, 1, 6.0, 2), (1, 0, 5.0, 1), (1, 1, 6.0, 1)], key=str
    )


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_mixed_widths_fail(spark, engine):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0, 5.0])], "k long, features array<double>")
    with pytest.raises(Exception, match="differ in dimension"):
        nearest.vector_sums(df.repartition(2, "features"), "k", engine=engine).collect()


def test_sparse_distances_do_not_cancel(spark):
    rows = [(1, ([2], [0, 1], [1e8, 1.0]))]
    points = spark.createDataFrame(
        [(i, (2, ix, v)) for i, ([_], ix, v) in rows], f"point_id long, features {SPARSE}"
    )
    centers = spark.createDataFrame([(2, [1e8 + 0.1, 1.0]), (3, [1e8 + 0.01, 1.0])], "cid int, center array<double>")
    exact = (1e8 - (1e8 + 0.01)) ** 2
    d = points.select(vectors.sqdist_sparse_dense("features", F.array(F.lit(1e8 + 0.1), F.lit(1.0))))
    assert d.first()[0] == (1e8 - (1e8 + 0.1)) ** 2
    for engine in ("arrow", "native"):
        row = nearest.nearest_center(points, centers, engine=engine).first()
        assert row["cid"] == 3
    assert nearest.clustering_cost(points, centers).first()[0] == pytest.approx(exact, rel=1e-12)


@pytest.mark.parametrize("k", [20, 700])
def test_dense_and_sparse_sums_agree(k):
    """The same summation for few and many centers, and for the stored entries of sparse vectors."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(0, 3, (4000, 7)) * (rng.random((4000, 7)) < 0.5)
    model = nearest.Centers(np.arange(k), rng.normal(0, 3, (k, 7)))
    sums, counts = np.zeros((k, 7)), np.zeros(k, np.int64)
    nearest.add_nearest(sums, counts, x, model)
    at = ((x[:, None, :] - model.matrix[None]) ** 2).sum(axis=2).argmin(axis=1)
    want = np.zeros((k, 7))
    np.add.at(want, at, x)
    assert (counts == np.bincount(at, minlength=k)).all() and np.allclose(sums, want, rtol=0, atol=1e-9)
    kept = [np.flatnonzero(row) for row in x]
    stored = pa.array(
        [{"size": 7, "indices": i.tolist(), "values": row[i].tolist()} for i, row in zip(kept, x)],
        pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]),
    )
    sums, counts = np.zeros((k, 7)), np.zeros(k, np.int64)
    nearest.add_nearest_sparse(sums, counts, nearest.SparseRows.of(stored, 7), model)
    assert (counts == np.bincount(at, minlength=k)).all() and np.allclose(sums, want, rtol=0, atol=1e-9)


def test_sparse_ties_and_empty_rows(spark):
    sparse = [([], []), ([0], [1.0]), ([2], [float("nan")]), ([0, 2], [2.0, 2.0])]
    rows = [(i, (3, ix, v)) for i, (ix, v) in enumerate(sparse)]
    points = spark.createDataFrame(rows, f"point_id long, features {SPARSE}").coalesce(1)
    centers = [(4, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (7, [2.0, 0.0, 2.0])]
    centers = spark.createDataFrame(centers, "cid int, center array<double>")
    for engine in ("arrow", "native"):
        got = nearest.nearest_center(points, centers, engine=engine).orderBy("point_id").collect()
        assert [(r["cid"], r["sqdist"]) for r in got] == [(2, 1.0), (2, 0.0), (-1, None), (7, 0.0)]


def test_large_ids_fail(spark, points):
    centers = spark.createDataFrame([(2**31 + 5, [0.0, 0.0, 0.0])], "cid long, center array<double>")
    with pytest.raises(Exception, match="INT"):
        nearest.nearest_center(points, centers).collect()


def test_declared_count_times_fraction(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("y"), F.lit(6).alias("i"), F.lit("a").alias("c"), "id")
    lines = features.standardize_and_hash(df, "y", ["i"], ["c"], 16, fraction=1.5, n=4000, key="id", digits=6)
    n = sampling.sample_poisson(df, "id", 1.5).count()
    mean = 6 * n / 6000
    std = (n * (6 - mean) ** 2 / 6000) ** 0.5
    score = float(lines.first()[0].split(" ")[1].split(":")[1])
    assert score == pytest.approx((6 - mean) / std if std else 0.0, abs=1e-4)


def test_spreading_by_a_key_prunes(spark, tmp_path):
    spark.range(10).select("id", F.lit("wide").alias("w"), F.lit(1).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = parallelism.at_least(spark.read.parquet(f"{tmp_path}/t"), 4, "id").select("id", "v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "w:string" not in plan and "hashpartitioning(id" in plan

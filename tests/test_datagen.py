import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import datagen, kmeans, nearest

MIX = datagen.Mixture(d=4, k=3)


def test_size_model(spark):
    # Row counts of the published workload at d = 100.
    assert datagen.rows_for_size(5, 100) == 6_710_887
    assert datagen.rows_for_size(200, 100) == 268_435_456
    assert datagen.rows_for_size(1000, 100) == 1_342_177_280
    df = spark.createDataFrame([(5.0, 100), (0.001, 7)], "g double, d int")
    got = df.select(datagen.rows_for_size_column(F.col("g"), F.col("d")).alias("n")).collect()
    assert [r.n for r in got] == [6_710_887, datagen.rows_for_size(0.001, 7)]


def test_output_does_not_depend_on_partitions(spark):
    results = []
    for parts in (1, 4, 16):
        points, centers, init = datagen.gaussian_mixture(spark, MIX, n_rows=500, partitions=parts)
        results.append(
            (
                [tuple(r) for r in points.orderBy("point_id").collect()],
                [tuple(r) for r in centers.orderBy("cid").collect()],
                [tuple(r) for r in init.orderBy("cid").collect()],
            )
        )
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) == 500 and [c[0] for c in results[0][2]] == [0, 1, 2]


def test_distribution():
    ids = np.arange(60_000)
    mix = datagen.Mixture(d=5, k=4)
    cids, noisy, x = mix.point_values(ids)
    assert abs(noisy.mean() - 0.05) < 0.005
    assert np.abs(np.bincount(cids, minlength=4) / len(ids) - 0.25).max() < 0.01
    centers, sigmas = mix.center_values(np.arange(4)), mix.sigma_values(np.arange(4))
    assert ((centers >= -5) & (centers < 5)).all() and ((sigmas >= 0) & (sigmas < 5)).all()
    for c in range(4):
        clean = x[(cids == c) & ~noisy] - centers[c]
        assert np.abs(clean.mean(axis=0)).max() < 0.1
        assert np.allclose(clean.std(axis=0), sigmas[c], rtol=0.05)
        noise = x[(cids == c) & noisy] - centers[c]
        assert noise.min() >= 0 and noise.max() <= 5 and abs(noise.mean() - 2.5) < 0.2


def test_streams_do_not_overlap():
    mix = datagen.Mixture(d=3, k=2)
    centers = {int(c) * 3 + j for c in range(2) for j in range(3)}
    sigmas = {6 + c for c in range(2)}
    starts = mix._starts(np.arange(5))
    points = {int(s) + i for s in starts for i in range(8)}
    assert not centers & sigmas and not points & (centers | sigmas) and len(points) == 40


def test_noise_share_is_a_parameter():
    ids = np.arange(5000)
    assert not datagen.Mixture(d=2, k=2, noise=0.0).point_values(ids)[1].any()
    assert datagen.Mixture(d=2, k=2, noise=1.0).point_values(ids)[1].all()


def test_arguments(spark):
    with pytest.raises(ValueError):
        datagen.Mixture(d=2, k=0)
    with pytest.raises(ValueError):
        datagen.gaussian_mixture(spark, MIX)
    points, _, _ = datagen.gaussian_mixture(spark, MIX, gib=1e-5)
    assert points.count() == math.ceil(math.ceil(1e-5 * 2**30) / 32)


def test_training_recovers_cost_of_true_centers(spark):
    points, centers, _ = datagen.gaussian_mixture(spark, MIX, n_rows=2000, partitions=4)
    trained = kmeans.fit_lloyd(points, centers, 5)
    before = nearest.clustering_cost(points, centers).first().cost
    assert nearest.clustering_cost(points, trained).first().cost <= before

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import uniform
from millrace.operators import sampling


def test_counter_known_values():
    got = uniform.counter_values(42, np.arange(3))
    assert np.round(got, 8).tolist() == [0.28923432, 0.26212635, 0.90071863]


def test_counter_against_big_integers():
    def plain(x):
        wrap = 1 << 64

        def signed(v):
            v %= wrap
            return v - wrap if v >= wrap >> 1 else v

        x = signed(uniform.FACTOR_1 * x + uniform.OFFSET_1)
        a, b, c = uniform.SHIFTS_1
        x = signed(x ^ (x >> a))
        x = signed(x ^ signed(x << b))
        x = signed(x ^ (x >> c))
        x = signed(uniform.FACTOR_2 * x)
        a, b, c = uniform.SHIFTS_2
        x = signed(x ^ signed(x << a))
        x = signed(x ^ (x >> b))
        x = signed(x ^ signed(x << c))
        return float(x) * 2.0**-64 + 0.5

    at = np.array([0, 1, 5, 10**6, 2**40, 2**62])
    assert uniform.counter_values(42, at).tolist() == [plain(42 + int(p)) for p in at]


def test_counter_column_and_bound(spark):
    df = spark.range(1000).select(
        uniform.counter_uniform(F.col("id"), 3).alias("u"),
        uniform.counter_int(F.col("id"), 3, 7).alias("i"),
    )
    rows = df.collect()
    assert all(0.0 <= r.u <= 1.0 and r.i == min(int(r.u * 7), 6) for r in rows)
    assert {r.i for r in rows} == set(range(7))


def test_upper_end_is_clamped(monkeypatch):
    monkeypatch.setattr(uniform, "counter_values", lambda seed, p: np.ones(len(p)))
    assert uniform.counter_ints(1, np.arange(2), 5).tolist() == [4, 4]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    results = []
    for parts in (1, 4, 16):
        moved = df.repartition(parts)
        results.append(
            (
                [r.k for r in sampling.sample_k(moved, "k", 9).collect()],
                sorted(r.k for r in sampling.sample_poisson(moved, "k", 1.5).collect()),
            )
        )
    assert results[0] == results[1] == results[2]
    assert len(set(results[0][0])) == 9


def test_sample_k_with_few_rows(spark):
    assert sampling.sample_k(spark.range(3), "id", 10).count() == 3


@pytest.mark.parametrize("k", [1, 3, 40, 900, 5000])
def test_prefiltered_sample_is_the_same(spark, k):
    df = spark.range(3000).repartition(4)
    direct = sampling.sample_k(df, "id", k).collect()
    assert sampling.sample_k(df, "id", k, partial=0).collect() == direct
    assert len(direct) == min(k, 3000)


def test_initial_centers_are_numbered_points(points):
    rows = sampling.initial_centers(points, "point_id", 4).collect()
    known = {tuple(r.features) for r in points.collect()}
    assert sorted(r.cid for r in rows) == [0, 1, 2, 3]
    assert {tuple(r.center) for r in rows} <= known


@pytest.mark.parametrize("fraction", [0.0, 0.3, 1.0, 2.5, 130.0])
def test_poisson_counts(spark, fraction):
    n = 4000
    sampled = sampling.sample_poisson(spark.range(n), "id", fraction)
    count = sampled.count()
    if fraction == 1.0:
        assert count == n
    else:
        assert abs(count - n * fraction) <= 6 * math.sqrt(n * fraction)
    assert sampled.columns == ["id"]


def test_poisson_steps_are_the_distribution():
    steps = sampling.poisson_steps(2.0)
    assert steps[0] == pytest.approx(math.exp(-2)) and steps[1] == pytest.approx(3 * math.exp(-2))
    assert steps == sorted(steps) and 1.0 - steps[-1] < 1e-8


def test_native_sampler(spark):
    df = spark.range(1000)
    assert sampling.sample_with_replacement(df, 1.0) is df
    assert 1300 < sampling.sample_with_replacement(df, 1.5).count() < 1700


def test_negative_fraction(spark):
    with pytest.raises(ValueError):
        sampling.sample_poisson(spark.range(1), "id", -0.1)


@pytest.mark.parametrize("k", [0, 1, 50, 699, 700, 5000])
@pytest.mark.parametrize("last", [2, 10_000])
def test_smallest_digests_are_the_sample(spark, monkeypatch, k, last):
    monkeypatch.setattr(sampling, "LAST", last)
    df = spark.range(700).withColumn("key", F.when(F.col("id") % 9 != 0, F.col("id"))).repartition(3)
    want = sorted(str(r.key) for r in sampling.sample_k(df, "key", k).collect()) if k else []
    got = sampling.smallest_digests(df, "key", k).collect()
    assert sorted(str(r.key) for r in got) == want and got == [] or len(got) == min(k, 700)


def test_many_initial_centers_are_numbered_by_ranges(spark, monkeypatch):
    points = spark.range(500).select(F.col("id"), F.array(F.col("id").cast("double")).alias("features")).repartition(4)
    few = {r.cid: r.center for r in sampling.initial_centers(points, "id", 123).collect()}
    monkeypatch.setattr(sampling, "LOCAL_K", 10)
    many = sampling.initial_centers(points, "id", 123)
    assert {r.cid: r.center for r in many.collect()} == few and sorted(few) == list(range(123))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "TakeOrdered" not in plan


def test_a_million_initial_centers(spark):
    points = spark.range(0, 1_200_000, 1, 4).select("id", F.array(F.col("id").cast("double")).alias("features"))
    many = sampling.initial_centers(points, "id", 1_000_000)
    one = many.agg(F.count("*"), F.min("cid"), F.max("cid"), F.countDistinct("cid")).first()
    assert tuple(one) == (1_000_000, 0, 999_999, 1_000_000)

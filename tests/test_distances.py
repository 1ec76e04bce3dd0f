"""Distances of pairs in long form, and of wide vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import distances


def test_long_distances_with_one_feature_that_all_have(spark):
    rng = random.Random(3)
    vectors = {i: {0: 1e6 + rng.random(), **{rng.randrange(1, 50): rng.gauss(0, 1) for _ in range(4)}} for i in range(60)}
    vectors[60], vectors[61] = {}, {}
    rows = [(i, (50, sorted(v), [v[j] for j in sorted(v)])) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "id int, features struct<size:int,indices:array<int>,values:array<double>>").repartition(3)
    entries = distances.long_form(df, "id")
    pairs = [(rng.randrange(62), rng.randrange(62)) for _ in range(200)] + [(60, 61), (60, 5), (7, 7), (7, 7)]
    pairs += [(0, i) for i in range(62)]
    table = spark.createDataFrame(pairs, "a int, b int")
    found = distances.long_distances(entries.withColumnRenamed("id", "a"), entries.withColumnRenamed("id", "b"), table)
    got = {(r.a, r.b): r.sqdist for r in found.collect()}
    assert got.keys() == set(pairs)
    for (a, b), d in got.items():
        u, v = vectors[a], vectors[b]
        assert d == pytest.approx(sum((u.get(i, 0) - v.get(i, 0)) ** 2 for i in u.keys() | v.keys()), rel=1e-9, abs=1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Cross" not in plan


@pytest.mark.parametrize("tile", [10, 5000, 1 << 17])
def test_wide_distances(spark, monkeypatch, tile):
    monkeypatch.setattr(distances, "TILE_VALUES", tile)
    rng = np.random.default_rng(4)
    x, y = rng.normal(1e3, 1, (40, 1500)), rng.normal(1e3, 1, (40, 1500))
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(40)]
    rows += [(40, None, [1.0]), (41, [1.0], None), (42, [], []), (43, [2.0], [5.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(2)
    got = {r.id: r.d for r in df.select("id", distances.wide_sqdist("a", "b").alias("d")).collect()}
    assert [got[i] for i in (40, 41, 42, 43)] == [None, None, 0.0, 9.0]
    for i in range(40):
        assert got[i] == pytest.approx(((x[i] - y[i]) ** 2).sum(), rel=1e-12)
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="1 and 2"):
        uneven.select(distances.wide_sqdist("a", F.col("b"))).collect()

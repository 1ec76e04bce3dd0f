import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import kmeans, nearest
from millrace.operators.nearest import Centers

CENTER = "cid int, center array<double>"
POINT = "id int, features array<double>"


def _brute(x, centers):
    """Nearest by (distance, cid), as the definition reads."""
    best = (math.inf, -1)
    for cid, c in sorted(centers):
        d = sum((a - b) ** 2 for a, b in zip(x, c))
        if d < best[0]:
            best = (d, cid)
    return best


def _lloyd(rows, centers, rounds):
    for _ in range(rounds):
        members = {}
        for x in rows:
            members.setdefault(_brute(x, centers)[1], []).append(x)
        centers = [
            (cid, [sum(v) / len(xs) for v in zip(*xs)]) for cid, xs in members.items() if cid != -1
        ]
    return dict(centers)


@pytest.mark.parametrize("options", [{}, {"engine": "native"}, {"budget": 60}])
def test_search_by_brute_force(points, init, options):
    centers = [(r.cid, r.center) for r in init.collect()]
    got = nearest.nearest_center(points, init, **options)
    assert got.columns == ["point_id", "features", "cid", "sqdist"]
    rows = got.collect()
    assert len(rows) == 120
    for r in rows:
        d, cid = _brute(r.features, centers)
        assert r.cid == cid and r.sqdist == pytest.approx(d)


@pytest.mark.parametrize("options", [{}, {"engine": "native"}, {"budget": 20}])
def test_ties_nan_and_infinity(spark, options):
    centers = spark.createDataFrame([(7, [1.0, 0.0]), (3, [-1.0, 0.0]), (5, [1.0, 0.0])], CENTER)
    pts = [
        (0, [0.0, 4.0]),
        (1, [2.0, 0.0]),
        (2, [math.nan, 0.0]),
        (3, [math.inf, 0.0]),
        (4, [1e200, 0.0]),
        (5, [-0.1, 0.0]),
    ]
    got = nearest.nearest_center(spark.createDataFrame(pts, POINT), centers, **options)
    rows = {r.id: r for r in got.collect()}
    assert [rows[i].cid for i in range(6)] == [3, 5, -1, -1, -1, 3]
    assert rows[2].sqdist is None and rows[0].sqdist == 17.0


def test_large_finite_values_are_compared_exactly(spark):
    centers = spark.createDataFrame([(0, [1e154]), (1, [1.1e154])], CENTER)
    got = nearest.nearest_center(spark.createDataFrame([(0, [1.09e154])], POINT), centers)
    assert got.first().cid == 1


def test_near_ties_use_exact_distances():
    rng = np.random.default_rng(3)
    c = np.repeat(rng.normal(1e4, 1, (1, 20)), 40, axis=0) + rng.normal(0, 1e-9, (40, 20))
    x = c[rng.integers(0, 40, 500)] + rng.normal(0, 1e-9, (500, 20))
    model = Centers(np.arange(40), c)
    best, at = nearest.search(x, model)
    want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert np.allclose(best, want.min(axis=1), rtol=1e-9, atol=0)
    assert (want[np.arange(500), at] <= want.min(axis=1) * (1 + 1e-9)).all()


def test_equal_centers_go_to_the_smallest_id():
    rng = np.random.default_rng(9)
    places = rng.normal(0, 1, (3, 50))
    model = Centers(np.arange(900), np.repeat(places, 300, axis=0))
    x = rng.normal(0, 1, (700, 50))
    best, at = nearest.search(x, model)
    want = ((x[:, None, :] - places[None]) ** 2).sum(axis=2)
    assert (at == want.argmin(axis=1) * 300).all() and np.allclose(best, want.min(axis=1))
    _, positions = nearest.search(x, model, distances=False)
    assert (positions == at).all()


def test_many_centers_use_the_grouped_sums():
    rng = np.random.default_rng(5)
    model = Centers(np.arange(400) * 3, rng.normal(0, 1, (400, 5)))
    x = rng.normal(0, 1, (3000, 5))
    sums, counts = np.zeros((400, 5)), np.zeros(400, np.int64)
    nearest.add_nearest(sums, counts, x, model)
    _, at = nearest.search(x, model)
    want = np.zeros((400, 5))
    np.add.at(want, at, x)
    assert np.allclose(sums, want) and counts.tolist() == np.bincount(at, minlength=400).tolist()


def test_dimension_mismatch(spark):
    centers = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0])], CENTER)
    pts = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], POINT)
    for engine in ("arrow", "native"):
        with pytest.raises(Exception, match="3 and 4"):
            nearest.nearest_center(pts, centers, engine=engine).collect()
    uneven = spark.createDataFrame([(0, [0.0]), (1, [0.0, 1.0])], CENTER)
    for budget in (None, 1):
        with pytest.raises(ValueError, match="differ in dimension"):
            nearest.collect_centers(uneven, budget)
    with pytest.raises(ValueError, match="unknown engine"):
        nearest.nearest_center(pts, centers, engine="other")


SPARSE = "id int, features struct<size:int,indices:array<int>,values:array<double>>"


@pytest.mark.parametrize("options", [{}, {"engine": "native"}, {"budget": 150}])
def test_sparse_points_by_brute_force(spark, options):
    rng = np.random.default_rng(11)
    width, centers = 12, [(int(i), [float(v) for v in rng.normal(0, 2, 12)]) for i in range(6)]
    centers.append((6, centers[2][1]))  # a tie for every point near it
    dense, rows = [], []
    for i in range(80):
        idx = sorted(rng.choice(width, rng.integers(0, 6), replace=False).tolist())
        val = [float(v) for v in rng.normal(0, 3, len(idx))]
        dense.append([val[idx.index(j)] if j in idx else 0.0 for j in range(width)])
        rows.append((i, (width, idx, val)))
    pts = spark.createDataFrame(rows, SPARSE).repartition(3)
    got = nearest.nearest_center(pts, spark.createDataFrame(centers, CENTER), **options).collect()
    assert len(got) == 80
    for r in got:
        d, cid = _brute(dense[r.id], centers)
        assert r.cid == cid and r.sqdist == pytest.approx(d)


def test_sparse_width_must_match(spark):
    pts = spark.createDataFrame([(0, (5, [1], [2.0]))], SPARSE)
    centers = spark.createDataFrame([(0, [0.0, 1.0])], CENTER)
    with pytest.raises(Exception, match="5 and 2"):
        nearest.nearest_center(pts, centers).collect()


def test_intermediate_tables_are_removed(spark, points, init):
    import os

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    kmeans.fit_lloyd(points, init, 3, budget=60).collect()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("round-")
    before = set(os.listdir(folder))
    small = nearest.clustering_cost(points, init, budget=60).first().cost
    assert small == pytest.approx(nearest.clustering_cost(points, init).first().cost)
    assert set(os.listdir(folder)) == before


def test_sparse_rounds_by_table_remove_theirs(spark):
    import os

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    pts, rows, dense = _sparse_case(spark, 9)
    init = spark.createDataFrame([(i, dense[i]) for i in (3, 5, 8)], CENTER)
    before = set(os.listdir(folder))
    kmeans.fit_lloyd(pts, init, 3, budget=30).collect()
    assert [name.partition("-")[0] for name in set(os.listdir(folder)) - before] == ["round"]


def test_partial_sums_are_arrays_of_a_block(spark, points, init):
    model = nearest.collect_centers(init)
    rows = nearest.block_rows(np.arange(3), np.ones((3, 1100)), np.array([4, 5, 6]))
    assert rows.num_rows == 9 and [len(x) for x in rows.column("x")][:3] == [512, 512, 76]
    assert rows.column("n").to_pylist() == [4] * 3 + [5] * 3 + [6] * 3
    sent = nearest.assigned_sums(points, model, "features")
    assert sent.count() == 4 and {len(r.x) for r in sent.collect()} == {3}


def _sparse_case(spark, width, n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        nnz = int(rng.integers(0, min(6, width)))
        idx = sorted(rng.choice(width, nnz, replace=False).tolist())
        rows.append((i, (width, idx, [float(v) for v in rng.normal(0, 3, nnz)])))
    dense = [[dict(zip(v[1], v[2])).get(j, 0.0) for j in range(width)] for _, v in rows]
    return spark.createDataFrame(rows, SPARSE).repartition(4), rows, dense


SPARSE_CENTER = "cid int, center struct<size:int,indices:array<int>,values:array<double>>"


@pytest.mark.parametrize("budget", [None, 400])
@pytest.mark.parametrize("form", ["dense", "sparse"])
@pytest.mark.parametrize("block", [4, 512])
def test_sparse_lloyd_by_brute_force(spark, monkeypatch, budget, form, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(kmeans, "BLOCK", block)
    pts, rows, dense = _sparse_case(spark, 15)
    picked = [7, 20, 33, 51]
    if form == "dense":
        init = spark.createDataFrame([(c, dense[i]) for c, i in enumerate(picked)], CENTER)
    else:
        init = spark.createDataFrame([(c, rows[i][1]) for c, i in enumerate(picked)], SPARSE_CENTER)
    want = _lloyd(dense, [(c, dense[i]) for c, i in enumerate(picked)], 3)
    got = kmeans.fit_lloyd(pts, init, 3, budget=budget)
    assert got.schema["center"].dataType == init.schema["center"].dataType
    found = {}
    for r in got.collect():
        center = r.center
        if form == "sparse":
            center = [dict(zip(center.indices, center["values"])).get(j, 0.0) for j in range(center.size)]
        found[r.cid] = center
    assert found.keys() == want.keys() and sum(r.n for r in got.collect()) == 90
    for cid in want:
        assert found[cid] == pytest.approx(want[cid])
    assert kmeans.fit_lloyd(pts, init, 0, budget=budget).count() == 4


def test_sparse_sums_send_only_blocks_with_values(spark):
    wide = 1 << 20
    rows = [(i, (wide, [i % 7, 1000 * (i % 3) + 5], [1.0, 2.0])) for i in range(60)]
    pts = spark.createDataFrame(rows, SPARSE).repartition(3)
    init = spark.createDataFrame([(0, rows[0][1]), (1, rows[1][1])], SPARSE_CENTER)
    model = nearest.collect_centers(init)
    sent = nearest.assigned_sums(pts, model, "features").collect()
    assert len(sent) <= 2 * (4 + 1) and sum(r.n for r in sent) == 60
    trained = kmeans.fit_lloyd(pts, init, 2).collect()
    assert sum(r.n for r in trained) == 60 and all(len(r.center.indices) < 12 for r in trained)


def test_sparse_points_of_other_width_are_an_error(spark):
    pts = spark.createDataFrame([(0, (5, [1], [2.0])), (1, (6, [1], [2.0]))], SPARSE)
    init = spark.createDataFrame([(0, (5, [1], [2.0]))], SPARSE_CENTER)
    for budget in (None, 10):
        with pytest.raises(Exception, match="6 and 5"):
            kmeans.fit_lloyd(pts, init, 1, budget=budget).collect()
    with pytest.raises(TypeError, match="dense points only"):
        kmeans.fit_library(pts, init, 1, 1)


def test_streamed_centers_keep_the_smallest_id(spark):
    """Equal centers in different blocks of a streamed table."""
    centers = spark.createDataFrame([(i, [float(i // 30), 1.0]) for i in range(90, 0, -1)], CENTER).repartition(3)
    pts = spark.createDataFrame([(i, [i / 10, 1.0]) for i in range(31)], POINT)
    for engine in ("arrow", "native"):
        whole = nearest.nearest_center(pts, centers, engine=engine).collect()
        parts = nearest.nearest_center(pts, centers, engine=engine, budget=200).collect()
        assert sorted(whole) == sorted(parts) and {r.cid for r in parts} == {1, 30, 60, 90}


def test_no_centers(spark, points):
    empty = spark.createDataFrame([], CENTER)
    assert {r.cid for r in nearest.nearest_center(points, empty).collect()} == {-1}


def test_sums_engines_agree(points):
    keyed = points.withColumn("key", (F.col("point_id") % 7).cast("int"))
    got = {}
    for engine in ("arrow", "native"):
        rows = nearest.vector_sums(keyed, "key", engine=engine).collect()
        got[engine] = {(r.cid, r.dim): (round(r.x, 9), r.n) for r in rows}
    assert got["arrow"] == got["native"] and len(got["arrow"]) == 21


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_one_key_with_a_third_of_the_rows(spark, engine):
    rng = np.random.default_rng(2)
    keys = np.where(np.arange(900) % 3 == 0, 5, rng.integers(10, 40, 900))
    x = rng.normal(0, 1, (900, 4))
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(keys, x)]
    df = spark.createDataFrame(rows, "key int, features array<double>").repartition(6)
    got = nearest.vector_means(df, "key", engine=engine).collect()
    assert {r.cid: r.n for r in got} == {int(k): int((keys == k).sum()) for k in set(keys)}
    for r in got:
        assert r.x == pytest.approx(x[keys == r.cid, r.dim].mean())


def test_sums_flush_when_the_table_outgrows_its_budget(spark, points):
    spark.conf.set("spark.millrace.maxModelBytes", "100")
    try:
        rows = nearest.vector_sums(
            points.withColumn("key", F.col("point_id").cast("int")), "key"
        ).collect()
    finally:
        spark.conf.unset("spark.millrace.maxModelBytes")
    assert len(rows) == 360 and {r.n for r in rows} == {1}


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_lloyd_by_brute_force(points, init, rounds):
    x = [r.features for r in points.orderBy("point_id").collect()]
    want = _lloyd(x, [(r.cid, r.center) for r in init.collect()], rounds)
    for options in ({}, {"storage": None}, {"budget": 60}):
        rows = kmeans.fit_lloyd(points, init, rounds, **options).collect()
        assert {r.cid for r in rows} == set(want)
        for r in rows:
            assert r.center == pytest.approx(want[r.cid])
        assert sum(r.n for r in rows) == 120


def test_zero_rounds_return_the_input(points, init):
    for options in ({}, {"budget": 1}):
        rows = kmeans.fit_lloyd(points, init, 0, **options).collect()
        assert {r.cid: r.center for r in rows} == {r.cid: r.center for r in init.collect()}
        assert all(r.n is None for r in rows)
    with pytest.raises(ValueError):
        kmeans.fit_lloyd(points, init, -1)


def test_empty_cluster_disappears_and_nan_is_left_out(spark):
    pts = spark.createDataFrame(
        [(0, [0.0]), (1, [2.0]), (2, [math.nan]), (3, [10.0])], POINT
    )
    centers = spark.createDataFrame([(0, [1.0]), (1, [9.0]), (2, [500.0])], CENTER)
    for options in ({}, {"budget": 10}):
        rows = kmeans.fit_lloyd(pts, centers, 2, **options).collect()
        assert sorted((r.cid, r.center, r.n) for r in rows) == [(0, [1.0], 2), (1, [10.0], 1)]


def test_cost_never_rises(points, init):
    costs = [
        nearest.clustering_cost(points, kmeans.fit_lloyd(points, init, i)).first().cost
        for i in range(5)
    ]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def test_library_training(points, init):
    start = nearest.clustering_cost(points, init).first().cost
    trained = kmeans.fit(points, init, 3, method="library", k=4)
    assert trained.columns == ["cid", "center"] and trained.count() == 4
    assert nearest.clustering_cost(points, trained).first().cost <= start
    with pytest.raises(ValueError):
        kmeans.fit_library(points, init, 3, 3)
    own_start = kmeans.fit_library(points, None, 3, 10)
    assert own_start.count() == 3
    assert nearest.clustering_cost(points, own_start).first().cost < 2 * start


def test_method_and_storage_names(points, init):
    assert kmeans.fit(points, init, 1).count() == 4
    with pytest.raises(ValueError, match="unknown training method"):
        kmeans.fit(points, init, 1, method="other")
    with pytest.raises(ValueError, match="unknown storage level"):
        kmeans.fit_lloyd(points, init, 1, storage="TAPE")
    for name in kmeans.STORAGE_LEVELS:
        assert kmeans.fit_lloyd(points, init, 2, storage=name).count() == 4


def test_points_are_released(spark, points, init):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    kmeans.fit_lloyd(points, init, 3).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_centers_round_trip_through_long_form(points, init):
    means = nearest.vector_means(
        nearest.nearest_center(points, init).select("cid", "features"), "cid"
    )
    packed = {r.cid: r.center for r in nearest.centers_from_means(means).collect()}
    one = {r.cid: r.center for r in kmeans.fit_lloyd(points, init, 1).collect()}
    assert packed.keys() == one.keys()
    for cid in one:
        assert packed[cid] == pytest.approx(one[cid])


def test_mostly_stored_sparse_points_go_in_filled_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((700, 29)) < 0.8, rng.integers(-2, 3, (700, 29)).astype(float), 0.0)
    x[3, 4], x[9, 2], x[11] = np.nan, np.inf, 0.0
    kept = x != 0
    starts = np.concatenate(([0], np.cumsum(kept.sum(axis=1))))
    rows = nearest.SparseRows(np.full(700, 29), starts, np.nonzero(kept)[1].astype(np.int32), x[kept])
    model = Centers(np.array([2, 5, 6, 9]), np.vstack((x[20], x[20], x[30], np.zeros(29))))
    searched = []
    found = nearest.search
    monkeypatch.setattr(nearest, "search", lambda part, *rest: searched.append(len(part)) or found(part, *rest))
    best, at = nearest.search_sparse(rows, model)
    assert sum(searched) == 700
    exact = ((x[:, None, :] - model.matrix) ** 2).sum(axis=2)
    exact[[3, 9]] = math.inf
    lost = np.isin(np.arange(700), [3, 9])
    assert (at[lost] == nearest.NO_CENTER).all() and (at[~lost] == exact.argmin(axis=1)[~lost]).all()
    assert (best[~lost] == exact.min(axis=1)[~lost]).all()
    sums, counts = np.zeros((4, 29)), np.zeros(4, np.int64)
    nearest.add_nearest_sparse(sums, counts, rows, model)
    for j in range(4):
        assert counts[j] == (at == j).sum() and np.allclose(sums[j], x[at == j].sum(axis=0))
    monkeypatch.setattr(nearest, "MOSTLY_STORED", 2.0)
    again, same = nearest.search_sparse(rows, model)
    assert (same == at).all() and np.allclose(again[~lost], best[~lost])

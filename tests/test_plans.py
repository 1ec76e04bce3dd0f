"""Shapes of the physical plans that must hold at any size."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from millrace.operators import features, kmeans, nearest, runlog, sampling
from millrace.plans import table_queries as tq


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, points, tmp_path):
    path = str(tmp_path / "points")
    points.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def test_nearest_center_moves_no_points(spark, stored, init):
    model = nearest.collect_centers(init)
    plan = _plan(nearest.nearest_center(stored, model).select("point_id", "cid", "sqdist"))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("EvalPython") == 1
    assert "unused" not in plan


def test_native_search_has_no_join(stored, init):
    plan = _plan(nearest.nearest_center(stored, init, engine="native"))
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_training_round_shuffles_partial_sums_only(spark, stored, init):
    model = nearest.collect_centers(init)
    plan = _plan(nearest.assigned_sums(stored, model, "features"))
    assert plan.count("Exchange") == 1
    # the tasks' rows of arrays are opened behind the exchange
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(cid") < plan.index("MapInArrow")
    assert "ReadSchema: struct<features:array<double>>" in plan


def test_vector_sums_combine_before_the_shuffle(stored):
    keyed = stored.withColumn("key", F.lit(1))
    for engine in ("arrow", "native"):
        plan = _plan(nearest.vector_sums(keyed, "key", engine=engine))
        assert plan.count("Exchange") == 1 and "partial_sum" in plan


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_large_center_tables_take_one_scan_of_the_points(spark, stored, init, engine):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = nearest.nearest_center(stored, init, engine=engine, budget=60)
    plan = _plan(found)
    assert len(re.findall(r"Scan parquet.*point_id", plan)) == 1
    assert found.count() == 120
    copies = [name for name in set(os.listdir(folder)) - before if not name.startswith("centers-")]
    assert copies == []
    assert "EvalPython" not in plan if engine == "native" else "Exchange" not in plan and "Join" not in plan


def test_library_training_has_no_python_stage(points, init, monkeypatch):
    seen = []
    original = kmeans._vector_rdd
    monkeypatch.setattr(kmeans, "_vector_rdd", lambda df: seen.append(_plan(df)) or original(df))
    assert kmeans.fit_library(points, init, 4, 2).count() == 4
    assert "Python" not in seen[0] and "MapInArrow" not in seen[0]


def test_sample_is_a_top_k(stored):
    plan = _plan(sampling.sample_k(stored.select("point_id"), "point_id", 5))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_poisson_sample_is_row_local(stored):
    plan = _plan(sampling.sample_poisson(stored, "point_id", 1.5))
    assert "Exchange" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize(
    "name", ["hash_collisions", "assemble_sparse", "gen_points", "gen_centers", "libsvm_lines"]
)
def test_python_step_runs_once(spark, sf_dir, name):
    assert _plan(entry_module.queries()[name](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_statistics_are_one_subquery_over_the_integers(spark, sf_dir):
    df = entry_module.queries()["zscore"](spark, sf_dir)
    df.collect()
    plan = _plan(df)
    assert "Join" not in plan and "c26" not in plan


def test_suite_filter_reaches_the_scan(spark, sf_dir):
    listed = runlog.listing(tq._experiment(spark, sf_dir), tq._run(spark, sf_dir), "Brand#1")
    assert "EqualTo(p_brand,Brand#1)" in _plan(listed)


def test_medians_shuffle_counts_only(spark, sf_dir):
    profile = runlog.profile(tq._experiment(spark, sf_dir), tq._run(spark, sf_dir))
    plan = _plan(profile)
    # runs meet broadcast tables and are counted in the tasks before anything is exchanged
    assert "SortMergeJoin" not in plan and "partial_count(1)" in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_query_has_a_product_or_nested_loop(spark, sf_dir, name):
    plan = _plan(entry_module.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_wide_log_is_no_single_method(spark, sf_dir):
    """As one whole-stage method the categories would be too long for the JVM's compiler."""
    df = tq.tag_categories(spark, sf_dir)
    df.collect()
    plan = _plan(df)
    made = [line for line in plan[: plan.find("Initial Plan")].splitlines() if "md5(" in line]
    assert made and not any(re.search(r"\*\(\d+\) *Project", line) for line in made)


def test_prepared_lines_take_given_statistics(spark, sf_dir):
    log = tq._clicklog(spark, sf_dir)
    stats = features.column_stats(features.impute_zero(log, tq.INT_COLS), tq.INT_COLS)
    given = spark.createDataFrame(stats.collect(), stats.schema)
    parts = (log, tq.LABEL, tq.INT_COLS, tq.CAT_COLS, tq.BUCKETS)
    lines = features.standardize_and_hash(*parts, stats=given)
    assert _plan(lines).count("FileScan") == 1
    own = features.standardize_and_hash(*parts)
    assert sorted(r.value for r in lines.collect()) == sorted(r.value for r in own.collect())

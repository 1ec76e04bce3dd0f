import random
import statistics
from decimal import Decimal

import pytest

from millrace.operators import runlog

EXPERIMENT = "id bigint, suite string, name string"
RUN = "experiment_id bigint, run int, time bigint"


@pytest.fixture
def tables(spark):
    rng = random.Random(1)
    experiments = [
        (i, f"s{i % 2}", f"n{i % 3}") for i in range(9)
    ] + [(50, None, "unnamed"), (60, "s0", "timeless"), (99, "s0", "unused")]
    runs = []
    for i in range(9):
        # one experiment holds most of the runs
        for r in range(400 if i == 4 else 1 + rng.randrange(8)):
            runs.append((i, r, rng.choice([rng.randrange(50), rng.randrange(10**6), 5_000_000_000])))
    runs += [(50, 1, 3), (50, 2, 4), (50, 3, None), (60, 1, None), (77, 1, 12)]
    return (
        spark.createDataFrame(experiments, EXPERIMENT),
        spark.createDataFrame(runs, RUN).repartition(3),
        experiments,
        runs,
    )


def _groups(experiments, runs):
    by_id = {}
    for i, _, t in runs:
        by_id.setdefault(i, []).append(t)
    out = {}
    for i, suite, name in experiments:
        if i in by_id:
            out.setdefault((suite, name), []).extend(by_id[i])
    return out


def test_summary_by_brute_force(tables):
    experiment, run, experiments, runs = tables
    want = {}
    for key, times in _groups(experiments, runs).items():
        t = [x for x in times if x is not None]
        want[key] = (
            (min(t), max(t), sum(t) - min(t) - max(t), statistics.median(t)) if t else (None,) * 4
        )
    rows = runlog.summary(experiment, run).collect()
    assert {
        (r.suite, r["name"]): (r.min_time, r.max_time, r.sum_minus_extremes, r.median) for r in rows
    } == want
    assert len(rows) == len(want)


def test_profile_without_broadcast(spark, tables):
    experiment, run, *_ = tables
    want = sorted(map(str, runlog.profile(experiment, run).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, runlog.profile(experiment, run).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stats_by_brute_force(tables):
    experiment, run, experiments, runs = tables
    rows = {(r.suite, r["name"]): r for r in runlog.stats(experiment, run).collect()}
    groups = _groups(experiments, runs)
    assert rows.keys() == groups.keys()
    for key, times in groups.items():
        t, r = [x for x in times if x is not None], rows[key]
        assert r.number_of_runs == len(times)
        if t:
            assert r.median == statistics.median(t) / 1000.0
            assert float(r.average) == pytest.approx(statistics.mean(t) / 1000.0, abs=0.0051)
            assert (r.min, r.max) == (min(t) / 1000.0, max(t) / 1000.0)
        else:
            assert r.median is None and r.average is None


def test_three_runs_have_the_same_two_medians(spark):
    experiment = spark.createDataFrame([(1, "s", "n")], EXPERIMENT)
    run = spark.createDataFrame([(1, 1, 300), (1, 2, 100), (1, 3, 250)], RUN)
    row = runlog.summary(experiment, run).first()
    assert row.sum_minus_extremes == 250 and row.median == 250.0
    assert runlog.stats(experiment, run).first().average == Decimal("0.22")


def test_suite_filter_and_order(tables):
    experiment, run, *_ = tables
    rows = runlog.summary(experiment, run, suite="s1").collect()
    assert {r.suite for r in rows} == {"s1"}
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)


def test_listing(tables):
    experiment, run, experiments, runs = tables
    known = {e[0] for e in experiments}
    assert runlog.listing(experiment, run).count() == sum(1 for r in runs if r[0] in known)
    assert runlog.listing(experiment, run).columns == ["name", "suite", "runtime", "run"]


def test_pending(spark):
    expected = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, 2)], "experiment_id int, runs int")
    done = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (4, 9)], "experiment_id int, run int")
    pending = sorted(tuple(r) for r in runlog.pending_runs(expected, done).collect())
    assert pending == [(1, 1), (1, 3), (4, 1), (4, 2)]
    experiments = sorted(r[0] for r in runlog.pending_experiments(expected, done).collect())
    assert experiments == [1, 4]
    assert runlog.pending_runs(expected, done, force=True).count() == 6


def test_many_expected_runs(spark, monkeypatch):
    monkeypatch.setattr(runlog, "CHUNK_WORDS", 3)
    expected = spark.createDataFrame([(1, 1000), (2, 1), (3, 64), (4, 65)], "experiment_id int, runs int")
    rows = sorted(tuple(r) for r in runlog.expected_runs(expected).collect())
    assert rows == [(e, i) for e, n in ((1, 1000), (2, 1), (3, 64), (4, 65)) for i in range(1, n + 1)]


def test_one_experiment_with_ten_million_runs(spark):
    n = 10_000_000
    expected = spark.createDataFrame([(1, n), (2, 3)], "experiment_id long, runs long")
    done = spark.range(1, n + 1).filter("id % 1000003 != 0").selectExpr("1L AS experiment_id", "id AS run")
    pending = runlog.pending_runs(expected, done)
    open_ = [(1, 1000003 * i) for i in range(1, 10)] + [(2, 1), (2, 2), (2, 3)]
    assert sorted(tuple(r) for r in pending.collect()) == open_
    plan = pending._jdf.queryExecution().optimizedPlan().toString()
    # what opens the words stands above the join; below it there are words only
    above, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "run#" in above and "AS bits" in below and "filter(sequence" not in below


@pytest.mark.parametrize("digit", [3, 12])
def test_medians_of_one_group_with_wide_times(spark, monkeypatch, digit):
    """All runs in one group, times to 2^50, below zero, and repeated."""
    monkeypatch.setattr(runlog, "DIGIT", digit)
    rng = random.Random(digit)
    times = [rng.choice([rng.randrange(2**50), rng.randrange(2**20), 7, -rng.randrange(2**33)]) for _ in range(3001)]
    experiment = spark.createDataFrame([(i, "s", None) for i in range(20)], EXPERIMENT)
    for n in (1, 2, 3000, 3001):
        run = spark.createDataFrame([(i % 20, i, t) for i, t in enumerate(times[:n])], RUN).repartition(4)
        got = runlog.profile(experiment, run).collect()
        assert [(r.suite, r["name"], r.median, r.runs) for r in got] == [("s", None, float(statistics.median(times[:n])), n)]
        if digit == 3 and n == 2:
            break


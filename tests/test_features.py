import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import features

COLS = ["a", "b"]


@pytest.fixture
def log(spark):
    rows = [(1, 1, 5, "x", ""), (0, None, 5, None, "y"), (-3, 7, 5, "x", "z"), (2, 4, 5, "", None)]
    return spark.createDataFrame(rows, "label int, a int, b int, c string, d string")


def test_tokens(log):
    kept = [r[0] for r in log.select(features.category_tokens(["c", "d"])).collect()]
    assert kept == [["0:x", "1:"], ["0:", "1:y"], ["0:x", "1:z"], ["0:", "1:"]]
    dropped = [r[0] for r in log.select(features.category_tokens(["c", "d"], "drop")).collect()]
    assert dropped == [["0:x"], ["1:y"], ["0:x", "1:z"], []]
    with pytest.raises(ValueError):
        features.category_tokens(["c"], "other")


def test_stats_and_scores(log):
    filled = features.impute_zero(log, COLS)
    stats = features.collect_stats(features.column_stats(filled, COLS), COLS)
    assert stats["a"] == (3.0, pytest.approx(math.sqrt(7.5))) and stats["b"] == (5.0, 0.0)
    known = features.with_stats(filled, features.column_stats(filled, COLS))
    by_query = [tuple(r) for r in known.select(*features.zscores(COLS)).collect()]
    by_number = [tuple(r) for r in filled.select(*features.zscores(COLS, stats)).collect()]
    for one, two in zip(by_query, by_number):
        assert one == pytest.approx(two)
    assert [b for _, b in by_query] == [0.0] * 4
    assert [a for a, _ in by_query] == pytest.approx([(v - 3) / math.sqrt(7.5) for v in (1, 0, 7, 4)])


def test_declared_row_count(log):
    filled = features.impute_zero(log, COLS)
    row = features.column_stats(filled, COLS, n=6).first()
    mean = 12 / 6
    assert row.mean_a == mean
    assert row.std_a == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in (1, 0, 7, 4)) / 6))


def test_engines_agree_and_vector_is_ordered(log):
    results = {}
    for engine in ("arrow", "native"):
        ready = features.prepare(log, "label", COLS, ["c", "d"], 3, engine=engine)
        assert ready.columns == ["label", "numeric", "hashed"]
        results[engine] = ready.collect()
    assert results["arrow"] == results["native"]
    ready = features.prepare(log, "label", COLS, ["c", "d"], 3)
    for r in ready.select("hashed", features.assemble(2).alias("v")).collect():
        idx = [e.idx for e in r.v]
        assert idx == sorted(idx) and idx[:2] == [1, 2]
        assert [(e.idx - 3, int(e.val)) for e in r.v[2:]] == [tuple(e) for e in r.hashed]
    with pytest.raises(ValueError):
        features.prepare(log, "label", COLS, ["c"], 3, engine="other")


def test_lines(log):
    lines = features.standardize_and_hash(log, "label", COLS, ["c", "d"], 1000, digits=2)
    values = [r.value for r in lines.collect()]
    assert [v.split(" ")[0] for v in values] == ["1", "-1", "-1", "1"]
    assert values[0].split(" ")[1:3] == ["1:-0.73", "2:0.00"]
    for v in values:
        hashed = [f.split(":") for f in v.split(" ")[3:]]
        assert all(int(i) > 2 and int(c) in (-2, -1, 1, 2) for i, c in hashed)
    full = features.standardize_and_hash(log, "label", COLS, ["c", "d"], 1000).first().value
    assert float(full.split(" ")[1].split(":")[1]) == pytest.approx(-2 / math.sqrt(7.5))


def test_sampled_preparation(log):
    grown = log.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(200))))
    keyed = grown.withColumn("key", F.xxhash64("copy", "a", "label"))
    lines = features.standardize_and_hash(
        keyed, "label", COLS, ["c", "d"], 8, fraction=1.5, key="key"
    )
    assert 1000 < lines.count() < 1400
    native = features.standardize_and_hash(keyed, "label", COLS, ["c", "d"], 8, fraction=0.5)
    assert 300 < native.count() < 500


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, 2, "q")], "label int, `odd name` int, `c.d` string")
    row = features.prepare(df, "label", ["odd name"], ["c.d"], 5).first()
    assert row.numeric == [0.0] and len(row.hashed) == 1


def test_binarize(spark):
    df = spark.createDataFrame([(-2,), (0,), (1,), (9,)], "y int")
    assert [r[0] for r in df.select(features.binarize(F.col("y"))).collect()] == [-1, -1, 1, 1]


def test_prepared_size(spark):
    rows = features.prepared_size(spark.range(0, 50, 1, 3)).collect()
    assert [tuple(r) for r in rows] == [(50, 3)]
    assert tuple(features.prepared_size(spark.range(0)).first()) == (0, 0)

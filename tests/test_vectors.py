import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import vectors

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def _one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_sparse_pairs_by_brute_force(spark):
    def dense(s):
        out = [0.0] * s[0]
        for i, v in zip(s[1], s[2]):
            out[i] = v
        return out

    vecs = [
        (6, [], []),
        (6, [0], [2.0]),
        (6, [5], [-1.5]),
        (6, [0, 3, 5], [1.0, 2.0, 3.0]),
        (6, [1, 2, 4], [-1.0, 0.5, 4.0]),
        (6, [0, 1, 2, 3, 4, 5], [1.0, -2.0, 3.0, -4.0, 5.0, -6.0]),
    ]
    rows = [(a, b, dense(b)) for a in vecs for b in vecs]
    df = spark.createDataFrame(rows, f"a {SPARSE}, b {SPARSE}, d array<double>")
    got = df.select(
        vectors.sqdist_sparse("a", "b").alias("ss"),
        vectors.sqdist_sparse_dense("a", "d").alias("sd"),
        vectors.sqdist_dense_sparse("d", "a").alias("ds"),
    ).collect()
    for (a, _, d), r in zip(rows, got):
        want = sum((x - y) ** 2 for x, y in zip(dense(a), d))
        assert r.ss == pytest.approx(want) and r.sd == pytest.approx(want) and r.ds == r.sd


def test_distance_by_column_types(spark):
    df = _one(spark, f"s {SPARSE}, d array<double>, x string, y array<string>",
              (2, [1], [3.0]), [1.0, 1.0], "v", ["v"])
    for a, b, want in (("s", "d", 5.0), ("d", "s", 5.0), ("s", "s", 0.0), ("d", "d", 0.0)):
        assert df.select(vectors.squared_distance(df, a, b)).first()[0] == want
    for other in ("x", "y"):
        with pytest.raises(TypeError, match=other):
            vectors.squared_distance(df, "s", other)


def test_dimension_mismatch_names_both_sizes(spark):
    df = _one(spark, "a array<double>, b array<double>", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0])
    for expr in (vectors.sqdist("a", "b"), vectors.vec_add("a", "b")):
        with pytest.raises(Exception, match="3 and 4"):
            df.select(expr.alias("x")).collect()


def test_sparse_mismatch_and_null(spark):
    df = _one(spark, f"a {SPARSE}, b array<double>", (3, [0], [1.0]), [1.0])
    with pytest.raises(Exception, match="3 and 1"):
        df.select(vectors.sqdist_sparse_dense("a", "b")).collect()
    df = _one(spark, "a array<double>, b array<double>", None, [1.0])
    with pytest.raises(Exception, match="null and 1"):
        df.select(vectors.sqdist("a", "b")).collect()


def test_add_scale_sparsify(spark):
    df = _one(spark, "a array<double>, b array<double>", [1.0, -0.05, 0.0], [2.0, 4.0, 6.0])
    row = df.select(
        vectors.vec_add("a", "b").alias("s"),
        vectors.vec_scale("b", 0.5).alias("h"),
        vectors.sparsify("a", 0.1).alias("p"),
    ).first()
    assert row.s == [3.0, 3.95, 6.0] and row.h == [1.0, 2.0, 3.0]
    assert (row.p.size, row.p.indices, row.p["values"]) == (3, [0], [1.0])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=8))
def test_distance_to_itself_is_zero(spark, values):
    df = _one(spark, "a array<double>", values)
    assert df.select(vectors.sqdist("a", F.col("a"))).first()[0] == 0.0

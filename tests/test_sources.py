import pytest
from pyspark.sql import functions as F

from millrace.operators import features, nearest
from millrace.plans import scratch
from millrace.sources import clicklog, dense, libsvm, parallelism, tables
from millrace.streaming import clicklog_stream, points_stream


def _lines(spark, tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_points_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "points")
    dense.write_points(points, path)
    read = {tuple(r.features) for r in dense.read_points(spark, path).collect()}
    assert read == {tuple(r.features) for r in points.collect()}
    raw = [r.value for r in spark.read.text(path).collect()]
    assert all(len(v.split(",")) == 3 and not v.endswith(",") for v in raw)
    assert dense.read_points(spark, path, partitions=9).rdd.getNumPartitions() == 9
    assert dense.read_centers(spark, path).columns == ["center"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        dense.write_points(points, path)


def test_trailing_commas(spark, tmp_path):
    path = _lines(spark, tmp_path, "p.csv", ["1.0,2.0,", "3,-4e2"])
    assert [r.features for r in dense.read_points(spark, path).collect()] == [[1, 2], [3, -400]]


def test_malformed_number_fails(spark, tmp_path):
    path = _lines(spark, tmp_path, "bad.csv", ["1.0,2.0", "1.0,oops"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dense.read_points(spark, path).collect()


def test_indexed_centers(spark, tmp_path):
    path = _lines(spark, tmp_path, "init", ["(1.0,2.5,-3.0,0)", "(4.0,5.0,6.0,12)"])
    rows = dense.read_indexed_centers(spark, path).collect()
    assert [(r.cid, r.center) for r in rows] == [(0, [1.0, 2.5, -3.0]), (12, [4.0, 5.0, 6.0])]
    again = str(tmp_path / "again")
    dense.write_indexed_centers(dense.read_indexed_centers(spark, path), again)
    assert dense.read_indexed_centers(spark, again).collect() == rows


def test_final_centers(spark, tmp_path):
    centers = spark.createDataFrame([(3, [1.0, 2.0], 7)], "cid int, center array<double>, n bigint")
    path = str(tmp_path / "centers")
    dense.write_centers(centers, path)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        dense.write_centers(centers, path)
    dense.write_centers(centers, path, mode="overwrite")
    assert spark.read.parquet(path).collect() == centers.collect()
    text = str(tmp_path / "text")
    dense.write_centers(centers, text, text=True)
    assert spark.read.text(text).first().value == "(3,1.0,2.0)"


def test_clicklog_edges(spark, tmp_path):
    full = "\t".join(["1", *[str(i) for i in range(13)], *[f"v{i}" for i in range(26)]])
    empty = "0" + "\t" * 39
    path = _lines(spark, tmp_path, "log", [full, empty, "1\t5", full + "\textra\tmore"])
    rows = clicklog.read_clicklog(spark, path).collect()
    assert len(rows[0]) == 40
    assert (rows[0].label, rows[0].i13, rows[0].c1, rows[0].c26) == (1, 12, "v0", "v25")
    assert rows[1].label == 0 and all(v is None for v in rows[1][1:])
    assert rows[2].i1 == 5 and rows[2].i2 is None and rows[2].c26 is None
    assert rows[3] == rows[0]
    again = str(tmp_path / "again")
    clicklog.write_clicklog(clicklog.read_clicklog(spark, path), again)
    key = lambda r: str(tuple(r))
    assert sorted(clicklog.read_clicklog(spark, again).collect(), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("line", ["\t1\t2", "x\t1", "1\tx"])
def test_clicklog_errors(spark, tmp_path, line):
    path = _lines(spark, tmp_path, "log", [line])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clicklog.read_clicklog(spark, path).collect()


def test_libsvm(spark, tmp_path):
    path = _lines(spark, tmp_path, "svm", ["-1 1:0.25 3:-0.1 15:1", "1 2:4", "1"])
    df = libsvm.read_libsvm(spark, path, 20)
    rows = df.collect()
    assert rows[0].label == -1.0 and rows[0].features["size"] == 20
    assert rows[0].features["indices"] == [0, 2, 14]
    assert rows[0].features["values"] == [0.25, -0.1, 1.0]
    long = [tuple(r) for r in libsvm.sparse_entries(df).collect()]
    assert long == [(-1.0, 1, 0.25), (-1.0, 3, -0.1), (-1.0, 15, 1.0), (1.0, 2, 4.0)]
    out = str(tmp_path / "out")
    libsvm.write_lines(spark.createDataFrame([("1 1:2.0",)], "value string"), out)
    assert libsvm.read_libsvm(spark, out, 1).first().features["values"] == [2.0]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert tables.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark)
    with pytest.raises(ValueError):
        tables.read_table(spark, path, {"url": "jdbc:none"})


def test_parallelism(spark):
    df = spark.range(0, 100, 1, 2)
    assert parallelism.at_least(df, 2) is df
    spread = parallelism.at_least(df, 6)
    assert spread.rdd.getNumPartitions() == 6 and spread.count() == 100


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "m")
    assert scratch.materialize(spark.range(4), path).count() == 4
    assert scratch.materialize(spark.range(9), path).count() == 4  # present: not written again
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-00000.parquet").write_text("left by a failed attempt")
    assert scratch.materialize(spark.range(5), str(broken)).count() == 5


def test_scratch_uses_the_cluster_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = scratch.new_path(spark, "x")
    assert path.startswith(folder + "/x-") and path != scratch.new_path(spark, "x")
    assert scratch.write_and_read(spark.range(3), "r").count() == 3


def _drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        return stream.sparkSession.table(name).collect()
    finally:
        query.stop()


def test_points_stream(spark, points, init, tmp_path):
    path = str(tmp_path / "points")
    dense.write_points(points, path)
    model = nearest.collect_centers(init)
    rows = _drain(nearest.nearest_center(points_stream(spark, path), model), "assigned")
    batch = nearest.nearest_center(points.select("features"), init).collect()
    key = lambda r: tuple(r.features)
    assert sorted(rows, key=key) == sorted(batch, key=key)


def test_clicklog_stream(spark, tmp_path):
    lines = ["\t".join([str(i % 2), *["3"] * 13, *["v"] * 26]) for i in range(6)]
    folder = tmp_path / "log"
    folder.mkdir()
    _lines(spark, folder, "part", lines)
    known = {c: (1.0, 2.0) for c in clicklog.INT_COLS}
    ready = features.prepare(
        clicklog_stream(spark, str(folder)),
        clicklog.LABEL,
        clicklog.INT_COLS,
        clicklog.CAT_COLS,
        16,
        stats=known,
    )
    rows = _drain(ready, "prepared")
    assert len(rows) == 6 and all(r.numeric == [1.0] * 13 for r in rows)

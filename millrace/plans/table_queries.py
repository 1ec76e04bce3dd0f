"""The registered queries: every operator applied to the given tables.

``embeddings`` stands in for points, ``events`` for the click log, ``part`` and ``lineitem`` for
experiments and their runs, ``orders`` and ``part`` for row ids of generated data.

Arrays computed in Arrow are exploded as expressions or with the outer form: on a plain array column
Spark adds a "not empty" filter and pushes it down, which would run the Python step twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing, uniform, vectors
from millrace.operators import datagen, distances, features, kmeans, nearest, runlog, sampling
from millrace.plans import scratch
from millrace.sources import clicklog, dense, libsvm, parallelism, tables
from millrace.sources.clicklog import CAT_COLS, INT_COLS, LABEL

K = 5
ROUNDS = 5
SEED = 42
BUCKETS = 16
WIDE_BUCKETS = 1 << 20
SPARSE_THRESHOLD = 0.1
FRACTION = 1.5
FAR = 1e6
DECLARED_ROWS = 12_000
SAMPLE_SIZE = 20
#: A model budget that the initial centers exceed, so that they are searched in blocks.
TINY_BUDGET = 1024
#: Factors by which a vector is repeated to make a wide one.
WIDE_PARTS = 16
MIXTURE = datagen.Mixture(d=4, k=3, seed=SEED)
PART_MIXTURE_D = 4

# Click log derived from `events`; the same text runs on Spark and in the SQL check.
_INT_SOURCES = [
    "CAST(floor(value) AS INT)",
    "CAST(user_id AS INT)",
    "CAST(event_id % 97 AS INT) - 3",
    "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)",
]
_CAT_SOURCES = ["event_type", "props", "CAST(user_id AS STRING)"]


def _int_sql(j: int) -> str:
    source = _INT_SOURCES[j % len(_INT_SOURCES)]
    return (
        f"CASE WHEN (event_id + {j}) % 7 = 0 THEN NULL "
        f"ELSE CAST((({source}) * {j}) % 101 AS INT) END AS i{j}"
    )


def _cat_sql(j: int) -> str:
    if j <= len(_CAT_SOURCES):
        source = _CAT_SOURCES[j - 1]
    else:
        source = f"substr(md5(event_type || '/' || CAST(user_id % {j} AS STRING)), 1, 8)"
    return f"CASE WHEN (event_id + {j}) % 5 = 0 THEN NULL ELSE {source} END AS c{j}"


CLICKLOG_COLUMNS = [
    "event_id",
    "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label",
    *[_int_sql(j) for j in range(1, len(INT_COLS) + 1)],
    *[_cat_sql(j) for j in range(1, len(CAT_COLS) + 1)],
]

# On Spark the first category passes a `transform`, which has no whole-stage code. As one method the
# categories are beyond the size that the JVM compiles, and every row would be interpreted; without
# whole-stage code Spark splits the projection into methods that are compiled.
_WHOLE = f"ELSE {_CAT_SOURCES[0]} END AS c1"
_SPLIT = f"ELSE element_at(transform(array({_CAT_SOURCES[0]}), v -> v), 1) END AS c1"
_LOG_COLUMNS = [c.replace(_WHOLE, _SPLIT) for c in CLICKLOG_COLUMNS]

MISSING_INT = -1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Keeps all cores busy on a table that is one small file; larger tables pass untouched."""
    return parallelism.at_least(df, df.sparkSession.sparkContext.defaultParallelism, key)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vectors.as_doubles("embedding").alias("features")
    )


def _init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.initial_centers(_points(spark, sf_dir), "vec_id", K, SEED)


def _clicklog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").drop("ts")
    return _spread(events, "event_id").selectExpr(*_LOG_COLUMNS)


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_brand AS suite", "p_name AS name"
    )


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS experiment_id",
        "l_linenumber AS run",
        "CAST(floor(l_extendedprice) AS BIGINT) AS time",
    )


def _rounded(c: str, digits: int = 6):
    # adding 0.0 turns a rounded -0.0 into 0.0
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


# --- scans and sinks -----------------------------------------------------------------------------


def scan_dense_csv(spark, sf_dir):
    path = scratch.new_path(spark, "points")
    dense.write_points(_points(spark, sf_dir), path)
    read = dense.read_points(spark, path)
    return read.select(F.posexplode("features").alias("dim", "x")).select(
        (F.col("dim") + 1).alias("dim"), _rounded("x")
    )


def dense_to_csv(spark, sf_dir):
    line = dense.csv_line(F.col("features"))
    return _points(spark, sf_dir).select("vec_id", line.alias("line")).select(
        "vec_id",
        F.size(F.split("line", ",")).alias("fields"),
        F.endswith("line", F.lit(",")).alias("trailing_comma"),
        F.posexplode(F.split("line", ",").cast("array<double>")).alias("dim", "x"),
    ).withColumns({"dim": F.col("dim") + 1, "x": _rounded("x")})


def scan_indexed_centers(spark, sf_dir):
    path = scratch.new_path(spark, "init")
    dense.write_indexed_centers(_init(spark, sf_dir), path)
    long = kmeans.long_form(dense.read_indexed_centers(spark, path))
    return long.select("cid", "dim", _rounded("x"))


def indexed_centers_sink(spark, sf_dir):
    path = scratch.new_path(spark, "init")
    dense.write_indexed_centers(_init(spark, sf_dir), path)
    lines = spark.read.text(path)
    values = F.split(F.regexp_extract("value", r"^\((.*),\d+\)$", 1), ",").cast("array<double>")
    return lines.select(
        F.regexp_extract("value", r",(\d+)\)$", 1).cast("int").alias("cid"),
        F.size(F.split("value", ",")).alias("fields"),
        F.startswith("value", F.lit("(")).alias("opened"),
        F.posexplode(values).alias("dim", "x"),
    ).withColumns({"dim": F.col("dim") + 1, "x": _rounded("x")})


def final_centers_sink(spark, sf_dir):
    trained = kmeans.fit(
        _points(spark, sf_dir), _init(spark, sf_dir), ROUNDS, method="lloyd", storage="DISK_ONLY"
    )
    path = scratch.new_path(spark, "centers")
    dense.write_centers(trained, path, text=True)
    read = dense.parse_final_centers(spark.read.text(path))
    return kmeans.long_form(read).select("cid", "dim", _rounded("x"))


def scan_clicklog_tsv(spark, sf_dir):
    path = scratch.new_path(spark, "clicklog")
    clicklog.write_clicklog(_clicklog(spark, sf_dir), path)
    read = clicklog.read_clicklog(spark, path)
    return read.select(
        LABEL,
        *[F.coalesce(c, F.lit(MISSING_INT)).alias(c) for c in INT_COLS],
        *[F.coalesce(c, F.lit("?")).alias(c) for c in CAT_COLS],
    )


def _prepared(spark, sf_dir, num_features=BUCKETS, **options):
    return features.prepare(
        _clicklog(spark, sf_dir), LABEL, INT_COLS, CAT_COLS, num_features, **options
    )


def libsvm_lines(spark, sf_dir):
    return features.standardize_and_hash(
        _clicklog(spark, sf_dir), LABEL, INT_COLS, CAT_COLS, BUCKETS, digits=6
    )


def libsvm_roundtrip(spark, sf_dir):
    path = scratch.new_path(spark, "libsvm")
    lines = features.standardize_and_hash(
        _clicklog(spark, sf_dir), LABEL, INT_COLS, CAT_COLS, BUCKETS
    )
    libsvm.write_lines(lines, path)
    read = libsvm.read_libsvm(spark, path, len(INT_COLS) + BUCKETS)
    return libsvm.sparse_entries(read).select(
        F.col("label").cast("int").alias("label"), "idx", _rounded("val")
    )


# --- projections ---------------------------------------------------------------------------------


def impute_zero(spark, sf_dir):
    return features.impute_zero(_clicklog(spark, sf_dir), INT_COLS).select("event_id", *INT_COLS)


def tag_categories(spark, sf_dir):
    tokens = features.category_tokens(CAT_COLS)
    return _clicklog(spark, sf_dir).select("event_id", tokens.alias("t")).select(
        "event_id", *[F.col("t")[i].alias(f"t{i}") for i in range(len(CAT_COLS))]
    )


def tag_categories_drop(spark, sf_dir):
    tokens = features.category_tokens(CAT_COLS, missing="drop")
    return _clicklog(spark, sf_dir).select("event_id", F.explode(tokens).alias("token"))


def signed_hash_murmur3(spark, sf_dir):
    tokens = features.category_tokens(CAT_COLS)
    hashed = (
        _clicklog(spark, sf_dir)
        .select("event_id", F.explode(tokens).alias("token"))
        .select("event_id", "token", hashing.murmur3_column(F.col("token")).alias("hash"))
    )
    return hashed.select(
        "event_id",
        "token",
        "hash",
        hashing.hash_index(F.col("hash"), WIDE_BUCKETS).alias("idx"),
        hashing.hash_sign(F.col("hash")).alias("sign"),
    )


def hash_collisions(spark, sf_dir):
    tokens = features.category_tokens(CAT_COLS)
    entries = hashing.hashed_entries(tokens, BUCKETS)
    return _clicklog(spark, sf_dir).select("event_id", F.inline(entries))


def hash_collisions_drop(spark, sf_dir):
    tokens = features.category_tokens(CAT_COLS, missing="drop")
    entries = hashing.hashed_entries(tokens, BUCKETS)
    return _clicklog(spark, sf_dir).select("event_id", F.inline(entries))


def binarize_label(spark, sf_dir):
    return _clicklog(spark, sf_dir).select(
        "event_id", features.binarize(F.col(LABEL)).alias("label")
    )


def zscore(spark, sf_dir):
    filled = features.impute_zero(_clicklog(spark, sf_dir), INT_COLS)
    known = features.with_stats(filled, features.column_stats(filled, INT_COLS))
    scores = features.zscores(INT_COLS)
    return known.select(
        "event_id", *[(F.round(z, 6) + 0.0).alias(f"z{j}") for j, z in enumerate(scores, start=1)]
    )


def assemble_sparse(spark, sf_dir):
    ready = _prepared(spark, sf_dir)
    vector = features.assemble(len(INT_COLS))
    return ready.select("event_id", F.inline(vector)).select("event_id", "idx", _rounded("val"))


def _neighbours(spark, sf_dir):
    left = _points(spark, sf_dir).select("vec_id", F.col("features").alias("a"))
    right = _points(spark, sf_dir).select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("b")
    )
    return left.join(right, "vec_id")


def sqdist_dense(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir)
    distance = vectors.squared_distance(pairs, "a", "b")
    return pairs.select("vec_id", distance.alias("d")).select("vec_id", _rounded("d"))


def sqdist_sparse_sparse(spark, sf_dir):
    sparse = _neighbours(spark, sf_dir).select(
        "vec_id",
        vectors.sparsify("a", SPARSE_THRESHOLD).alias("a"),
        vectors.sparsify("b", SPARSE_THRESHOLD).alias("b"),
    )
    distance = vectors.squared_distance(sparse, "a", "b")
    return sparse.select("vec_id", distance.alias("d")).select("vec_id", _rounded("d"))


def sqdist_sparse_dense(spark, sf_dir):
    mixed = _neighbours(spark, sf_dir).select(
        "vec_id", vectors.sparsify("a", SPARSE_THRESHOLD).alias("a"), "b"
    )
    distance = vectors.squared_distance(mixed, "a", "b")
    return mixed.select("vec_id", distance.alias("d")).select("vec_id", _rounded("d"))


def vector_add_scale(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir)
    middle = vectors.vec_scale(vectors.vec_add("a", "b"), 0.5)
    return pairs.select("vec_id", F.posexplode(middle).alias("dim", "x")).select(
        "vec_id", (F.col("dim") + 1).alias("dim"), _rounded("x")
    )


def size_model(spark, sf_dir):
    rows = datagen.rows_for_size_column(F.col("p_retailprice"), F.col("p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", rows.alias("n_rows"))


# --- aggregation and training --------------------------------------------------------------------


def nearest_center(spark, sf_dir):
    found = nearest.nearest_center(_points(spark, sf_dir), _init(spark, sf_dir))
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def nearest_center_native(spark, sf_dir):
    found = nearest.nearest_center(
        _points(spark, sf_dir), _init(spark, sf_dir), engine="native"
    )
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def _moved(vector: str):
    """Moves the first dimension far out, where |x|² - 2x·c + |c|² cancels."""
    return F.transform(vector, lambda x, i: F.when(i == 0, x + F.lit(FAR)).otherwise(x))


def _far(spark, sf_dir):
    """Sparse points and dense centers far from the origin."""
    points = _points(spark, sf_dir).select("vec_id", _moved("features").alias("features"))
    centers = _init(spark, sf_dir).select("cid", _moved("center").alias("center"))
    sparse = vectors.sparsify("features", SPARSE_THRESHOLD).alias("features")
    return points.select("vec_id", sparse), centers


def nearest_center_sparse(spark, sf_dir):
    found = nearest.nearest_center(*_far(spark, sf_dir))
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def nearest_center_sparse_native(spark, sf_dir):
    found = nearest.nearest_center(*_far(spark, sf_dir), engine="native")
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def kmeans_cost_sparse(spark, sf_dir):
    return nearest.clustering_cost(*_far(spark, sf_dir)).select(F.round("cost", 6).alias("cost"))


def _long_sums(sums):
    return sums.select("cid", (F.col("dim") + 1).alias("dim"), _rounded("x"), "n")


def vector_sum_by_cluster(spark, sf_dir):
    return _long_sums(nearest.vector_sums(_points(spark, sf_dir), "label"))


def vector_sum_null_key(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 != 0, F.col("label"))
    return _long_sums(nearest.vector_sums(_points(spark, sf_dir).withColumn("label", label), "label"))


def vector_mean_by_cluster(spark, sf_dir):
    return _long_sums(nearest.vector_means(_points(spark, sf_dir), "label"))


def vector_mean_by_cluster_native(spark, sf_dir):
    return _long_sums(nearest.vector_means(_points(spark, sf_dir), "label", engine="native"))


def kmeans_cost(spark, sf_dir):
    cost = nearest.clustering_cost(_points(spark, sf_dir), _init(spark, sf_dir))
    return cost.select(F.round("cost", 6).alias("cost"))


def kmeans_lloyd(spark, sf_dir):
    trained = kmeans.fit_lloyd(_points(spark, sf_dir), _init(spark, sf_dir), ROUNDS)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def kmeans_lloyd_sizes(spark, sf_dir):
    trained = kmeans.fit_lloyd(_points(spark, sf_dir), _init(spark, sf_dir), ROUNDS)
    return trained.select("cid", "n")


def kmeans_mllib(spark, sf_dir):
    trained = kmeans.fit_library(_points(spark, sf_dir), _init(spark, sf_dir), K, ROUNDS)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def column_mean(spark, sf_dir):
    filled = features.impute_zero(_clicklog(spark, sf_dir), INT_COLS)
    actual = features.column_stats(filled, INT_COLS)
    return actual.select(*[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in INT_COLS])


def column_stddev_pop(spark, sf_dir):
    filled = features.impute_zero(_clicklog(spark, sf_dir), INT_COLS)
    actual = features.column_stats(filled, INT_COLS)
    return actual.select(*[F.round(f"std_{c}", 6).alias(f"std_{c}") for c in INT_COLS])


def column_stats_declared(spark, sf_dir):
    filled = features.impute_zero(_clicklog(spark, sf_dir), INT_COLS)
    declared = features.column_stats(filled, INT_COLS, n=DECLARED_ROWS)
    return declared.select(*[F.round(c, 6).alias(c) for c in declared.columns])


def prepared_count(spark, sf_dir):
    lines = features.standardize_and_hash(
        _clicklog(spark, sf_dir),
        LABEL,
        INT_COLS,
        CAT_COLS,
        BUCKETS,
        fraction=FRACTION,
        seed=SEED,
        key="event_id",
    )
    path = scratch.new_path(spark, "prepared")
    libsvm.write_lines(lines, path)
    return features.prepared_size(spark.read.text(path)).select(
        "n_rows", (F.col("n_partitions") > 0).alias("in_parts")
    )


def _sparse_points(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", vectors.sparsify("features", SPARSE_THRESHOLD).alias("features"))


def _sparse_training(spark, sf_dir, **options):
    """Sparse points from dense centers, which are the same points filled up."""
    kept = F.transform("features", lambda x: F.when(F.abs(x) > SPARSE_THRESHOLD, x).otherwise(F.lit(0.0)))
    filled = _points(spark, sf_dir).select("vec_id", kept.alias("features"))
    init = sampling.initial_centers(filled, "vec_id", K, SEED)
    trained = kmeans.fit_lloyd(_sparse_points(spark, sf_dir), init, ROUNDS, **options)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def kmeans_lloyd_sparse(spark, sf_dir):
    return _sparse_training(spark, sf_dir)


def kmeans_lloyd_sparse_blocks(spark, sf_dir):
    return _sparse_training(spark, sf_dir, budget=TINY_BUDGET)


def kmeans_lloyd_libsvm(spark, sf_dir):
    """Training on prepared lines read back from text; sparse centers, of which stored values are compared."""
    stats = features.column_stats(features.impute_zero(_clicklog(spark, sf_dir), INT_COLS), INT_COLS)
    # start and lines share the statistics: one row, worked out in one pass
    stats = spark.createDataFrame(stats.collect(), stats.schema)
    ready = _prepared(spark, sf_dir, stats=stats)
    entries = features.assemble(len(INT_COLS))
    size = len(INT_COLS) + BUCKETS
    vector = F.struct(
        F.lit(size).alias("size"),
        F.transform("entries", lambda e: e["idx"] - 1).alias("indices"),
        F.transform("entries", lambda e: e["val"]).alias("values"),
    )
    prepared = ready.select("event_id", entries.alias("entries")).select("event_id", vector.alias("features"))
    init = sampling.initial_centers(prepared, "event_id", K, SEED)
    path = scratch.new_path(spark, "libsvm")
    lines = features.standardize_and_hash(
        _clicklog(spark, sf_dir), LABEL, INT_COLS, CAT_COLS, BUCKETS, stats=stats
    )
    libsvm.write_lines(lines, path)
    trained = kmeans.fit_lloyd(libsvm.read_libsvm(spark, path, size), init, ROUNDS)
    stored = libsvm.sparse_entries(trained, "center").filter("val != 0")
    return stored.select("cid", F.col("idx").alias("dim"), F.col("val").alias("x")).select("cid", "dim", _rounded("x"))


def kmeans_lloyd_blocks(spark, sf_dir):
    trained = kmeans.fit_lloyd(_points(spark, sf_dir), _init(spark, sf_dir), ROUNDS, budget=TINY_BUDGET)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def kmeans_fit_library(spark, sf_dir):
    trained = kmeans.fit(_points(spark, sf_dir), _init(spark, sf_dir), ROUNDS, method="library", k=K)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def nearest_center_blocks(spark, sf_dir):
    found = nearest.nearest_center(_points(spark, sf_dir), _init(spark, sf_dir), budget=TINY_BUDGET)
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def nearest_center_native_blocks(spark, sf_dir):
    found = nearest.nearest_center(
        _points(spark, sf_dir), _init(spark, sf_dir), engine="native", budget=TINY_BUDGET
    )
    return found.select("vec_id", "cid", F.round("sqdist", 6).alias("d"))


def sqdist_sparse_long(spark, sf_dir):
    entries = distances.long_form(_sparse_points(spark, sf_dir), "vec_id")
    pairs = _neighbours(spark, sf_dir).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    found = distances.long_distances(
        entries.withColumnRenamed("vec_id", "a"), entries.withColumnRenamed("vec_id", "b"), pairs
    )
    return found.select(F.col("a").alias("vec_id"), F.col("sqdist").alias("d")).select("vec_id", _rounded("d"))


def _widened(vector: str):
    part = F.transform(F.sequence(F.lit(1), F.lit(WIDE_PARTS)), lambda i: F.transform(vector, lambda x: x * i))
    return F.flatten(part)


def sqdist_dense_wide(spark, sf_dir):
    # a generator of one row: Spark does not hand expressions with lambdas to an Arrow function
    both = F.struct(_widened("a").alias("a"), _widened("b").alias("b"))
    wide = _neighbours(spark, sf_dir).select("vec_id", F.inline(F.array(both)))
    return wide.select("vec_id", distances.wide_sqdist("a", "b").alias("d")).select("vec_id", _rounded("d"))


def dimension_check(spark, sf_dir):
    """Vectors cut to a length by their label, against whole and against sparse ones."""
    cut = _points(spark, sf_dir).select(
        "vec_id", F.slice("features", F.lit(1), F.lit(64) - F.col("label") % 3).alias("a"), F.col("features").alias("b")
    ).withColumn("c", vectors.sparsify("b", SPARSE_THRESHOLD))
    return cut.select(
        "vec_id",
        vectors.same_dimension(cut, "a", "b").alias("dense"),
        vectors.same_dimension(cut, "a", "c").alias("sparse"),
    )


def materialize_once(spark, sf_dir):
    """The second call finds the finished copy and leaves its own input alone."""
    path = scratch.new_path(spark, "once")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scratch.materialize(orders, path)
    return scratch.materialize(orders.filter("o_orderkey < 0"), path)


def libsvm_lines_declared_sampled(spark, sf_dir):
    return features.standardize_and_hash(
        _clicklog(spark, sf_dir), LABEL, INT_COLS, CAT_COLS, BUCKETS,
        fraction=FRACTION, seed=SEED, n=DECLARED_ROWS, key="event_id", digits=6,
    )


# --- sampling and generation ---------------------------------------------------------------------


def sample_k(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_k(orders, "o_orderkey", SAMPLE_SIZE, SEED)


def sample_poisson(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_poisson(orders, "o_orderkey", FRACTION, SEED)


def sample_poisson_native(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sampled = sampling.sample_with_replacement(orders, FRACTION, SEED)
    known = orders.select("*", F.lit(True).alias("known"))
    counts = sampled.join(known, ["o_orderkey", "o_totalprice"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known")
    )
    expected = orders.agg(F.count(F.lit(1)) * F.lit(FRACTION)).scalar()
    return counts.withColumn("expected", expected).select(
        (F.col("n") == F.col("n_known")).alias("all_known"),
        (F.abs(F.col("n") - F.col("expected")) <= 6 * F.sqrt("expected")).alias("size_as_expected"),
    )


def _null_keyed(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey"))
    return _table(spark, sf_dir, "orders").select(key.alias("key"), "o_totalprice")


def sample_poisson_null_key(spark, sf_dir):
    return sampling.sample_poisson(_null_keyed(spark, sf_dir), "key", FRACTION, SEED)


def sample_k_null_key(spark, sf_dir):
    # which of the rows with a null key are taken is open, so only the keys are compared
    return sampling.sample_k(_null_keyed(spark, sf_dir), "key", SAMPLE_SIZE, SEED).select("key")


def counter_uniform(spark, sf_dir):
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(uniform.counter_uniform(key, SEED), 12).alias("u"),
        uniform.counter_int(key, SEED, 100).alias("u100"),
    )


def _part_centers(spark, sf_dir):
    ids = _table(spark, sf_dir, "part").select("p_partkey")
    mixture = datagen.Mixture(d=PART_MIXTURE_D, k=ids.count(), seed=SEED)
    return datagen.mixture_centers(ids, mixture, key="p_partkey")


def gen_centers(spark, sf_dir):
    return _part_centers(spark, sf_dir).select(
        "p_partkey", F.posexplode_outer("center").alias("dim", "x")
    ).select("p_partkey", (F.col("dim") + 1).alias("dim"), _rounded("x"))


def gen_sigma(spark, sf_dir):
    return _part_centers(spark, sf_dir).select("p_partkey", _rounded("sigma"))


def _generated(spark, sf_dir):
    ids = _table(spark, sf_dir, "orders").select("o_orderkey")
    return datagen.mixture_points(ids, MIXTURE, key="o_orderkey")


def gen_points(spark, sf_dir):
    return _generated(spark, sf_dir).select(
        "o_orderkey", "true_cid", F.posexplode_outer("features").alias("dim", "x")
    ).select("o_orderkey", "true_cid", (F.col("dim") + 1).alias("dim"), _rounded("x"))


def gen_points_count(spark, sf_dir):
    return (
        _generated(spark, sf_dir)
        .groupBy("true_cid", "is_noise")
        .agg(F.count("*").alias("n_rows"))
    )


def _generated_init(spark, sf_dir):
    ids = _table(spark, sf_dir, "orders").select("o_orderkey")
    return datagen.mixture_init(ids, MIXTURE, K, key="o_orderkey")


def gen_initial_centers(spark, sf_dir):
    return kmeans.long_form(_generated_init(spark, sf_dir)).select("cid", "dim", _rounded("x"))


def train_generated(spark, sf_dir):
    paths = {label: scratch.new_path(spark, label) for label in ("points", "init")}
    dense.write_points(_generated(spark, sf_dir), paths["points"])
    dense.write_indexed_centers(_generated_init(spark, sf_dir), paths["init"])
    points = dense.read_points(spark, paths["points"])
    trained = kmeans.fit_lloyd(points, dense.read_indexed_centers(spark, paths["init"]), ROUNDS)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


def _mixture(spark, sf_dir):
    """The generator as one call, for as many rows as there are orders."""
    n = _table(spark, sf_dir, "orders").count()
    return datagen.gaussian_mixture(spark, datagen.Mixture(d=MIXTURE.d, k=MIXTURE.k, seed=SEED), n_rows=n)


def gen_mixture(spark, sf_dir):
    points, _, _ = _mixture(spark, sf_dir)
    return points.select("point_id", "true_cid", F.posexplode_outer("features").alias("dim", "x")).select(
        "point_id", "true_cid", (F.col("dim") + 1).alias("dim"), _rounded("x")
    )


def train_mixture(spark, sf_dir):
    points, _, init = _mixture(spark, sf_dir)
    trained = kmeans.fit_lloyd(points, init, ROUNDS)
    return kmeans.long_form(trained).select("cid", "dim", _rounded("x"))


# --- run log -------------------------------------------------------------------------------------


def runtime_summary(spark, sf_dir):
    return runlog.summary(_experiment(spark, sf_dir), _run(spark, sf_dir))


def runtime_stats(spark, sf_dir):
    return runlog.stats(_experiment(spark, sf_dir), _run(spark, sf_dir))


def runtime_listing(spark, sf_dir):
    return runlog.listing(_experiment(spark, sf_dir), _run(spark, sf_dir))


def _expected_finished(spark, sf_dir):
    expected = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.lit(7).alias("runs")
    )
    finished = (
        _table(spark, sf_dir, "lineitem")
        .filter("l_linestatus = 'F'")
        .selectExpr("l_orderkey AS experiment_id", "l_linenumber AS run")
    )
    return expected, finished


def pending_runs(spark, sf_dir):
    return runlog.pending_runs(*_expected_finished(spark, sf_dir))


def pending_experiments(spark, sf_dir):
    return runlog.pending_experiments(*_expected_finished(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        kmeans_lloyd,
        kmeans_lloyd_sizes,
        kmeans_mllib,
        kmeans_cost,
        nearest_center,
        nearest_center_native,
        vector_sum_by_cluster,
        vector_mean_by_cluster,
        vector_mean_by_cluster_native,
        sqdist_dense,
        sqdist_sparse_sparse,
        sqdist_sparse_dense,
        vector_add_scale,
        scan_dense_csv,
        dense_to_csv,
        scan_indexed_centers,
        indexed_centers_sink,
        scan_clicklog_tsv,
        impute_zero,
        tag_categories,
        tag_categories_drop,
        binarize_label,
        column_mean,
        column_stddev_pop,
        column_stats_declared,
        zscore,
        prepared_count,
        signed_hash_murmur3,
        hash_collisions,
        hash_collisions_drop,
        assemble_sparse,
        libsvm_lines,
        libsvm_roundtrip,
        sample_k,
        sample_poisson,
        sample_poisson_native,
        counter_uniform,
        size_model,
        gen_centers,
        gen_sigma,
        gen_points,
        gen_points_count,
        runtime_summary,
        runtime_stats,
        runtime_listing,
        pending_runs,
        pending_experiments,
        nearest_center_sparse,
        nearest_center_sparse_native,
        kmeans_cost_sparse,
        vector_sum_null_key,
        sample_k_null_key,
        sample_poisson_null_key,
        final_centers_sink,
        gen_initial_centers,
        train_generated,
        kmeans_lloyd_sparse,
        kmeans_lloyd_sparse_blocks,
        kmeans_lloyd_libsvm,
        kmeans_lloyd_blocks,
        kmeans_fit_library,
        nearest_center_blocks,
        nearest_center_native_blocks,
        sqdist_sparse_long,
        sqdist_dense_wide,
        dimension_check,
        materialize_once,
        libsvm_lines_declared_sampled,
        gen_mixture,
        train_mixture,
    )
}

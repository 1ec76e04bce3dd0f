import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def points(spark):
    """120 vectors around three places, in five partitions."""
    import numpy as np

    rng = np.random.default_rng(7)
    places = np.array([[0.0, 0.0, 0.0], [5.0, 5.0, 0.0], [-5.0, 4.0, 9.0]])
    x = places[rng.integers(0, 3, 120)] + rng.normal(0, 1, (120, 3))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "point_id bigint, features array<double>").repartition(5)


@pytest.fixture
def init(points):
    from millrace.operators.sampling import initial_centers

    return initial_centers(points, "point_id", 4)

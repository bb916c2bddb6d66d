import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function on many rows of string arguments at once."""

    def run(fn, rows):
        from pyspark.sql import functions as F

        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        schema = "n int, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        found = df.select("n", fn(*[F.col(n) for n in names]).alias("v")).collect()
        return [r["v"] for r in sorted(found, key=lambda r: r["n"])]

    return run


@pytest.fixture(scope="session")
def value(values):
    def run(fn, *args):
        return values(fn, [args])[0]

    return run

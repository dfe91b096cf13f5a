import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from atlasloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column function over literal rows: `evaluate(fn, [(a, b), ...], "a string, b int")`."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
        cols = [F.col(c) for c in df.columns[1:]]
        found = df.select("__i", fn(*cols).alias("r")).collect()
        return [r.r for r in sorted(found, key=lambda r: r["__i"])]

    return run

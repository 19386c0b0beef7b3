import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bidweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"{root}/checkpoints"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Column expression on literal rows: rows([("a",)], "x string", expr) -> list of values."""
    def run(data, schema, *exprs):
        out = spark.createDataFrame(data, schema).select(*exprs).collect()
        return [r[0] if len(exprs) == 1 else tuple(r) for r in out]
    return run

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kilohour.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows from pandas or tuples; text columns named *_utc, origin or ts become timestamps."""
    from pyspark.sql import functions as F

    def make(rows, columns, types=None):
        df = spark.createDataFrame(rows, types or columns)
        stamps = [c for c, t in df.dtypes if t == "string" and (c.endswith("_utc") or c in ("forecast_origin", "origin", "at"))]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps})

    return make

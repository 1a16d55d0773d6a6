import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def small_blocks(spark):
    """Treat every group above 16 rows as too large for one task."""
    from tapeloom.runtime import MAX_GROUP_ROWS_KEY

    spark.conf.set(MAX_GROUP_ROWS_KEY, "16")
    yield
    spark.conf.unset(MAX_GROUP_ROWS_KEY)


def canonical(df):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("null" if v is None or v != v else repr(v) for v in row) for row in pdf.astype(object).itertuples(index=False, name=None))

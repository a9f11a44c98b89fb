import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_bytes(spark):
    """Sets the size of file splits, so that records cross them."""
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def cut_units(spark, split_bytes):
    """Lines of files in small splits; later reads of helper tables aren't cut like that."""
    def read(path, size):
        split_bytes(size)
        from sparklog.sources.files import scan_units
        units = scan_units(spark, str(path))
        rows = units.collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        return spark.createDataFrame(rows, units.schema).coalesce(1)
    return read


@pytest.fixture
def write_file(tmp_path):
    def write(data, name="a.log"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)
    return write


@pytest.fixture
def rows():
    def collect(df, *columns, order=("source", "idx")):
        out = df.orderBy(*[c for c in order if c in df.columns]).select(*columns).collect()
        return [tuple(r) for r in out]
    return collect

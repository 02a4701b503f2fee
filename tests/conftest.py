import pytest
from pyspark.sql import SparkSession

from sharelode.session import STATIC, configure


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]")
    for key, value in STATIC.items():
        builder = builder.config(key, value)
    session = (
        builder
        .appName("sharelode-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()

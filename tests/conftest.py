import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tmp).config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", f"{tmp}/wh").config("spark.checkpoint.dir", f"file://{tmp}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session

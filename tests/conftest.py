import pytest
from pyspark.sql import SparkSession

from colloquy.session import ship


@pytest.fixture(scope="session")
def spark():
    out = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return ship(out)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import requestloom
from requestloom.session import configure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    cloudpickle.register_pickle_by_value(requestloom)
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def plan_of():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text

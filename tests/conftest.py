import os

import pytest
from pyspark.sql import SparkSession

from tests.oracle import ROOT, connect

FOLDER = os.path.join(ROOT, os.environ.get("FATHOMLINE_TEST_SF", "sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def oracle():
    return connect(FOLDER)


@pytest.fixture
def hot(spark):
    """Every group counts as hot, and a block holds seven rows."""
    spark.conf.set("fathomline.hotGroupRows", "7")
    yield
    spark.conf.unset("fathomline.hotGroupRows")

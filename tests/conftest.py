import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
    }
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])

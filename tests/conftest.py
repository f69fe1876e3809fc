import os

import pytest

from loomstat.session import get_spark

TESTDATA = os.environ.get("LOOMSTAT_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = get_spark(
        "loomstat-tests",
        master="local[8]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="6g",
        spark_checkpoint_dir=str(folder),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tables(spark):
    def load(name, sf="0.001"):
        return spark.read.parquet(f"{TESTDATA}/sf{sf}/{name}.parquet")

    return load


def plan_of(df):
    """Final physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()

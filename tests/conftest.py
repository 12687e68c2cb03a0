import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def docs_of(spark):
    """DocTable of a dict of id to JSON-able object, or to bytes."""
    import json

    from factweave.sources.facts import DocTable

    def make(docs):
        rows = [(k, bytearray(v if isinstance(v, bytes) else json.dumps(v).encode())) for k, v in docs.items()]
        return DocTable(spark.createDataFrame(rows, "doc_id string, doc binary"), "tenant-a")

    return make

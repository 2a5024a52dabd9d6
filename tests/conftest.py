import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def words(spark):
    """Makes (page_id, word_idx, word, start, end, confidence, is_title) from [(word, start, end), ...] by page."""

    def make(pages, confidence=1.0):
        rows = [(p, i, w[0], float(w[1]), float(w[2]), confidence, False) for p, ws in pages.items() for i, w in enumerate(ws)]
        return spark.createDataFrame(rows, "page_id string, word_idx int, word string, start double, end double, confidence double, is_title boolean")

    return make

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from opinio.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="opinio-test-ckpt-")
    wh = tempfile.mkdtemp(prefix="opinio-test-warehouse-")
    s = get_spark(master="local[4]", app="opinio-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g",
                         "spark.sql.warehouse.dir": wh})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def model(spark):
    from opinio.sources.news_model import NewsModel
    return NewsModel(spark, SF_SMALL)

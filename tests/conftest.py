import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    extra = {}
    if not SparkSession.getActiveSession():
        # tests set their own checkpoint folder only when the cluster has none
        from pyspark import SparkConf

        if not SparkConf().get("spark.checkpoint.dir", None):
            extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="hostscope-test-ckpt-")
    from hostscope.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8, extra=extra)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="hostscope-test-")

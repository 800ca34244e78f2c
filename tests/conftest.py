import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.ui.retainedExecutions", "20000")          # a test reads plans by their place among all of the session
         .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def root():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def voxels(spark):
    """Make a voxel table from a dense array (nonzero entries), values in ``agfe``."""
    def make(array, probe="BEN", origin=(0, 0, 0)):
        at = np.argwhere(array != 0)
        pdf = pd.DataFrame({"probe": probe, **{a: (at[:, n] + origin[n]).astype("int32") for n, a in enumerate("ijk")},
                            "agfe": array[tuple(at.T)].astype(float)})
        return spark.createDataFrame(pdf, "probe string, i int, j int, k int, agfe double")
    return make


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())

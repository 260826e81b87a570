import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("healthspark-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hs-test-ckpt-"))
    yield s


def corpus_df(spark, files, repo="r"):
    """files: {path: text or bytes}; one repository unless a (repo, path) key is given."""
    rows = []
    for key, content in files.items():
        r, p = key if isinstance(key, tuple) else (repo, key)
        rows.append((r, p, content))
    kind = "binary" if any(isinstance(c, bytes) for _, _, c in rows) else "string"
    rows = [(r, p, (c.encode() if isinstance(c, str) else c) if kind == "binary" else c) for r, p, c in rows]
    return spark.createDataFrame(rows, f"repo_id string, path string, content {kind}")

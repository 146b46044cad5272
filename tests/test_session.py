"""The scratch folder and the way code reaches executors."""

import os
import subprocess
import sys

import pytest

from rewardlens import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master, applicationId = "spark://somewhere:7077", "app-1"

    def getConf(self):
        return _Conf()


class _Session:
    conf, sparkContext = _Conf(), _Context()


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session())


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # for the driver alone: Python workers get their path from the environment
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())

def found(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("rewardlens") is not None] * b.num_rows)], ["there"])

one = spark.range(1)
print("BEFORE", one.mapInArrow(found, "there boolean").first()[0])
from rewardlens.operators.pack import buffer_ids
df = spark.createDataFrame([(i, 10) for i in range(100)], "k long, s int")
print("BUFFERS", buffer_ids(df, F.col("s"), ["k"], 95).agg(F.max("buffer_id")).first()[0])
print("AFTER", one.mapInArrow(found, "there boolean").first()[0])
"""


def test_workers_get_the_package_from_any_working_folder(tmp_path):
    """Python workers start outside the repository and without its path: only what is shipped is there."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    code = SCRIPT.format(repo=REPO, shared=f"file://{tmp_path}/shared")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "BEFORE False" in got.stdout and "BUFFERS 9" in got.stdout and "AFTER True" in got.stdout, got.stdout + got.stderr[-3000:]

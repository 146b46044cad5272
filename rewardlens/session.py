"""Session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are still unset, so a cluster's own configuration
(shuffle partitions, checkpoint folder, AQE thresholds) always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings this library relies on; applied only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "rewardlens",
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; give it the heap
        builder = builder.config("spark.driver.memory", "16g").config("spark.driver.maxResultSize", "4g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    It is the session's ``spark.checkpoint.dir``. A session whose executors are
    other processes must name one: without it this raises. Only a plain
    ``local[..]`` session, where driver and executors are one process, gets a
    private folder when the setting is unset (tests). The configuration itself
    is never changed.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(
                "spark.checkpoint.dir is not set: name a folder that the driver and all executors share "
                "when the session is built")
        d = _LOCAL_SCRATCH.get(sc.applicationId)
        if d is None:
            d = _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="rewardlens-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's modules to the executors (once per application).

    Python functions that run in tasks are pickled by reference, so executors
    must be able to import ``rewardlens``. Where it is installed there (see
    ``pyproject.toml``) this changes nothing; elsewhere the sources travel as a
    small zip through Spark's own file distribution.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rewardlens-src-"), "rewardlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("rewardlens", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)

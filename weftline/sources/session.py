"""Sessions for tests and tools, and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session in UTC; for tests, benches and the command line."""
    base = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.python.sql.dataFrameDebugging.enabled": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        folder = tempfile.mkdtemp(prefix="weftline-ship-")
        sc.addPyFile(shutil.make_archive(f"{folder}/weftline", "zip", root, "weftline"))
    _shipped.add(sc.applicationId)

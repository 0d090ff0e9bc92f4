"""Session setup and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


LOCAL_MEMORY = "8g"


def get_session(app_name: str = "holdfast", master: str | None = None, cores: int | None = None) -> SparkSession:
    """Build a session. On a cluster the launcher's own settings win; only semantics are pinned here."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # One process does all the work; the default heap is meant for a driver that only plans.
            builder = builder.config("spark.driver.memory", LOCAL_MEMORY)
    if cores:
        builder = (
            builder.config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.default.parallelism", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return builder.getOrCreate()


@cache
def _own_folder() -> str:
    """One folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="holdfast-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path for ``purpose`` under the shared folder named in ``spark.checkpoint.dir``.

    A machine-local folder is only accepted when every task runs in this process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = _own_folder()
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")

"""Session helpers shared by entry points, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "cuelake") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one that is given."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(x for x in (str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")) if x))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where all executors can write: under spark.checkpoint.dir, or, only where that is unset and all tasks run on this machine, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cuelake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
